"""Distances, spatial kernels and blocked interval matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.settings import BORDER_BONUS, SPATIAL_KM

EARTH_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    # least passes over nulls, so a missing coordinate needs a guard of its own
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def pairs(places: DataFrame) -> DataFrame:
    """(a, b, km) of every two different countries. ``places`` (country, lat, lon) holds one row per code of three
    letters, other codes are left out: no more than 26 ** 3 rows, so that it may be broadcast."""
    at = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("country").rlike("^[A-Z]{3}$"))
    a = at.select(F.col("country").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1"))
    b = at.select(F.col("country").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    km = haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", km.alias("km"))


def adjacency(places: DataFrame) -> DataFrame:
    """(a, b): symmetric closure of the lists ``neighbours``; neighbours that aren't places and a place itself don't count."""
    named = places.select(F.col("country").alias("a"), F.explode("neighbours").alias("b"))
    both = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    known = places.select("country")
    return both.join(known.withColumnRenamed("country", "a"), "a", "left_semi").join(known.withColumnRenamed("country", "b"), "b", "left_semi").select("a", "b")


def kernel(places: DataFrame, reach_km: float = SPATIAL_KM, border_bonus: float = BORDER_BONUS) -> DataFrame:
    """(a, b, km, border, raw, w): Gaussian decay between country centroids with a bonus for a shared border; w sums to 1
    for every a."""
    near = adjacency(places).withColumn("border", F.lit(1.0))
    raw = pairs(places).join(near, ["a", "b"], "left").withColumn("border", F.coalesce("border", F.lit(0.0)))
    raw = raw.withColumn("raw", F.exp(-F.pow(F.col("km") / reach_km, 2)) + border_bonus * F.col("border"))
    sums = raw.groupBy("a").agg(F.sum("raw").alias("total"))
    share = F.col("raw") / F.when(F.col("total") < 1e-12, 1.0).otherwise(F.col("total"))
    return raw.join(sums, "a").select("a", "b", "km", "border", "raw", share.alias("w"))


def radius_km(area_km2: Column, cap_km: float = 700.0) -> Column:
    """Radius of the circle of a country's area, capped; 50 for an area that isn't positive or missing."""
    return F.when(area_km2 > 0, F.least(F.sqrt(area_km2 / F.pi()), F.lit(cap_km))).otherwise(50.0)


def interval_candidates(events: DataFrame, days: int = 3, km: float = 10.0, entity: str = "entity_key") -> DataFrame:
    """(i, j, days, km, score): pairs of one block from different sources within ``days`` and ``km`` (or one region when
    a place is missing). Besides the entity the equi-join key holds the day bucket and a place cell, or the region where a
    place is missing, so that a hot entity is split by time and place.

    A place cell is ``km`` wide in latitude and at least that wide in longitude at its latitude band; each right record
    is listed in its own cell and the eight around it."""
    side = lambda p: events.select(*(F.col(x).alias(p + x) for x in ("event_id", entity, "source_name", "reference_date", "admin1", "lat", "lon"))).where(F.col(p + "reference_date").isNotNull() & F.col(p + "event_id").isNotNull())
    bucket = lambda x: F.floor(F.unix_date(x) / (days + 1))
    step = km / 110.0

    def cells(p: str, around: bool) -> Column:
        lat, lon = F.col(p + "lat"), F.col(p + "lon")
        row = F.floor(lat / step)
        reach = (-1, 0, 1) if around else (0,)
        found = []
        for dy in reach:
            # degrees of longitude of a cell in the band of that row: the wider end of the band decides
            edge = F.least(F.abs((row + dy) * step), F.abs((row + dy + 1) * step))
            widest = edge + step
            # around the poles one cell holds the whole band
            count = F.when(widest > 89.0, F.lit(1)).otherwise(F.floor(360.0 * F.cos(F.radians(widest)) / step).cast("int"))
            column = F.floor((lon + 180.0) / (F.lit(360.0) / count))
            found += [F.concat_ws("|", F.lit("at"), row + dy, F.pmod(column + dx, count)) for dx in reach]
        placed = lat.isNotNull() & lon.isNotNull()
        region = F.concat_ws("|", F.lit("in"), F.lower(p + "admin1"))
        # a record with a place also meets, by region, those without one
        return F.array_distinct(F.concat(F.when(placed, F.array(*found)).otherwise(F.array().cast("array<string>")), F.when(F.col(p + "admin1").isNotNull(), F.array(region)).otherwise(F.array().cast("array<string>"))))

    a = side("a_").withColumn("bucket", F.explode(F.array(bucket("a_reference_date") - 1, bucket("a_reference_date")))).withColumn("cell", F.explode(cells("a_", False)))
    b = side("b_").withColumn("bucket", bucket("b_reference_date")).withColumn("cell", F.explode(cells("b_", True)))
    gap = F.datediff("a_reference_date", "b_reference_date")
    far = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    joined = a.join(b, (F.col("a_" + entity) == F.col("b_" + entity)) & (a["bucket"] == b["bucket"]) & (a["cell"] == b["cell"]))
    # two records with places meet by place cells alone, others by region alone
    by_place = F.col("a_lat").isNotNull() & F.col("b_lat").isNotNull()
    kept = joined.where((F.col("a_source_name") != F.col("b_source_name")) & ((gap > 0) | ((gap == 0) & (F.col("b_event_id") < F.col("a_event_id")))) & (gap <= days) & (by_place == a["cell"].startswith("at|")))
    scored = kept.select(F.col("a_event_id").alias("i"), F.col("b_event_id").alias("j"), gap.alias("days"), far.alias("km"), (F.lower("a_admin1") == F.lower("b_admin1")).alias("region")).dropDuplicates(["i", "j"])
    scored = scored.where((F.col("km") <= km) | (F.col("km").isNull() & F.col("region")))
    return scored.withColumn("score", F.round(0.5 * (1 - F.col("days") / days) + 0.5 * F.coalesce(1 - F.col("km") / km, F.lit(0.5)), 6))
