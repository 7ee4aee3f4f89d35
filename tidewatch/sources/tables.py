"""Typed domain views over the input tables, each with the SQL text of the same view for the checks.

Repeated deliveries of a record are merged first (one map-side combined aggregate on the record's id), codes are
compared in upper case without outer blanks, stand-ins are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.missing import FILLERS_SQL, code, coordinates, count_value, date_value, id_value, text_value
from tidewatch.operators import geo
from tidewatch.operators.late import week_of
from tidewatch.session import table

_OK = "BETWEEN DATE '1970-01-02' AND DATE '2099-12-30'"
_FILL = FILLERS_SQL
_PLACED = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)"


def events(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    lat, lon = coordinates(c("latitude"), c("longitude"))
    return (
        table(spark, d, "canonical_events")
        .groupBy(code(c("event_id")).alias("event_id"))
        .agg(
            F.min(code(c("country_iso3"))).alias("country"),
            F.min(code(c("disease"))).alias("disease"),
            F.min(date_value(c("reference_date"))).alias("reference_date"),
            F.min(date_value(c("available_from"))).alias("available_from"),
            F.min(date_value(c("onset_date"))).alias("onset_date"),
            F.min(date_value(c("notification_date"))).alias("notification_date"),
            F.min(date_value(c("publication_date"))).alias("publication_date"),
            F.min(F.trim("source_name")).alias("source_name"),
            F.min(F.lower(F.trim("species"))).alias("species"),
            F.max(count_value(c("cases"))).alias("cases"),
            F.max(count_value(c("deaths"))).alias("deaths"),
            F.coalesce(F.max(count_value(c("outbreaks"))), F.lit(1)).cast("long").alias("outbreaks"),
            F.max("is_official").alias("is_official"),
            F.min(text_value(c("admin1"))).alias("admin1"),
            F.min(id_value(c("source_event_id"))).alias("cited"),
            F.max(lat).alias("lat"),
            F.max(lon).alias("lon"),
        )
        .where((c("event_id") != "") & c("reference_date").isNotNull() & c("available_from").isNotNull())
        .withColumn("entity_key", F.concat_ws("|", "country", "disease"))
        .withColumn("week", week_of(c("reference_date")))
        .withColumn("available_week", week_of(c("available_from")))
    )


EVENTS = f"""ev AS (
  SELECT *, country || '|' || disease AS entity_key, CAST(date_trunc('week', reference_date) AS DATE) AS week, CAST(date_trunc('week', available_from) AS DATE) AS available_week FROM (
  SELECT upper(trim(event_id)) AS event_id, min(upper(trim(country_iso3))) AS country, min(upper(trim(disease))) AS disease,
    min(CASE WHEN reference_date {_OK} THEN reference_date END) AS reference_date, min(CASE WHEN available_from {_OK} THEN available_from END) AS available_from,
    min(CASE WHEN onset_date {_OK} THEN onset_date END) AS onset_date, min(CASE WHEN notification_date {_OK} THEN notification_date END) AS notification_date,
    min(CASE WHEN publication_date {_OK} THEN publication_date END) AS publication_date, min(trim(source_name)) AS source_name, min(lower(trim(species))) AS species,
    max(CASE WHEN cases >= 0 THEN cases END) AS cases, max(CASE WHEN deaths >= 0 THEN deaths END) AS deaths,
    coalesce(max(CASE WHEN outbreaks >= 0 THEN outbreaks END), 1) AS outbreaks, bool_or(is_official) AS is_official,
    min(CASE WHEN lower(trim(admin1)) NOT IN {_FILL} THEN trim(admin1) END) AS admin1,
    min(CASE WHEN regexp_matches(source_event_id, '[0-9]') AND NOT regexp_matches(trim(source_event_id), '^0+$') AND lower(trim(source_event_id)) NOT IN {_FILL} THEN upper(trim(source_event_id)) END) AS cited,
    max(CASE WHEN {_PLACED} THEN latitude END) AS lat, max(CASE WHEN {_PLACED} THEN longitude END) AS lon
  FROM canonical_events GROUP BY 1) WHERE event_id <> '' AND reference_date IS NOT NULL AND available_from IS NOT NULL)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    last = F.max(F.struct(date_value(c("available_from")).alias("a"), c("value").alias("v"), c("denominator").alias("n"))).alias("l")
    return (
        table(spark, d, "signal_records")
        .groupBy(code(c("signal_id")).alias("signal_id"))
        .agg(
            F.min(code(c("country_iso3"))).alias("country"),
            F.min(code(c("disease"))).alias("disease"),
            F.min(date_value(c("reference_date"))).alias("reference_date"),
            F.min(F.lower(F.trim("signal_name"))).alias("signal_name"),
            F.min(F.trim("source_name")).alias("source_name"),
            F.max("reliability").alias("reliability"),
            last,
        )
        .select("*", c("l.a").alias("available_from"), F.when(~F.isnan("l.v") & (c("l.v") > -9), c("l.v")).alias("value"))
        .drop("l")
        .where(c("reference_date").isNotNull() & c("available_from").isNotNull() & c("value").isNotNull())
        .withColumn("entity_key", F.concat_ws("|", "country", "disease"))
        .withColumn("week", week_of(c("reference_date")))
    )


SIGNALS = f"""sg AS (
  SELECT * EXCLUDE (l), country || '|' || disease AS entity_key, CAST(date_trunc('week', reference_date) AS DATE) AS week FROM (
  SELECT * , l.a AS available_from, CASE WHEN NOT isnan(l.v) AND l.v > -9 THEN l.v END AS value FROM (
  SELECT upper(trim(signal_id)) AS signal_id, min(upper(trim(country_iso3))) AS country, min(upper(trim(disease))) AS disease,
    min(CASE WHEN reference_date {_OK} THEN reference_date END) AS reference_date, min(lower(trim(signal_name))) AS signal_name, min(trim(source_name)) AS source_name, max(reliability) AS reliability,
    arg_max(struct_pack(a := available_from, v := value), struct_pack(a := coalesce(available_from, DATE '0001-01-01'), v := coalesce(value, '-infinity'::DOUBLE))) AS l
  FROM signal_records GROUP BY 1)) WHERE reference_date IS NOT NULL AND available_from IS NOT NULL AND value IS NOT NULL)"""


def covariates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return (
        table(spark, d, "covariate_records")
        .select(
            "covariate_id", code(c("country_iso3")).alias("country"), date_value(c("reference_date")).alias("reference_date"),
            date_value(c("available_from")).alias("available_from"), F.lower(F.trim("variable")).alias("variable"), F.when(~F.isnan("value"), c("value")).alias("value"),
        )
        .where(c("reference_date").isNotNull() & (c("available_from") >= c("reference_date")) & c("value").isNotNull())
        .distinct()
    )


COVARIATES = """cv AS (
  SELECT DISTINCT covariate_id, upper(trim(country_iso3)) AS country, reference_date, available_from, lower(trim(variable)) AS variable, value
  FROM covariate_records WHERE reference_date IS NOT NULL AND available_from >= reference_date AND NOT isnan(value))"""


def triangle(spark: SparkSession, d: str) -> DataFrame:
    """Reporting triangle of official counts by event week and week of knowledge."""
    return (
        events(spark, d)
        .groupBy("entity_key", "country", "disease", "week", "available_week")
        .agg(F.sum("outbreaks").alias("count"))
        .withColumn("delay_weeks", F.greatest(F.lit(0), F.floor(F.datediff("available_week", "week") / 7)).cast("int"))
    )


TRIANGLE = EVENTS + """, tri AS (
  SELECT entity_key, country, disease, week, available_week, CAST(sum(outbreaks) AS BIGINT) AS count, greatest(0, CAST(floor((available_week - week) / 7) AS INT)) AS delay_weeks
  FROM ev GROUP BY ALL)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """Dense weekly series of final counts: every entity x every week between the first and last of all."""
    tri = triangle(spark, d)
    span = tri.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    weeks = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    sums = tri.groupBy("entity_key", "week").agg(F.sum("count").alias("y"))
    grid = tri.select("entity_key").distinct().crossJoin(F.broadcast(weeks))  # calendar weeks: bounded by time
    return grid.join(sums, ["entity_key", "week"], "left").select("entity_key", "week", F.coalesce("y", F.lit(0)).cast("double").alias("y"))


SERIES = TRIANGLE + """, weeks AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT min(week) AS a, max(week) AS b FROM tri)),
ser AS (SELECT g.entity_key, g.week, CAST(coalesce(s.y, 0) AS DOUBLE) AS y FROM (SELECT DISTINCT entity_key, w.week FROM tri, weeks w) g
  LEFT JOIN (SELECT entity_key, week, sum(count) AS y FROM tri GROUP BY 1, 2) s USING (entity_key, week))"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """The country dimension: centroid of its outbreaks, neighbours (the three nearest countries stand in for the lists of
    a configuration) and surveillance tier (by the last letter of the code, as a stand-in)."""
    at = events(spark, d).where(F.col("country").rlike("^[A-Z]{3}$")).groupBy("country").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("lat").alias("n"))
    near = geo.pairs(at).groupBy(F.col("a").alias("country")).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("km", 6).alias("km"), "b"))), 1, 3).alias("near"))
    tier = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.ascii(F.substring("country", 3, 1)) % 3 + 1)
    return at.join(near, "country", "left").select("country", "lat", "lon", "n", F.coalesce(F.col("near.b"), F.array().cast("array<string>")).alias("neighbours"), tier.alias("tier"))


KM_SQL = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2))))"
PLACES = f"""pl AS (SELECT country, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(lat) AS n, ['high', 'medium', 'low'][ascii(substr(country, 3, 1)) % 3 + 1] AS tier FROM ev WHERE regexp_full_match(country, '[A-Z]{{3}}') GROUP BY 1),
kms AS (SELECT a.country AS a, b.country AS b, {KM_SQL} AS km FROM pl a, pl b WHERE a.country <> b.country AND a.lat IS NOT NULL AND b.lat IS NOT NULL),
nb AS (SELECT a, b FROM kms QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) <= 3), adj AS (SELECT a, b FROM nb UNION SELECT b, a FROM nb),
kr AS (SELECT kms.a, kms.b, km, CASE WHEN adj.a IS NULL THEN 0 ELSE 1 END AS border, exp(-((km / 900) ** 2)) + 0.35 * (CASE WHEN adj.a IS NULL THEN 0 ELSE 1 END) AS raw FROM kms LEFT JOIN adj ON adj.a = kms.a AND adj.b = kms.b)"""


def vintage_sql(as_of: str) -> str:
    """CTEs of the vintage at one as-of date: vn(entity_key, country, disease, week, y, k, back), back 1 being the as-of week."""
    return TRIANGLE + f""", sp AS (SELECT min(week) AS w0, least(CAST(date_trunc('week', DATE '{as_of}') AS DATE), max(week)) AS wn FROM tri),
known AS (SELECT DISTINCT entity_key, country, disease FROM tri, sp WHERE available_week <= DATE '{as_of}' AND week <= wn),
cal AS (SELECT CAST(unnest(generate_series(w0::TIMESTAMP, wn::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM sp),
vis AS (SELECT n.entity_key, n.country, n.disease, c.week, CAST(coalesce(sum(t.count), 0) AS DOUBLE) AS y FROM known n CROSS JOIN cal c LEFT JOIN tri t ON t.entity_key = n.entity_key AND t.week = c.week AND t.available_week <= DATE '{as_of}' GROUP BY ALL),
vn AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY week) AS k, row_number() OVER (PARTITION BY entity_key ORDER BY week DESC) AS back FROM vis)"""
