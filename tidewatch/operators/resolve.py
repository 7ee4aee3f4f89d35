"""Entity resolution of event records: explicit citations, then the best spatio-temporal match of each record.

Citations between records join their groups whatever their sources. Then every record, in the order of (disease, country,
date, id), may join the group of its best earlier match of another source, if the two groups share no source: two records
of one source are two outbreaks. That order matters only among records that citations and best matches connect at all, so
each connected set is merged on its own: a hot (disease, country) is never one task, and citations across blocks count.

Defined cases: records without id or date have no matches (without date they may still be cited); a citation of itself or
of an unknown or ambiguous id ties nothing; a group's name is its smallest record; an empty input gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import decide, geo
from tidewatch.session import written

DAYS, KM, LEAST_SCORE = 3, 10.0, 0.55


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root) for every row of ``vertices`` (v): the smallest vertex connected to it by ``edges`` (a, b).

    Each round takes the smallest root among neighbours and then the root's own root, so long chains halve; labels are
    written each round and only the number of changes reaches the driver."""
    both = written(edges.where(F.col("a") != F.col("b")).select("a", "b").unionByName(edges.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = both.select(F.col("a").alias("v")).distinct()
    labels = written(touched.select("v", F.col("v").alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        lower = labels.join(around, "v", "left").select("v", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        # the root's own smallest root, pre-aggregated: a root with many members is one row
        above = lower.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("down"))
        step = lower.join(above, lower["root"] == above["r"]).select("v", "root", F.least("low", "down").alias("low"))
        jump = step.join(lower.select(F.col("v").alias("low"), F.col("low").alias("next")), "low", "left")
        found = written(jump.select("v", F.col("root").alias("before"), F.least("low", F.coalesce("next", "low")).alias("root")))
        changed = found.where("before != root").limit(1).count()
        labels = found.select("v", "root")
        if not changed:
            break
    return vertices.join(labels, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def citations(events: DataFrame) -> DataFrame:
    """(a, b): records and the record they cite; ids that several records bear are ambiguous."""
    once = events.groupBy(F.col("event_id").alias("b")).agg(F.count("*").alias("n")).where("n = 1").select("b")
    return events.where(F.col("cited").isNotNull() & (F.col("cited") != F.col("event_id"))).select(F.col("event_id").alias("a"), F.col("cited").alias("b")).join(once, "b", "left_semi").select("a", "b").distinct()


def best_matches(events: DataFrame, days: int = DAYS, km: float = KM, least_score: float = LEAST_SCORE) -> DataFrame:
    """(i, j, days, km, score): each record's best earlier match; of equal scores the earliest, then the smallest id."""
    p = geo.interval_candidates(events, days, km).where(F.col("score") >= least_score)
    best = p.groupBy("i").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("days")).alias("d"), "j", "km")).alias("b"))
    return best.select("i", F.col("b.j").alias("j"), (-F.col("b.d")).alias("days"), F.col("b.km").alias("km"), (-F.col("b.s")).alias("score"))


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges one connected set in order. Rows: v, source, cite (group by citations), o (order), j, score, days, km."""
    parent = {v: c for v, c in zip(rows["v"], rows["cite"])}
    for c in set(rows["cite"]):
        parent.setdefault(c, c)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sources: dict = {}
    for v, s in zip(rows["v"], rows["source"]):
        sources.setdefault(root(v), set()).add(s)
    accepted = dict.fromkeys(rows["v"], False)
    for r in rows.sort_values(["disease", "country", "day", "v"], kind="stable").itertuples(index=False):
        if isinstance(r.j, str) and r.j in parent:
            a, b = root(r.v), root(r.j)
            if a != b and not sources[a] & sources[b]:
                low, high = min(a, b), max(a, b)
                parent[high] = low
                sources[low] = sources.pop(high) | sources[low] if high in sources else sources[low]
                accepted[r.v] = True
    names: dict = {}
    for v in rows["v"]:
        names.setdefault(root(v), []).append(v)
    smallest = {r: min(vs) for r, vs in names.items()}
    return pd.DataFrame({"v": rows["v"], "cluster": [smallest[root(v)] for v in rows["v"]], "accepted": [accepted[v] for v in rows["v"]]})


def resolve(events: DataFrame, days: int = DAYS, km: float = KM, least_score: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """(members, decisions). members: event_id, cluster (smallest record), canonical_event_id (CE- and its number in the
    order of clusters). decisions: rule, a, b, score, detail."""
    ids = events.select(F.col("event_id").alias("v")).distinct()
    cited = written(citations(events))
    best = written(best_matches(events, days, km, least_score))
    cites = components(ids, cited).withColumnRenamed("root", "cite")
    together = components(ids, cited.unionByName(best.select(F.col("i").alias("a"), F.col("j").alias("b")))).withColumnRenamed("root", "part")
    facts = events.select(F.col("event_id").alias("v"), F.col("source_name").alias("source"), "disease", "country", F.col("reference_date").alias("day"))
    rows = facts.join(cites, "v").join(together, "v").join(best.select(F.col("i").alias("v"), "j"), "v", "left")
    # a set of one record is its own cluster and never leaves the JVM
    several = rows.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    grouped = rows.join(several, "part", "left_semi").groupBy("part").applyInPandas(_merged, "v string, cluster string, accepted boolean")
    merged = written(grouped)
    members = ids.join(merged, "v", "left").select(F.col("v").alias("event_id"), F.coalesce("cluster", "v").alias("cluster"))
    named = decide.prefix_sum(members.select("cluster").distinct().withColumn("_1", F.lit(1)), ["cluster"], "_1", "n").select("cluster", F.format_string("CE-%07d", F.col("n") + 1).alias("canonical_event_id"))
    first = cited.select(F.lit("explicit_reference").alias("rule"), "a", "b", F.lit(1.0).alias("score"), F.concat(F.lit("source_event_id -> "), "b").alias("detail"))
    near = F.when(F.col("km").isNotNull(), F.format_string("%dd, %.1fkm", "days", "km")).otherwise(F.format_string("%dd, same admin1", "days"))
    second = best.join(merged.where("accepted").select(F.col("v").alias("i")), "i", "left_semi").select(F.lit("temporal_spatial_best_match").alias("rule"), F.col("i").alias("a"), F.col("j").alias("b"), F.round("score", 4).alias("score"), near.alias("detail"))
    return members.join(named, "cluster").select("event_id", "cluster", "canonical_event_id"), first.unionByName(second)


def summaries(events: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster: records, sources, first knowledge, officials, the anchor (official records, or all if a cluster has
    none), and the days by which unofficial records were known before the official ones (at least 0)."""
    rows = events.join(members.select("event_id", "cluster"), "event_id")
    official = lambda x: F.when(F.col("is_official"), F.col(x))
    g = rows.groupBy("cluster").agg(
        F.count("*").alias("n_records"), F.array_join(F.array_sort(F.collect_set("source_name")), ";").alias("sources"), F.min("available_from").alias("first_seen"), F.max("is_official").alias("has_official"),
        F.min(official("reference_date")).alias("_a"), F.min("reference_date").alias("_b"), F.max(official("reference_date")).alias("last_official"), F.avg(official("lat")).alias("lat"), F.avg(official("lon")).alias("lon"),
        F.min(official("available_from")).alias("official_seen"), F.sum(F.when(F.col("is_official"), F.col("outbreaks")).otherwise(0)).alias("burden"),
    )
    lead = F.when(F.col("official_seen").isNotNull(), F.greatest(F.lit(0), F.datediff("official_seen", "first_seen")))
    return g.select("cluster", "n_records", F.size(F.split("sources", ";")).cast("long").alias("n_sources"), "sources", "first_seen", F.coalesce("has_official", F.lit(False)).alias("has_official"), F.coalesce("_a", "_b").alias("anchor"), "last_official", "lat", "lon", "burden", lead.alias("lead_days"))


def suffixed(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``unique_key``: key#0, key#1 ... in the given order, for keys that may repeat."""
    return frame.withColumn("unique_key", F.concat(F.col(key), F.lit("#"), (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("string")))
