"""Best representative of each duplicate group: one surviving value per field.

``truth_discovery`` alternates between votes for the values of every field of every group and the sources' reliability
(the negative logarithm of a source's share of disagreeing claims), until the weights settle; the highest-supported value
survives, and with it the best record that has it. Support is the sum of the supporting sources' weights. With the prior,
it is led by the best order among the supporters (tier, then date, then record): a prior so strong that no number of votes
outweighs it. Values then settle in the first round and the learned weights only tell how far each source agrees; without
the prior the weights decide. Where the order of trust is prescribed and only the records are asked for, votes and weights
change nothing: ``by_precedence`` gives the same records by one aggregate.

Votes and reliabilities are plain aggregates over (group, field, value, source), so a group or a source holding a third of
all rows is combined map-side. The weights of up to MAX_SOURCES sources travel as a literal, more are joined; only the
largest change of a weight and those weights reach the driver.

Defined cases: missing values neither vote nor survive; a field that no record has gives no row; where records are named,
groups of fewer than two are left out, as are groups without id; equal support goes to the smaller value; records without a source vote as
one unnamed source; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

MAX_ROUNDS, TOLERANCE = 12, 1e-4
#: Sources whose weights may travel as a literal.
MAX_SOURCES = 10_000


def by_precedence(records: DataFrame, group: str, record: str, present: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """(group, field, record) of the record each field survives from, for groups of at least two records, by the plain
    order; truth discovery with its prior must give the same.

    ``order``: columns ascending, the best first. One aggregate with one ordered minimum per field.
    """
    best = [F.min(F.when(there, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(record).alias("id")))).alias(f) for f, there in present.items()]
    picked = records.groupBy(group).agg(*best, F.min(record).alias("_low"), F.max(record).alias("_high")).where(F.col("_low") != F.col("_high"))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}.id").alias(record)) for f in present)))
    return picked.select(group, rows.alias("r")).select(group, "r.*").where(F.col(record).isNotNull())


def claims(records: DataFrame, group: str, source: str, values: Mapping[str, Column], record: str | None = None, order: Column | None = None) -> DataFrame:
    """(grp, field, source, value, n, best): how often each source claims a value, and the best (order, record) among those
    claims. Combined map-side. With ``record`` groups of one record are left out."""
    order = F.lit(0) if order is None else order
    name = F.lit(None).cast("string") if record is None else F.col(record)
    grouped = records.where(F.col(group).isNotNull())
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in values.items())))
    flat = grouped.select(F.col(group).alias("grp"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.struct(order.alias("o"), name.alias("id")).alias("b"), cells.alias("c"))
    said = flat.where(F.col("c.value").isNotNull()).groupBy("grp", "source", F.col("c.field").alias("field"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"), F.min("b").alias("best"))
    if record is None:
        return said
    several = grouped.groupBy(F.col(group).alias("grp")).agg(F.min(record).alias("_a"), F.max(record).alias("_b")).where("_a != _b").select("grp")
    return said.join(several, "grp", "left_semi")


def _weighted(claimed: DataFrame, weights: DataFrame) -> DataFrame:
    """Claims with the weight of their source."""
    rows = weights.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        return claimed.join(weights, "source")
    table = F.create_map(*(F.lit(x) for r in rows for x in (r["source"], float(r["weight"])))) if rows else F.lit(None).cast("map<string,double>")
    return claimed.withColumn("weight", F.try_element_at(table, F.col("source")))


def truth_discovery(claimed: DataFrame, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, use_prior: bool = False) -> tuple[DataFrame, DataFrame]:
    """(truths, reliabilities) of claims from ``claims``: truths are (grp, field, value, record, support)."""
    claimed = written(claimed)
    weights = written(claimed.select("source").distinct().select("source", F.lit(1.0).alias("weight")))
    truths = None
    for _ in range(rounds):
        votes = _weighted(claimed, weights).groupBy("grp", "field", "value").agg(F.round(F.sum("weight"), 9).alias("support"), F.min("best").alias("best"))
        # the best order (with the prior), the largest support, then the smaller value
        led = F.struct("best", (-F.col("support")).alias("s"), "value") if use_prior else F.struct((-F.col("support")).alias("s"), "value", "best")
        truths = written(votes.groupBy("grp", "field").agg(F.min(led).alias("t")).select("grp", "field", "t.value", F.col("t.best.id").alias("record"), (-F.col("t.s")).alias("support")))
        judged = claimed.join(truths.select("grp", "field", F.col("value").alias("truth")), ["grp", "field"])
        wrong = judged.groupBy("source").agg(F.sum(F.when(F.col("value") != F.col("truth"), 1.0).otherwise(0.0)).alias("wrong"), F.count("*").alias("made"))
        share = (F.col("wrong") + 0.5) / (F.col("made") + 1.0)
        settled = written(wrong.select("source", F.round(-F.log(share), 9).alias("weight")))
        change = settled.join(weights.withColumnRenamed("weight", "before"), "source").agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        weights = settled
        if change is None or change <= tolerance:
            break
    return truths, weights
