"""Rolling totals over trailing periods, kept as a versioned daily state.

The state holds, per (entity, day), the day's amount and the totals of every trailing window. A day's totals are
yesterday's totals plus today's arrivals minus the amount of the day that leaves the window. Raw rows are pre-aggregated
to days first; after that the data is bounded by entities x days, so one hot entity holding a third of the rows is one
short series. A state that is to be corrected runs on past an entity's last day until its windows are
empty, so that what arrives later finds yesterday's totals there.

Records that are delivered again with another value, or counted on another day or entity, are corrections: signed changes
of single days. ``correct_state`` writes the affected days again under a higher version - those between the corrected day
and the longest window's end, whether the state had them or not - and ``read_state`` takes the latest version of every
day, from an entity's first to its last counted day, quiet days included.

Defined cases: days without activity between an entity's first and last counted day have amount 0; an entity without a
counted day has no rows; the windows include their last day and start at the entity's first day; a correction may move an
entity's first or last day; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AMOUNT = "decimal(28,6)"


def latest_delivery(frame: DataFrame, key: str, arrival: str, value: str, *carry: str) -> DataFrame:
    """One row per key: the delivery with the latest arrival (null earliest; of equal arrivals the largest value).

    ``max`` of a struct combines map-side, so a key or a bucket holding many rows shrinks before the shuffle.
    """
    pick = F.max(F.struct(arrival, value, *carry)).alias("last")
    return frame.groupBy(key).agg(pick).select(key, *(f"last.{c}" for c in (arrival, value, *carry)))


def daily_amounts(frame: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    return (
        frame.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(entity).alias("entity_key"), F.col(day).alias("day"))
        .agg(F.sum(F.col(value).cast(AMOUNT)).alias("amount"), F.count("*").alias("n"))
    )


def deliveries(frame: DataFrame, key: str, arrival: str, value: str, *carry: str) -> DataFrame:
    """(key, first, last): the first and the latest delivery of every key as structs of (arrival, value, carry); a null
    arrival is the earliest, of equal arrivals the smallest value is first and the largest last."""
    row = F.struct(arrival, value, *carry)
    return frame.groupBy(key).agg(F.min(row).alias("first"), F.max(row).alias("last"))


def changes_of(pairs: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """(entity_key, day, delta, n_delta): what the latest deliveries change in the days that the first ones gave."""
    sides = F.array(F.struct(F.col("last").alias("r"), F.lit(1).alias("sign")), F.struct(F.col("first").alias("r"), F.lit(-1).alias("sign")))
    same = F.col(f"first.{value}").eqNullSafe(F.col(f"last.{value}")) & F.col(f"first.{entity}").eqNullSafe(F.col(f"last.{entity}")) & F.col(f"first.{day}").eqNullSafe(F.col(f"last.{day}"))
    rows = pairs.where(~same).select(F.explode(sides).alias("x")).select(F.col(f"x.r.{entity}").alias("entity_key"), F.col(f"x.r.{day}").alias("day"), F.col(f"x.r.{value}").cast(AMOUNT).alias("v"), "x.sign")
    counted = rows.where(F.col("entity_key").isNotNull() & F.col("day").isNotNull() & F.col("v").isNotNull())
    return counted.groupBy("entity_key", "day").agg(F.sum(F.col("v") * F.col("sign")).cast(AMOUNT).alias("delta"), F.sum("sign").alias("n_delta"))


def rolling_state(daily: DataFrame, windows: Sequence[int] = (7, 30), version: int = 1, run_out: bool = False) -> DataFrame:
    """The state over every day from an entity's first to its last; with ``run_out`` on until its windows are empty.

    The running sum of arrivals and expiries over the days of an entity is the recurrence
    ``total(t) = total(t-1) + amount(t) - amount(t-window)``.
    """
    by_entity = Window.partitionBy("entity_key").orderBy("day")
    days = (
        daily.groupBy("entity_key")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        .select("entity_key", F.explode(F.sequence("first_day", F.date_add("last_day", max(windows) - 1 if run_out else 0))).alias("day"))
    )
    filled = days.join(daily, ["entity_key", "day"], "left").select(
        "entity_key", "day", F.coalesce("amount", F.lit(0).cast(AMOUNT)).alias("amount"), F.coalesce("n", F.lit(0)).alias("n")
    )
    out = filled
    for width in windows:
        # on a gap-free calendar the day that leaves the window is the one ``width`` rows back
        expiring = F.coalesce(F.lag("amount", width).over(by_entity), F.lit(0).cast(AMOUNT))
        out = out.withColumn(f"change_{width}", F.col("amount") - expiring)
    running = by_entity.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(
        "entity_key",
        "day",
        "amount",
        "n",
        *(F.sum(f"change_{w}").over(running).cast(AMOUNT).alias(f"total_{w}") for w in windows),
        F.lit(version).alias("version"),
    )


def correct_state(state: DataFrame, changes: DataFrame, windows: Sequence[int] = (7, 30), version: int = 2) -> DataFrame:
    """State rows to write again after corrections: ``changes`` holds (entity_key, day, delta) and may hold n_delta, the change
    in the number of counted records.

    Only the affected dates come out (the corrected day until the longest window's end), under the new version; days that the
    state doesn't have start from 0, as nothing of the state reaches them.
    """
    widest = max(windows)
    counted = F.sum("n_delta") if "n_delta" in changes.columns else F.lit(0)
    deltas = changes.groupBy("entity_key", F.col("day").alias("changed")).agg(F.sum(F.col("delta").cast(AMOUNT)).alias("delta"), counted.alias("n_delta"))
    reach = deltas.select("entity_key", "changed", "delta", "n_delta", F.explode(F.sequence(F.lit(0), F.lit(widest - 1))).alias("age"))
    effect = (
        reach.withColumn("day", F.date_add("changed", F.col("age")))
        .groupBy("entity_key", "day")
        .agg(
            F.sum(F.when(F.col("age") == 0, F.col("delta"))).alias("amount_delta"),
            F.sum(F.when(F.col("age") == 0, F.col("n_delta"))).alias("count_delta"),
            *(F.sum(F.when(F.col("age") < w, F.col("delta"))).alias(f"delta_{w}") for w in windows),
        )
    )
    zero = F.lit(0).cast(AMOUNT)
    plus = lambda x, dx: (F.coalesce(x, zero) + F.coalesce(dx, zero)).cast(AMOUNT)
    return effect.join(state, ["entity_key", "day"], "left").select(
        "entity_key",
        "day",
        plus("amount", "amount_delta").alias("amount"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("count_delta", F.lit(0))).alias("n"),
        *(plus(f"total_{w}", f"delta_{w}").alias(f"total_{w}") for w in windows),
        F.lit(version).alias("version"),
    )


def read_state(*versions: DataFrame) -> DataFrame:
    """The state on read: of every (entity, day) the row with the highest version."""
    stacked = versions[0]
    for other in versions[1:]:
        stacked = stacked.unionByName(other)
    rest = [c for c in stacked.columns if c not in ("entity_key", "day", "version")]
    return stacked.groupBy("entity_key", "day").agg(F.max(F.struct("version", *rest)).alias("s")).select("entity_key", "day", "s.*")


def counted_days(state: DataFrame) -> DataFrame:
    """The state from each entity's first to its last day with a counted record; days that no version holds are quiet ones
    with totals of 0."""
    span = state.where(F.col("n") > 0).groupBy("entity_key").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = span.select("entity_key", F.explode(F.sequence("_a", "_b")).alias("day"))
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in state.dtypes if c not in ("entity_key", "day")}
    return calendar.join(state, ["entity_key", "day"], "left").withColumns(filled)
