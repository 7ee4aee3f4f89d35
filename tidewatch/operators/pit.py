"""Point-in-time algebra: a record may influence a result stamped ``as_of`` iff it was available by then.

Null availability is never visible. Ties on availability go to the larger tie-break column, so results don't depend on
row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def filter_as_of(frame: DataFrame, as_of: str, available: str = "available_from", reference: str | None = None, low: str | None = None, high: str | None = None, keep_unknown: bool = False) -> DataFrame:
    """Rows available by ``as_of``, with inclusive bounds on event time; a missing column raises."""
    for name in filter(None, (available, reference)):
        if name not in frame.columns:
            raise KeyError(name)
    seen = F.col(available) <= day(as_of)
    out = frame.where(seen | F.col(available).isNull() if keep_unknown else seen)
    if reference and low:
        out = out.where(F.col(reference) >= day(low))
    if reference and high:
        out = out.where(F.col(reference) <= day(high))
    return out


def latest_as_of(frame: DataFrame, as_of: str, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key the row that is greatest in ``order`` among those available; one map-side combined aggregate."""
    best = F.max(F.struct(*order, *values)).alias("b")
    return filter_as_of(frame, as_of).groupBy(*keys).agg(best).select(*keys, *(f"b.{c}" for c in [*order, *values] if c not in keys))


def violations(frame: DataFrame, as_of: str, available: str = "available_from") -> DataFrame:
    """One row: how many rows became known after ``as_of``, and the worst date."""
    late = F.col(available) > day(as_of)
    return frame.agg(F.count_if(late).alias("n_violations"), F.max(F.when(late, F.col(available))).alias("worst"))


def assert_point_in_time(frame: DataFrame, as_of: str, available: str = "available_from") -> None:
    n, worst = violations(frame, as_of, available).first()
    if n:
        raise AssertionError(f"{n} rows were available only after {as_of}, the latest on {worst}")


def attach_availability(base: Column, lag_days: int, floor: str | None = None) -> Column:
    out = F.date_add(base, lag_days)
    return F.greatest(out, day(floor)) if floor else out


def grid(spark, start: str, end: str, step_days: int = 7) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(day(start), day(end), F.make_dt_interval(F.lit(step_days)))).alias("as_of"))


def vintage(tri: DataFrame, as_of: str) -> DataFrame:
    """Counts per (entity, week) as they were known at ``as_of``, by exact day of availability."""
    return tri.where((F.col("available_from") <= day(as_of)) & (F.col("week") <= day(as_of))).groupBy("entity_key", "week").agg(F.sum("outbreaks").alias("y"))


def between(frame: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Sum by entity over the half-open interval (start, end]."""
    return frame.where((F.col(column) > day(start)) & (F.col(column) <= day(end))).groupBy("entity_key").agg(F.sum("outbreaks").alias("total"))


def many_as_of(daily: DataFrame, grid_dates: DataFrame, weeks_back: int = 4) -> DataFrame:
    """Activity of the trailing weeks for every as-of date in one pass.

    A cell counts for the as-of dates between max(known, event) and event + window: each cell is exploded to the few
    grid dates of that interval by a calendar sequence, so there is no inequality join and no loop over dates.
    """
    first, last = grid_dates.agg(F.min("as_of").alias("g0"), F.max("as_of").alias("g1")).first()
    start = F.greatest("available_from", "reference_date", F.lit(first))
    aligned = F.date_add(F.lit(first), (F.ceil(F.datediff(start, F.lit(first)) / 7) * 7).cast("int"))
    stop = F.least(F.date_add("reference_date", 7 * weeks_back - 1), F.lit(last))
    hit = daily.where(aligned <= stop).select("entity_key", "outbreaks", F.explode(F.sequence(aligned, stop, F.expr("INTERVAL 7 DAYS"))).alias("as_of"))
    return hit.groupBy("entity_key", "as_of").agg(F.sum("outbreaks").alias("activity"))


def panel_as_of(store: DataFrame, as_of: str, features: Sequence[str] | None = None, lags: Sequence[int] = (1, 4), max_staleness_weeks: int = 12) -> DataFrame:
    """Wide row per entity: the latest usable value of each feature, its age in weeks, and published lagged values.

    One filter, one latest-revision aggregate, one conditional aggregate with the features named. Without ``features`` all
    features of the store take part; then their names, a few, are read first.
    """
    if features is None:
        features = sorted(r[0] for r in store.select("feature").where(F.col("feature").isNotNull()).distinct().collect())
    now = F.date_trunc("week", day(as_of)).cast("date")
    seen = filter_as_of(store, as_of).where((F.col("feature").isin(*features)) & (F.col("week") <= now) & (F.col("week") >= F.date_sub(now, 7 * max_staleness_weeks)))
    cells = seen.groupBy("entity_key", "week", "feature").agg(F.max_by("value", F.struct("available_from", "value")).alias("value"))
    columns = []
    for f in features:
        is_f = F.col("feature") == f
        columns += [F.max_by(F.when(is_f, F.col("value")), F.when(is_f, F.col("week"))).alias(f), (F.datediff(now, F.max(F.when(is_f, F.col("week")))) / 7).cast("int").alias(f"{f}_staleness_weeks")]
        columns += [F.max(F.when(is_f & (F.col("week") == F.date_sub(now, 7 * k)), F.col("value"))).alias(f"{f}_lag{k}") for k in lags]
    # a store without features has no cells
    return cells.groupBy("entity_key").agg(*columns) if columns else cells.select("entity_key").distinct()


def first_crossing(scores: DataFrame, events: DataFrame, threshold: float) -> DataFrame:
    """Earliest as-of date before each event at which the score reached the threshold."""
    joined = events.join(scores, "entity_key", "left").where(F.col("as_of") < F.col("event_date"))
    return joined.groupBy("entity_key", "event_date").agg(F.min(F.when(F.col("p") >= threshold, F.col("as_of"))).alias("first_alert"), F.round(F.max("p"), 6).alias("max_p"))


def by_latest(keys: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
