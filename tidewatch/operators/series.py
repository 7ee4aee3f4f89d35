"""Window functions and recurrences over weekly series.

Recurrences run inside the JVM: the ordered series of one entity is an array bounded by the calendar (weeks), folded by
a higher-order function with a struct as accumulator.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ordered(frame: DataFrame, key: str = "entity_key", order: str = "week", value: str = "y") -> DataFrame:
    """(key, s): the values of each series in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return frame.groupBy(key).agg(pairs.alias("s"))


def ewma(values: Column, alpha: float) -> Column:
    """Final level; the first value starts it, a missing value carries it."""
    start = F.element_at(values, 1)
    return F.aggregate(values, start, lambda level, x: F.when(x.isNull(), level).otherwise(alpha * x + (1 - alpha) * level))


def ewma_scores(values: Column, alpha: float = 0.3, min_sd: float = 0.5) -> Column:
    """Array of standardised residuals against the running level; level and variance are updated after scoring."""
    head = F.slice(values, 1, 8)
    n = F.size(head).cast("double")
    mean = F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(head, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    start = F.struct(F.element_at(values, 1).alias("level"), F.greatest(spread, F.lit(min_sd**2)).alias("var"), F.array().cast("array<double>").alias("z"))

    def step(a, x):
        residual = x - a["level"]
        score = residual / F.greatest(F.sqrt(a["var"]), F.lit(min_sd))
        return F.struct(
            (alpha * x + (1 - alpha) * a["level"]).alias("level"),
            ((1 - alpha) * a["var"] + alpha * residual * residual).alias("var"),
            F.concat(a["z"], F.array(score)).alias("z"),
        )

    return F.aggregate(values, start, step, lambda a: a["z"])


def ewma_last(values: Column) -> Column:
    """The last of ``ewma_scores`` (alpha 0.3, smallest deviation 0.5) of each array; null for an empty or null one."""
    return F.pandas_udf(_ewma_last, DoubleType())(values)


def _ewma_last(values: pd.Series) -> pd.Series:
    """The recurrence runs over the weeks for all rows of an Arrow batch at once, which measured ten times faster than folding
    each array in the JVM."""
    alpha, min_sd = 0.3, 0.5
    rows = [np.asarray(v, dtype=float) if v is not None else np.zeros(0) for v in values]
    n = np.array([len(r) for r in rows])
    out = np.full(len(rows), np.nan)
    if len(rows) and n.max() > 0:
        x = np.zeros((n.max(), len(rows)))
        for j, r in enumerate(rows):
            x[: len(r), j] = r
        head = [r[:8] for r in rows]
        level, var = x[0].copy(), np.array([max(h.var(), min_sd**2) if len(h) else 1.0 for h in head])
        for t in range(len(x)):
            on = t < n
            residual = x[t] - level
            out = np.where(on, residual / np.maximum(np.sqrt(var), min_sd), out)
            level, var = np.where(on, alpha * x[t] + (1 - alpha) * level, level), np.where(on, (1 - alpha) * var + alpha * residual**2, var)
    return pd.Series(out)


def holt_damped(values: Column, horizon: int, alpha: float = 0.35, beta: float = 0.15, phi: float = 0.85) -> Column:
    """Damped-trend forecast on log1p counts, ``horizon`` steps ahead, back on the count scale."""
    logs = F.transform(values, lambda x: F.log1p(x))
    start = F.struct(F.element_at(logs, 1).alias("level"), F.lit(0.0).alias("trend"))

    def step(a, x):
        level = alpha * x + (1 - alpha) * (a["level"] + phi * a["trend"])
        return F.struct(level.alias("level"), (beta * (level - a["level"]) + (1 - beta) * phi * a["trend"]).alias("trend"))

    damp = sum(phi**i for i in range(1, horizon + 1))
    rest = F.slice(logs, 2, F.greatest(F.size(logs) - 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda a: F.greatest(F.lit(0.0), F.expm1(a["level"] + damp * a["trend"])))


def anomaly_block(frame: DataFrame, key: str, order: str, value: str, alpha: float = 0.3, baseline: int = 8) -> DataFrame:
    """(key, order, volume, abnormal_volume, acceleration, baseline_ratio) of weekly counts: log volume, its EWMA z-score, its
    second difference, and the count over the median of the ``baseline`` rows before (of all rows while there are fewer than
    two), clipped to [0, 25]. One row of the global median is joined to all."""
    counted = frame.groupBy(value).agg(F.count("*").alias("_n"))  # counts are few distinct values
    middle = counted.agg(F.percentile(value, F.lit(0.5), F.col("_n")).alias("_g"))
    s = ordered(frame.withColumn("_l", F.log1p(value)), key, order, "_l")
    z = s.select(key, F.inline(F.arrays_zip(F.col("s.o").alias(order), ewma_scores(F.col("s.v"), alpha).alias("abnormal_volume"))))
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(-baseline, -1)
    near = F.when(F.count(value).over(before) >= 2, F.percentile(value, F.lit(0.5)).over(before))
    log = F.log1p(value)
    rows = frame.select(key, order, value, near.alias("_m"), log.alias("volume"), F.coalesce(log - 2 * F.lag(log).over(w) + F.lag(log, 2).over(w), F.lit(0.0)).alias("acceleration"))
    joined = rows.crossJoin(F.broadcast(middle)).join(z, [key, order])  # one row
    ratio = F.least(F.lit(25.0), F.greatest(F.lit(0.0), (F.col(value) + 1) / (F.coalesce("_m", "_g") + 1)))
    return joined.select(key, order, "volume", F.coalesce("abnormal_volume", F.lit(0.0)).alias("abnormal_volume"), "acceleration", ratio.alias("baseline_ratio"))


def with_robust_z(frame: DataFrame, value: str, *keys: str, name: str = "z") -> DataFrame:
    """(x - median) / max(1.4826 * MAD, 0.5), medians over the unordered group."""
    w = Window.partitionBy(*keys)
    mid = frame.withColumn("_m", F.median(value).over(w))
    mad = mid.withColumn("_d", F.median(F.abs(F.col(value) - F.col("_m"))).over(w))
    return mad.withColumn(name, (F.col(value) - F.col("_m")) / F.greatest(1.4826 * F.col("_d"), F.lit(0.5))).drop("_m", "_d")


def cusum(frame: DataFrame, z: str, key: str, order: str, k: float = 0.5) -> DataFrame:
    """S(t) = max(0, S(t-1) + z - k), in closed form: the cumulative sum less its running minimum (at most 0)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = frame.withColumn("_c", F.sum(F.col(z) - k).over(w))
    return run.withColumn("s", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).drop("_c")


def rank_shares(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): average rank of ties over the number of rows (not SQL's percent_rank), made over the distinct
    values of each group, so that repeated values cost one row."""
    counted = frame.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select(*keys, value, ((below + (F.col("_n") + 1) / 2) / F.sum("_n").over(group)).alias(name))


def episodes(frame: DataFrame, key: str, date: str, gap_days: int = 56) -> DataFrame:
    """Numbers episodes: a new one starts at the first date or ``gap_days`` or more after the previous date."""
    w = Window.partitionBy(key).orderBy(date)
    new = F.coalesce((F.datediff(F.col(date), F.lag(date).over(w)) >= gap_days).cast("int"), F.lit(1))
    return frame.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def trailing(y: str, key: str, order: str, n: int, fn=F.sum) -> Column:
    return fn(y).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0))
