"""Decisions on what was known at an as-of date: nowcast core, gap, growth, priority, levels, and scores of predictions.

Everything is an expression over the vintage series of an entity (``vintage.Vintages``) and small dimensions; what became
known after the as-of date takes no part. Labels alone look ahead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import series, vintage
from tidewatch.operators.vintage import Vintages
from tidewatch.session import checkpointed, parallelism

LEVELS = S.LEVELS
#: Half width of a 90 % interval in standard deviations.
Z90 = 1.6448536


def band(value: Column, bands: Sequence[tuple[str, float | None]]) -> Column:
    """The highest band whose lower bound is reached; null, NaN and values below all bounds get the first."""
    out = F.lit(bands[0][0])
    for name, low in bands[1:]:
        out = F.when((value >= low) & ~F.isnan(value.cast("double")), F.lit(name)).otherwise(out)
    return out


def alert_level(p: Column) -> Column:
    return band(p, LEVELS)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def priority(p: Column, gap: Column, latent: Column, growth: Column, intelligence: Column) -> Column:
    w = S.PRIORITY
    norm = 1 - F.exp(-F.greatest(latent, F.lit(0.0)) / 5.0)
    return clip(w["probability"] * p + w["gap"] * gap + w["latent"] * norm + w["growth"] * clip(growth, 0.0, 1.0) + w["intelligence"] * sigmoid(intelligence), 0.0, 1.0)


def growth(forecast: Column, latent: Column) -> Column:
    """Sigmoid of the relative growth of the forecast over the latent level; 0 without forecast or latent level."""
    return F.when(forecast.isNotNull() & (latent > 0), sigmoid(clip(forecast / F.greatest(latent, F.lit(1e-6)) - 1, -1.0, 3.0))).otherwise(0.0)


def unreported(observed: Column, p: Column) -> Column:
    """Expected count still to be reported: the mean of the negative binomial posterior predictive."""
    return (S.PRIOR_SHAPE + observed) * (1 - p) / (S.PRIOR_RATE + p)


def unreported_variance(observed: Column, p: Column) -> Column:
    q = (S.PRIOR_RATE + p) / (S.PRIOR_RATE + 1)
    return (S.PRIOR_SHAPE + observed) * (1 - q) / (q * q)


def confidence(p: Column, point: Column, width: Column, n: Column) -> Column:
    return clip(0.5 * clip(p, 0.0, 1.0) + 0.3 / (1 + width / F.greatest(point, F.lit(1.0))) + 0.2 * n / (n + 50.0), 0.0, 1.0)


def delay_shares(events: DataFrame, grid: DataFrame) -> DataFrame:
    """(as_of, disease, n, shares): shares[d] of the delays of at most d days, d = 0 .. MAX_DELAY_DAYS, among the records
    known by the as-of date that are old enough for every such delay to be known; disease null: all diseases."""
    lag = F.datediff("available_from", "reference_date")
    # counts by reference date and delay first: bounded by the calendar and the diseases
    counted = events.where(lag.between(0, S.MAX_DELAY_DAYS)).groupBy("disease", "reference_date", lag.alias("d")).agg(F.count("*").alias("n"))
    old = counted.join(F.broadcast(grid), F.col("reference_date") <= F.date_sub("as_of", S.MAX_DELAY_DAYS))  # a calendar
    by = old.groupBy("as_of", "disease", "d").agg(F.sum("n").alias("n"))
    both = by.unionByName(by.groupBy("as_of", "d").agg(F.sum("n").alias("n")).withColumn("disease", F.lit(None).cast("string")))
    per = both.groupBy("as_of", "disease").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(S.MAX_DELAY_DAYS)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)))
    run = F.transform(counts, lambda x, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    return per.select("as_of", "disease", "n", F.transform(run, lambda x: x / F.col("n")).alias("shares"))


def nowcast_core(v: Vintages, events: DataFrame) -> DataFrame:
    """Analytic nowcast of the last NOWCAST_WEEKS weeks: adds n_delays and ``weeks``, an array (oldest first) of
    (back, o, p, u, v): weeks back, observed count, reporting probability, expected unreported count and its variance.

    The reporting probability comes from the delays of the entity's disease (of all diseases if it has none), measured
    from the week's midpoint, never below MIN_REPORTED."""
    delays = delay_shares(events, v.grid)
    own = delays.where(F.col("disease").isNotNull()).select("as_of", "disease", F.col("shares").alias("own"), F.col("n").alias("own_n"))
    all_ = delays.where(F.col("disease").isNull()).select("as_of", F.col("shares").alias("all"), F.col("n").alias("all_n"))
    known = v.frame.join(own, ["as_of", "disease"], "left").join(all_, ["as_of"], "left").withColumn("shares", F.coalesce("own", "all")).withColumn("n_delays", F.coalesce("own_n", "all_n", F.lit(0)))
    since = F.datediff("as_of", vintage.week_start(F.col("as_of")))

    def week(back: Column) -> Column:
        observed = F.coalesce(F.try_element_at("s", F.size("s") - back), F.lit(0.0))
        elapsed = since + 7 * back - S.MIDPOINT_DAYS
        share = F.coalesce(F.try_element_at("shares", F.least(elapsed, F.lit(S.MAX_DELAY_DAYS)) + 1), F.lit(1.0))
        p = F.when(elapsed < 0, S.MIN_REPORTED).otherwise(clip(share, S.MIN_REPORTED, 1.0))
        return F.struct(back.alias("back"), observed.alias("o"), p.alias("p"), unreported(observed, p).alias("u"), unreported_variance(observed, p).alias("v"))

    backs = F.filter(F.sequence(F.lit(S.NOWCAST_WEEKS - 1), F.lit(0), F.lit(-1)), lambda b: b < F.size("s"))
    return known.withColumn("weeks", F.transform(backs, week)).drop("own", "own_n", "all", "all_n", "shares")


def recent(nowcast: DataFrame, weeks: int = 4) -> DataFrame:
    """Sums of the last weeks of a nowcast: observed, hidden, latent, gap, width of the 90 % interval, and the reporting
    probability of the window's middle week."""
    over = lambda f: F.aggregate(F.filter("weeks", lambda x: x["back"] < weeks), F.lit(0.0), lambda a, x: a + x[f])
    cols = nowcast.withColumn("observed", over("o")).withColumn("hidden", over("u")).withColumn("width", 2 * Z90 * F.sqrt(over("v")))
    cols = cols.withColumn("latent", F.col("observed") + F.col("hidden"))
    gap = F.when(F.col("latent") > 1e-9, clip(F.col("hidden") / F.col("latent"), 0.0, 1.0)).otherwise(0.0)
    middle = F.element_at("weeks", F.floor(F.size("weeks") / 2).cast("int") + 1)
    return cols.withColumn("gap", gap).withColumn("reporting_probability", middle["p"])


def labels(tri: DataFrame, v: Vintages, cutoff: str) -> DataFrame:
    """Early-warning labels of the vintages' (entity, as-of date): does the burden published within LABEL_DAYS reach the
    larger of 1 and ESCALATION times what the run rate of the last RUN_RATE_WEEKS visible weeks predicts?"""
    published = tri.groupBy("entity_key", "available_week").agg(F.sum("count").alias("f"))
    # a cell is in the horizon of the few as-of dates of the LABEL_DAYS before it was known
    days = F.sequence(F.date_sub("available_week", S.LABEL_DAYS), F.date_sub("available_week", 1))
    ahead = published.select("entity_key", "f", F.explode(days).alias("as_of")).join(F.broadcast(v.grid), "as_of").groupBy("entity_key", "as_of").agg(F.sum("f").alias("future"))
    s = F.col("s")
    rate = vintage.last_mean(s, S.RUN_RATE_WEEKS)
    threshold = F.greatest(F.lit(1.0), S.ESCALATION * rate * (S.LABEL_DAYS / 7.0))
    found = v.frame.select("entity_key", "as_of", rate.alias("current_run_rate"), threshold.alias("label_threshold"), (vintage.last_sum(s, S.RUN_RATE_WEEKS) <= 0).cast("int").alias("is_quiet"))
    found = found.join(ahead, ["entity_key", "as_of"], "left").withColumn("future_published", F.coalesce("future", F.lit(0)).cast("double")).drop("future")
    label = (F.col("future_published") >= F.col("label_threshold")).cast("int")
    return found.select(
        "entity_key", "as_of", label.alias("label"), (F.date_add("as_of", S.LABEL_DAYS) <= F.lit(cutoff).cast("date")).alias("label_observable"),
        "future_published", "label_threshold", "current_run_rate", "is_quiet", (label * F.col("is_quiet")).alias("is_emergence"),
    )


def scores(v: Vintages, events: DataFrame, intelligence: DataFrame) -> DataFrame:
    """Everything a decision needs per (entity, as-of date): p, nowcast sums, forecast, growth, intel, priority, level.

    p is the score 1 - exp(-visible burden of 26 weeks / 3), the stand-in where no classifier is fitted.
    ``intelligence``: (entity_key, as_of, intel)."""
    s = F.col("s")
    cols = recent(nowcast_core(v, events)).withColumn("p", 1 - F.exp(-vintage.last_sum(s, 26) / 3.0))
    cols = cols.withColumn("forecast", series.holt_damped(vintage.last(s, 52), 2))
    cols = cols.join(intelligence, ["entity_key", "as_of"], "left").withColumn("intel", F.coalesce("intel", F.lit(0.0)))
    cols = cols.withColumn("growth", growth(F.col("forecast"), F.col("latent")))
    cols = cols.withColumn("priority", priority(F.col("p"), F.col("gap"), F.col("latent"), F.col("growth"), F.col("intel")))
    cols = cols.withColumn("level", alert_level(F.col("p"))).withColumn("confidence", confidence(F.col("reporting_probability"), F.col("latent"), F.col("width"), F.col("n_delays")))
    return cols.drop("s", "weeks")


def hysteresis(frame: DataFrame, key: str, order: str, p: str, persistence: int = S.PERSISTENCE_WEEKS) -> DataFrame:
    """(key, order, p, raw level, level): a level rises when p reaches a band plus the escalation margin, falls only when p
    is below the bound of the level it holds by more than the other margin, and changes only after ``persistence`` weeks
    in a row that ask for it. The ordered weeks of a key are folded as one array, bounded by the calendar."""
    lows = F.array(*(F.lit(low or 0.0) for _, low in LEVELS))
    index = lambda x, margin: F.size(F.filter(lows, lambda low: x >= low + margin)) - 1
    rows = frame.where(F.col(p).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(p).alias("p")))).alias("r"))
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("want"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        up = F.greatest(index(x["p"], F.lit(S.ESCALATE_MARGIN)), F.lit(0))
        down = F.greatest(index(x["p"], F.lit(-S.DEESCALATE_MARGIN)), F.lit(0))
        asked = F.when(up > a["level"], up).when(down < a["level"], down).otherwise(a["level"])
        run = F.when(asked == a["level"], 0).when(asked == a["want"], a["run"] + 1).otherwise(1)
        level = F.when(run >= persistence, asked).otherwise(a["level"])
        return F.struct(level.cast("int").alias("level"), asked.cast("int").alias("want"), run.cast("int").alias("run"), F.concat(a["out"], F.array(level.cast("int"))).alias("out"))

    levels = F.aggregate("r", start, step, lambda a: a["out"])
    flat = rows.select(key, F.inline(F.arrays_zip(F.col("r.o").alias("o"), F.col("r.p").alias("p"), levels.alias("l"))))
    names = F.array(*(F.lit(name) for name, _ in LEVELS))
    return flat.select(key, F.col("o").alias(order), F.col("p").alias(p), alert_level(F.col("p")).alias("raw_level"), F.element_at(names, F.col("l") + 1).alias("level"))


def gated(level: Column, n_eff: Column) -> Column:
    """A level that too few independent voices support becomes the highest one they do."""
    n = F.coalesce(n_eff, F.lit(0.0))
    return (
        F.when((level == "CRITICAL") & (n < S.GATES["ALERT"]), F.lit("WATCH"))
        .when((level == "CRITICAL") & (n < S.GATES["CRITICAL"]), F.lit("ALERT"))
        .when((level == "ALERT") & (n < S.GATES["ALERT"]), F.lit("WATCH"))
        .otherwise(level)
    )


def direction(contribution: Column) -> Column:
    return F.when(contribution > 1e-6, "increases_risk").when(contribution < -1e-6, "decreases_risk").otherwise("neutral")


def interpretation(family: Column, with_: Column, without: Column) -> Column:
    delta = with_ - without
    percent = lambda x: F.concat(F.format_string("%.0f", F.bround(x * 100, 0)), F.lit("%"))
    barely = F.concat(F.lit("Removing "), family, F.lit(" barely changes the assessment."))
    change = F.concat(F.lit("Without "), family, F.lit(" evidence the probability "), F.when(delta > 0, "falls").otherwise("rises"), F.lit(" from "), percent(with_), F.lit(" to "), percent(without), F.lit("."))
    return F.when(F.abs(delta) < 0.01, barely).otherwise(change)


def prefix_sum(frame: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows that come before in ``order`` (a total order), without a window over
    all rows: rows are range-partitioned, the partitions' sums give offsets, and a window inside each partition the rest."""
    spark = frame.sparkSession
    # written once: the offsets and the rows must come from the same partitions
    parts = checkpointed(frame.repartitionByRange(parallelism(spark), *order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.sum(value).alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + inside).drop("_p", "_before")


def ranks(frame: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Adds the ordinal rank from 0 by (value, key) over all rows; NaN and null rank lowest."""
    lowest = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
    return prefix_sum(frame.withColumn("_v", lowest).withColumn("_one", F.lit(1)), ["_v", key], "_one", name).drop("_v", "_one")


def crps_weights(scores: DataFrame, member: str, score: str, least_weight: float = 0.05, temperature: float = 0.5) -> DataFrame:
    """(member, weight): softmax of the scores (lower is better) with a floor. A member without a finite score gets the
    floor; if none has one, all weigh the same. One row per member, so unpartitioned windows see a handful of rows."""
    w = Window.partitionBy()
    x = F.col(score).cast("double")
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    n = F.count("*").over(w)
    scale = F.greatest(F.abs(F.avg("_x").over(w)) * temperature, F.lit(1e-9))
    raw = F.coalesce(F.exp(-(F.col("_x") - F.min("_x").over(w)) / scale), F.lit(0.0))
    steps = scores.select(member, finite.alias("_x")).withColumn("_r", raw).withColumn("_n", n)
    steps = steps.withColumn("_t", F.sum("_r").over(w)).withColumn("_w", F.when(F.col("_t") <= 0, 1.0 / F.col("_n")).otherwise(F.greatest(F.col("_r") / F.col("_t"), F.least(F.lit(least_weight), 1.0 / F.col("_n")))))
    return steps.select(member, F.round(F.col("_w") / F.sum("_w").over(w), 6).alias("weight"))
