"""The seven feature families and their assembly into the design matrix, for one as-of date or many at once.

Temporal, spatial and baseline features are projections of the vintages (``vintage.Vintages``). Environmental, exposure
and intelligence features are rows of the long feature store - (entity_key, week, feature, value, available_from) - and
are read by ``store_panels``. All joins are on (entity_key, as_of); only calendars and one-row
frames carry a broadcast hint, other dimensions are left to the planner, which knows their size at run time.

Defined cases: an entity without rows in a family gets nulls, which ``impute`` fills (zero by prefix, else the median of
the as-of date, else 0); NaN and infinities become 0; empty inputs give empty families.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import geo, independence, series, vintage
from tidewatch.operators.vintage import Vintages

KEY = ["entity_key", "as_of"]
STORE = ("entity_key", "week", "feature", "value", "available_from", "family", "source")


def temporal(v: Vintages) -> DataFrame:
    """The entity's own visible trajectory (12 features)."""
    s = F.col("s")
    last = lambda n: vintage.last_sum(s, n)
    logs = F.transform(s, lambda x: F.log1p(x))
    return v.frame.select(
        *KEY,
        *(last(n).alias(f"obs_last_{n}w") for n in (1, 4, 8, 13, 26, 52)),
        F.size(F.filter(vintage.last(s, 52), lambda x: x > 0)).cast("double").alias("obs_active_weeks_52w"),
        vintage.weeks_since(s).alias("obs_weeks_since_last"),
        (F.log1p(last(4)) - F.log1p(vintage.previous_four(s))).alias("obs_log_growth_4w"),
        series.ewma_last(logs).alias("obs_ewma_z"),
        F.array_max(vintage.last(s, 13)).alias("obs_max_week_13w"),
        (last(4) > 0).cast("double").alias("obs_is_currently_reporting"),
    )


def spatial(v: Vintages, places: DataFrame, reach_km: float = S.SPATIAL_KM, border_bonus: float = S.BORDER_BONUS) -> DataFrame:
    """Neighbours' activity of the same disease (6 features). The kernel's weights are normalised among the places that the
    disease has at the as-of date; entities of countries that aren't places have no row."""
    s = F.col("s")
    own = v.frame.select(*KEY, "country", "disease", vintage.last_sum(s, 4).alias("a4"), vintage.last_sum(s, 13).alias("a13"), vintage.previous_four(s).alias("p4"))
    own = own.join(places.where("lat is not null").select("country"), "country", "left_semi")
    weights = geo.kernel(places, reach_km, border_bonus).select("a", "b", "km", "border", "raw")
    other = own.select("as_of", "disease", F.col("country").alias("b"), "a4", "a13", "p4")
    # every country's neighbours first, then their activity: bounded by countries x countries x diseases x dates
    pairs = own.select(*KEY, "disease", F.col("country").alias("a")).join(weights, "a").join(other, ["as_of", "disease", "b"])
    w, active = F.col("raw"), (F.col("a4") > 0).cast("double")
    of = lambda x: F.sum(w * x)
    g = pairs.groupBy(*KEY).agg(
        F.sum(w).alias("w"), of(F.log1p("a4")).alias("n4"), of(F.log1p("a13")).alias("n13"), of(F.log1p("p4")).alias("np"), of(active).alias("share"),
        F.min(F.when(F.col("a4") > 0, F.col("km"))).alias("near"), F.sum(F.col("border") * active).alias("border"),
    )
    scale = F.when(F.col("w") < 1e-12, 1.0).otherwise(F.col("w"))
    value = lambda x: F.coalesce(F.col(x) / scale, F.lit(0.0))
    return own.select(*KEY).join(g, KEY, "left").select(
        *KEY, value("n4").alias("spa_neighbour_activity_4w"), value("n13").alias("spa_neighbour_activity_13w"), (value("n4") - value("np")).alias("spa_neighbour_growth"),
        value("share").alias("spa_neighbour_active_share"), F.coalesce("near", F.lit(S.NO_ACTIVE_KM)).alias("spa_nearest_active_km"), F.coalesce("border", F.lit(0.0)).alias("spa_border_pressure"),
    )


def _with_season(v: Vintages, ahead_days: int = 0) -> DataFrame:
    """The vintages with ``at`` and ``years`` of their season."""
    if v.first is None:
        return v.frame.withColumn("at", F.array().cast("array<int>")).withColumn("years", F.lit(0))
    return v.frame.join(F.broadcast(vintage.season(v.grid, v.first, ahead_days)), "as_of")  # a calendar


def baseline(v: Vintages) -> DataFrame:
    """Seasonal climatology of earlier ISO years within two ISO weeks of the current one (6 features)."""
    s = F.col("s")
    base = F.coalesce(vintage.season_mean(s, F.col("at")), F.lit(0.0))
    recent = vintage.last_mean(s, 4)
    return _with_season(v).select(
        *KEY,
        base.alias("hist_seasonal_baseline"),
        F.log1p(base).alias("hist_seasonal_baseline_log"),
        ((recent - base) / F.sqrt(base + 1)).alias("hist_excess_over_baseline"),
        F.col("years").cast("double").alias("hist_years_of_history"),
        (vintage.total(s) > 0).cast("double").alias("hist_ever_reported"),
        (vintage.total(s) / F.greatest(F.size(s), F.lit(1)) * 52).alias("hist_annual_mean"),
    )


def expected(v: Vintages, ahead_days: int) -> DataFrame:
    """(entity_key, as_of, expected, years): climatology of the week ``ahead_days`` ahead; without an earlier year the mean
    of the last 8 weeks."""
    s = F.col("s")
    return _with_season(v, ahead_days).select(*KEY, F.coalesce(vintage.season_mean(s, F.col("at")), vintage.last_mean(s, 8)).alias("expected"), F.col("years"))


def structural(v: Vintages, horizons: Sequence[int] = S.HORIZONS) -> DataFrame:
    """(entity_key, as_of, horizon_days, mu_damped_trend, mu_seasonal_climatology)."""
    out = None
    for h in horizons:
        trend = series.holt_damped(vintage.last(F.col("s"), 52), max(round(h / 7), 1))
        part = v.frame.select(*KEY, F.lit(h).alias("horizon_days"), trend.alias("mu_damped_trend")).join(expected(v, h).select(*KEY, F.col("expected").alias("mu_seasonal_climatology")), KEY)
        out = part if out is None else out.unionByName(part)
    return out


# --- store rows ------------------------------------------------------------------------------------------------------


def climate(covariates: DataFrame, normals: DataFrame) -> DataFrame:
    """One row per (country, week): weather variables as columns, their availability, anomalies against the month's normals.

    ``covariates``: covariate_id, country, week, available_from, variable, value; of several vintages the latest stands.
    ``normals``: country, month, normal_tavg_c, normal_prec_mm."""
    weather = ("t2m_mean_c", "t2m_min_c", "t2m_max_c", "total_precipitation_mm", "relative_humidity_pct", "soil_temperature_l1_c", "volumetric_soil_water_l1", "snow_depth_m")
    rows = covariates.where(F.col("variable").isin(*weather) & F.col("country").isNotNull() & F.col("week").isNotNull())
    pick = lambda v: F.max_by(F.when(F.col("variable") == v, F.col("value")), F.when(F.col("variable") == v, F.struct("available_from", "covariate_id"))).alias(v)
    wide = rows.groupBy("country", "week").agg(F.max("available_from").alias("available_from"), *(pick(v) for v in ("t2m_mean_c", "total_precipitation_mm")))
    joined = wide.withColumn("month", F.month("week")).join(normals, ["country", "month"], "left")
    anomaly = F.col("t2m_mean_c") - F.col("normal_tavg_c")
    return joined.select(
        "country", "week", "available_from", "t2m_mean_c", "total_precipitation_mm", anomaly.alias("temp_anomaly_c"),
        (F.col("total_precipitation_mm") - F.col("normal_prec_mm") / 4.33).alias("precip_anomaly_mm"), F.when(anomaly.isNotNull(), F.greatest(-anomaly, F.lit(0.0))).alias("cold_snap_index"),
    )


def suitability(temperature: Column, precipitation_z: Column, cold: Column, optimum: Column | float, tolerance: Column | float, precipitation: Column | float, cold_weight: Column | float) -> Column:
    """Thermal response around the optimum, scaled by a precipitation and a cold-anomaly factor; null without temperature
    or precipitation."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    clip = lambda x, low, high: F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))
    thermal = F.exp(-0.5 * F.pow((temperature - lit(optimum)) / F.greatest(lit(tolerance), F.lit(1.0)), 2))
    return thermal * clip(1 + lit(precipitation) * precipitation_z, 0.4, 1.8) * clip(1 + lit(cold_weight) * F.coalesce(cold, F.lit(0.0)) / 3, 0.8, 2.2)


def suitabilities(weather: DataFrame) -> DataFrame:
    """Rows of ``climate`` for each configured disease, with its suitability. The precipitation z-score is over all rows:
    one row of moments, joined back."""
    moments = weather.agg(F.avg("total_precipitation_mm").alias("m"), F.stddev_samp("total_precipitation_mm").alias("sd"))
    z = (F.col("total_precipitation_mm") - F.col("m")) / (F.col("sd") + 1e-9)
    env = [F.struct(F.lit(d).alias("disease"), *(F.lit(e[k]).alias(k) for k in ("optimum", "tolerance", "precipitation", "cold"))) for d, e in S.ENVIRONMENT.items()]
    each = weather.crossJoin(F.broadcast(moments)).withColumn("z", z).select("*", F.explode(F.array(*env)).alias("e"))  # one row of moments
    value = suitability(F.col("t2m_mean_c"), F.col("z"), F.col("cold_snap_index"), F.col("e.optimum"), F.col("e.tolerance"), F.col("e.precipitation"), F.col("e.cold"))
    return each.select(*weather.columns, F.col("e.disease").alias("disease"), value.alias("suitability"))


def environmental(covariates: DataFrame, normals: DataFrame) -> DataFrame:
    """Store rows of the environmental family (7 features per configured disease)."""
    by = Window.partitionBy("country", "disease").orderBy("week")
    rows = suitabilities(climate(covariates, normals)).withColumn("entity_key", F.concat_ws("|", "country", "disease"))
    trend = F.coalesce(F.col("suitability") - F.lag("suitability", 4).over(by), F.lit(0.0))
    rows = rows.select("*", F.avg("suitability").over(by.rowsBetween(-3, 0)).alias("suitability_4w"), trend.alias("suitability_trend"))
    names = {
        "env_suitability": "suitability", "env_suitability_4w": "suitability_4w", "env_suitability_trend": "suitability_trend", "env_temp_anomaly_c": "temp_anomaly_c",
        "env_precip_anomaly_mm": "precip_anomaly_mm", "env_cold_snap_index": "cold_snap_index", "env_t2m_mean_c": "t2m_mean_c",
    }
    return _long(rows, names, "environmental", "ERA5+WorldClim")


def _long(rows: DataFrame, names: dict[str, str], family: str, source: str) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(c).cast("double").alias("value")) for f, c in names.items())))
    flat = rows.select("entity_key", "week", "available_from", cells.alias("c")).select("entity_key", "week", "c.feature", "c.value", "available_from", F.lit(family).alias("family"), F.lit(source).alias("source"))
    return flat.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & F.col("available_from").isNotNull())


def exposure(density: DataFrame, stocks: DataFrame) -> DataFrame:
    """Store rows of the exposure family (4 features per configured disease).

    ``density`` and ``stocks``: country, species, week, available_from, value. The rank is the average rank share among the
    rows of one release (available_from) and species; the trend compares with the country's previous week."""
    diseases = F.array(*(F.struct(F.lit(d).alias("disease"), F.lit(h).alias("species")) for d, h in S.HOST.items()))

    def of_diseases(frame: DataFrame) -> DataFrame:
        kept = frame.where(F.col("species").isin(*S.HOST.values()) & F.col("value").isNotNull() & ~F.isnan("value") & F.col("country").isNotNull() & F.col("week").isNotNull() & F.col("available_from").isNotNull())
        matched = kept.select("*", F.explode(F.filter(diseases, lambda x: x["species"] == F.col("species"))).alias("d"))
        return matched.withColumn("disease", F.col("d.disease")).drop("d").withColumn("entity_key", F.concat_ws("|", "country", "disease"))

    log = F.log1p(F.greatest("value", F.lit(0.0)))
    dense = of_diseases(density).withColumn("log", log)
    ranked = series.rank_shares(dense, ["disease", "available_from"], "log", "rank")
    a = _long(dense.join(ranked, ["disease", "available_from", "log"]), {"exp_host_density_log": "log", "exp_host_density_rank": "rank"}, "livestock_exposure", "GLW4")
    herd = of_diseases(stocks).withColumn("log", log)
    trend = F.coalesce(F.col("log") - F.lag("log").over(Window.partitionBy("country", "disease").orderBy("week", "available_from", "value")), F.lit(0.0))
    b = _long(herd.withColumn("trend", trend), {"exp_national_stock_log": "log", "exp_stock_trend": "trend"}, "livestock_exposure", "FAOSTAT")
    return a.unionByName(b)


def intelligence(signals: DataFrame) -> DataFrame:
    """Store rows of the intelligence family: the known signals as they are, and four fused ones from the anomalies.

    ``signals``: entity_key, week, signal_name, value, available_from, source_name, reliability."""
    kept = signals.where(F.col("signal_name").isin(*S.ANOMALIES, *S.KEPT_SIGNALS) & F.col("week").isNotNull() & F.col("available_from").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    base = kept.select("entity_key", "week", F.col("signal_name").alias("feature"), F.col("value").cast("double").alias("value"), "available_from", F.lit("intelligence").alias("family"), F.col("source_name").alias("source"))
    fused = independence.fuse(kept.where(F.col("signal_name").isin(*S.ANOMALIES)), ["entity_key", "week"]).withColumn("n_strong", F.col("n_strong").cast("double"))
    names = {"intel_fused_anomaly": "fused", "intel_effective_sources": "n_eff", "intel_max_anomaly": "strongest", "intel_corroborating_sources": "n_strong"}
    return base.unionByName(_long(fused, names, "intelligence", "fusion"))


def store_panels(store: DataFrame, grid: DataFrame, features: Sequence[str], lags: Sequence[int] = (1, 4), max_staleness_weeks: int = 12) -> DataFrame:
    """Wide row per (entity, as-of date): the latest usable value of each feature and its published lagged values.

    A row serves the as-of dates from the day it is known to the end of its staleness: it is exploded to those days of the
    calendar that are in the grid, so there is no range join and no loop over dates."""
    first = F.greatest("available_from", "week")
    until = F.date_add("week", 7 * max_staleness_weeks + 6)
    rows = store.where(F.col("feature").isin(*features) & (first <= until)).select("entity_key", "week", "feature", "value", "available_from", F.explode(F.sequence(first, until)).alias("as_of"))
    seen = rows.join(F.broadcast(grid), "as_of")  # a calendar
    cells = seen.groupBy(*KEY, "week", "feature").agg(F.max_by("value", F.struct("available_from", "value")).alias("value"))
    now = vintage.week_start(F.col("as_of"))
    columns = []
    for f in features:
        is_f = F.col("feature") == f
        columns.append(F.max_by(F.when(is_f, F.col("value")), F.when(is_f, F.col("week"))).alias(f))
        columns += [F.max(F.when(is_f & (F.col("week") == F.date_sub(now, 7 * k)), F.col("value"))).alias(f"{f}_lag{k}") for k in lags]
    return cells.withColumn("now", now).groupBy(*KEY, "now").agg(*columns).drop("now") if columns else cells.select(*KEY).distinct()


# --- assembly --------------------------------------------------------------------------------------------------------


def assemble(v: Vintages, places: DataFrame, store: DataFrame, reporting: DataFrame | None = None) -> DataFrame:
    """The design matrix: entity_key, country, disease, as_of, reference_week and the 60 features in their fixed order.

    ``reporting``: (entity_key, as_of, rep_...) of the delay model, where there is one."""
    stored = [f for family in ("environmental", "exposure", "intelligence") for f in S.FAMILIES[family]]
    panel = store_panels(store, v.grid, [f for f in stored if not f.endswith(("_lag1", "_lag4"))])
    blocks = [temporal(v), spatial(v, places), baseline(v), panel]
    wide = v.frame.select("entity_key", "country", "disease", "as_of", vintage.week_start(F.col("as_of")).alias("reference_week"))
    for block in blocks + ([reporting] if reporting is not None else []):
        wide = wide.join(block.select(*KEY, *(c for c in block.columns if c in S.FAMILY_OF)), KEY, "left")
    missing = [f for f in S.MODEL_FEATURES if f not in wide.columns]
    wide = wide.select("*", *(F.lit(None).cast("double").alias(f) for f in missing))
    return impute(wide, S.MODEL_FEATURES).select("entity_key", "country", "disease", "as_of", "reference_week", *S.MODEL_FEATURES)


def impute(frame: DataFrame, features: Sequence[str], key: str = "as_of", zero_filled: Sequence[str] = S.ZERO_FILLED) -> DataFrame:
    """Fills nulls: zero by prefix, else the median of the row's ``key``, else 0; NaN counts as missing, infinities become 0.

    Medians are one aggregate by key, joined back as a dimension of dates."""
    clean = frame.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) if c in features else F.col(c) for c in frame.columns))
    unknown = [f for f in features if not f.startswith(tuple(zero_filled))]
    if unknown:
        middles = clean.groupBy(key).agg(*(F.median(f).alias(f"_m_{f}") for f in unknown))
        clean = clean.join(middles, clean[key].eqNullSafe(middles[key]), "left").drop(middles[key])
    fill = lambda f: F.coalesce(F.col(f), F.col(f"_m_{f}") if f in unknown else F.lit(0.0), F.lit(0.0))
    finite = lambda x: F.when(F.abs(x) == float("inf"), 0.0).otherwise(x)
    return clean.select(*(finite(fill(c)).alias(c) if c in features else F.col(c) for c in frame.columns))


def heuristics(design: DataFrame) -> DataFrame:
    """(entity_key, as_of, rule, score): each rule's feature as a robust z-score among the rows of its as-of date."""
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f).alias("x")) for r, f in S.HEURISTICS.items())))
    long = design.select(*KEY, rules.alias("r")).select(*KEY, "r.rule", "r.x")
    mid = long.groupBy("as_of", "rule").agg(F.median("x").alias("m"))
    off = long.join(mid, ["as_of", "rule"]).withColumn("d", F.abs(F.col("x") - F.col("m")))
    mad = off.groupBy("as_of", "rule").agg(F.median("d").alias("mad"))
    z = (F.col("x") - F.col("m")) / F.greatest(1.4826 * F.col("mad"), F.lit(0.5))
    return off.join(mad, ["as_of", "rule"]).select(*KEY, "rule", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)).alias("score"))
