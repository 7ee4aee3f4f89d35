"""Queries of vintages, feature families, their assembly, labels and targets, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import decide, families, geo, pit, series, vintage
from tidewatch.plans.decisions import CUTOFF, DECIDE, neff_sql, one_date, r6
from tidewatch.plans.registry import registry
from tidewatch.session import table
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
c = F.col


def rounded(frame, *keys):
    return frame.select(*(F.round(x, 6).alias(x) if t == "double" and x not in keys else c(x) for x, t in frame.dtypes))


def full_grid(spark, tri):
    """Every Monday from the first week to the last day on which something became known."""
    row = tri.agg(F.min("week").alias("a"), F.max(F.greatest("week", "available_week")).alias("b")).first()
    start, stop = (str(row["a"]), str(row["b"])) if row["a"] else ("2020-01-06", "2020-01-06")
    return pit.grid(spark, start, stop).select(c("as_of").cast("date").alias("as_of"))


_GRID = "sp AS (SELECT min(week) AS w0, max(week) AS w1, max(greatest(week, available_week)) AS w2 FROM tri), g AS (SELECT CAST(unnest(generate_series(w0::TIMESTAMP, w2::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS as_of FROM sp)"


# --- geography -------------------------------------------------------------------------------------------------------

_PL = f"WITH {T.EVENTS}, {T.PLACES}"


@query("centroids", _PL + " SELECT country, lat, lon, n, tier, round(least(sqrt(10000.0 * n / pi()), 700), 6) AS radius_km FROM pl")
def centroids(spark, d):
    """The country dimension with the radius of a circle of its area (10,000 km2 per located outbreak stand in for the area)."""
    return T.places(spark, d).select("country", "lat", "lon", "n", "tier", r6(F.when(c("n") > 0, geo.radius_km(10000.0 * c("n"))).otherwise(0.0), "radius_km"))


@query("adjacency", _PL + " SELECT a, b FROM adj")
def adjacency(spark, d):
    return geo.adjacency(T.places(spark, d))


@query("haversine", _PL + " SELECT a, b, round(km, 4) AS km FROM kms")
def haversine(spark, d):
    return geo.pairs(T.places(spark, d)).select("a", "b", F.round("km", 4).alias("km"))


@query("decay_kernel", _PL + " SELECT a, b, border::DOUBLE AS border, round(raw / CASE WHEN sum(raw) OVER (PARTITION BY a) < 1e-12 THEN 1 ELSE sum(raw) OVER (PARTITION BY a) END, 6) AS w FROM kr")
def decay_kernel(spark, d):
    return geo.kernel(T.places(spark, d)).select("a", "b", "border", r6(c("w"), "w"))


@query("spatial_lag", _PL + ", act AS (SELECT country, disease, ln(1 + sum(outbreaks)) AS x FROM ev GROUP BY 1, 2), wt AS (SELECT a, b, raw / CASE WHEN sum(raw) OVER (PARTITION BY a) < 1e-12 THEN 1 ELSE sum(raw) OVER (PARTITION BY a) END AS w FROM kr) SELECT a AS country, disease, round(sum(w * x), 6) AS pressure FROM wt JOIN act ON act.country = wt.b GROUP BY 1, 2")
def spatial_lag(spark, d):
    act = T.events(spark, d).groupBy("country", "disease").agg(F.log1p(F.sum("outbreaks")).alias("x"))
    return geo.kernel(T.places(spark, d)).join(act, c("b") == act["country"]).groupBy(c("a").alias("country"), "disease").agg(r6(F.sum(c("w") * c("x")), "pressure"))


# --- families --------------------------------------------------------------------------------------------------------

_VN = "WITH RECURSIVE " + T.vintage_sql(DECIDE)


def _vintages(spark, d, day=DECIDE):
    return vintage.visible(T.triangle(spark, d), one_date(spark, day))


_TEMPORAL = _VN + """, h AS (SELECT entity_key, greatest(var_pop(ln(1 + y)), 0.25) AS v0 FROM vn WHERE k <= 8 GROUP BY 1),
r AS (SELECT n.entity_key, n.k, ln(1 + y) AS level, 0.7 * v0 AS var, 0.0::DOUBLE AS z FROM vn n JOIN h USING (entity_key) WHERE k = 1
 UNION ALL SELECT n.entity_key, n.k, 0.3 * ln(1 + n.y) + 0.7 * r.level, 0.7 * r.var + 0.3 * (ln(1 + n.y) - r.level) ** 2, (ln(1 + n.y) - r.level) / greatest(sqrt(r.var), 0.5) FROM r JOIN vn n ON n.entity_key = r.entity_key AND n.k = r.k + 1),
z AS (SELECT entity_key, arg_max(z, k) AS z FROM r GROUP BY 1),
tf AS (SELECT entity_key, """ + ", ".join(f"sum(y) FILTER (WHERE back <= {n}) AS obs_last_{n}w" for n in (1, 4, 8, 13, 26, 52)) + """,
 CAST(count(*) FILTER (WHERE back <= 52 AND y > 0) AS DOUBLE) AS obs_active_weeks_52w, CAST(coalesce(min(back) FILTER (WHERE y > 0) - 1, least(max(k), 260)) AS DOUBLE) AS obs_weeks_since_last,
 ln(1 + sum(y) FILTER (WHERE back <= 4)) - ln(1 + CASE WHEN max(k) >= 8 THEN sum(y) FILTER (WHERE back BETWEEN 5 AND 8) ELSE 0 END) AS obs_log_growth_4w,
 max(y) FILTER (WHERE back <= 13) AS obs_max_week_13w, CAST(sum(y) FILTER (WHERE back <= 4) > 0 AS DOUBLE) AS obs_is_currently_reporting FROM vn GROUP BY 1)"""


@query("temporal_family", _TEMPORAL + f" SELECT entity_key, DATE '{DECIDE}' AS as_of, tf.* EXCLUDE (entity_key, obs_log_growth_4w), round(obs_log_growth_4w, 6) AS obs_log_growth_4w, round(z, 6) AS obs_ewma_z FROM tf JOIN z USING (entity_key)")
def temporal_family(spark, d):
    return rounded(families.temporal(_vintages(spark, d)))


_SPATIAL = _VN + f""", {T.PLACES}, own AS (SELECT entity_key, country, disease, sum(y) FILTER (WHERE back <= 4) AS a4, sum(y) FILTER (WHERE back <= 13) AS a13, CASE WHEN max(k) >= 8 THEN sum(y) FILTER (WHERE back BETWEEN 5 AND 8) ELSE 0 END AS p4 FROM vn
  WHERE country IN (SELECT country FROM pl WHERE lat IS NOT NULL) GROUP BY 1, 2, 3),
pr AS (SELECT o.entity_key, raw, km, border, n.a4, n.a13, n.p4 FROM own o JOIN kr ON kr.a = o.country JOIN own n ON n.disease = o.disease AND n.country = kr.b),
sg6 AS (SELECT entity_key, CASE WHEN sum(raw) < 1e-12 THEN 1 ELSE sum(raw) END AS w, sum(raw * ln(1 + a4)) AS n4, sum(raw * ln(1 + a13)) AS n13, sum(raw * ln(1 + p4)) AS np, sum(raw * CAST(a4 > 0 AS INT)) AS sh, min(km) FILTER (WHERE a4 > 0) AS near, sum(border * CAST(a4 > 0 AS INT)) AS bp FROM pr GROUP BY 1)"""


@query("spatial_features", _SPATIAL + f""" SELECT own.entity_key, DATE '{DECIDE}' AS as_of, round(coalesce(n4 / w, 0), 6) AS spa_neighbour_activity_4w, round(coalesce(n13 / w, 0), 6) AS spa_neighbour_activity_13w, round(coalesce(n4 / w, 0) - coalesce(np / w, 0), 6) AS spa_neighbour_growth,
 round(coalesce(sh / w, 0), 6) AS spa_neighbour_active_share, round(coalesce(near, 6000), 6) AS spa_nearest_active_km, CAST(coalesce(bp, 0) AS DOUBLE) AS spa_border_pressure FROM own LEFT JOIN sg6 USING (entity_key)""")
def spatial_features(spark, d):
    return rounded(families.spatial(_vintages(spark, d), T.places(spark, d)))


def _season(ahead: int) -> str:
    target = f"CAST(date_trunc('week', DATE '{DECIDE}' + {ahead}) AS DATE)"
    gap = f"abs(extract(week FROM week) - extract(week FROM {target}))"
    return f"least({gap}, 53 - {gap}) <= 2 AND extract(isoyear FROM week) < extract(isoyear FROM {target})"


@query("seasonal_baseline", _VN + f""", b AS (SELECT entity_key, coalesce(avg(y) FILTER (WHERE {_season(0)}), 0) AS base, count(DISTINCT extract(isoyear FROM week)) FILTER (WHERE {_season(0)}) AS years, avg(y) FILTER (WHERE back <= 4) AS recent, avg(y) * 52 AS annual, sum(y) AS total FROM vn GROUP BY 1)
SELECT entity_key, DATE '{DECIDE}' AS as_of, round(base, 6) AS hist_seasonal_baseline, round(ln(1 + base), 6) AS hist_seasonal_baseline_log, round((recent - base) / sqrt(base + 1), 6) AS hist_excess_over_baseline, CAST(years AS DOUBLE) AS hist_years_of_history, CAST(total > 0 AS DOUBLE) AS hist_ever_reported, round(annual, 6) AS hist_annual_mean FROM b""")
def seasonal_baseline(spark, d):
    return rounded(families.baseline(_vintages(spark, d)))


@query("seasonal_expected", _VN + f" SELECT entity_key, DATE '{DECIDE}' AS as_of, round(coalesce(avg(y) FILTER (WHERE {_season(28)}), avg(y) FILTER (WHERE back <= 8)), 6) AS expected, CAST(count(DISTINCT extract(isoyear FROM week)) FILTER (WHERE {_season(28)}) AS INT) AS years FROM vn GROUP BY 1")
def seasonal_expected(spark, d):
    return rounded(families.expected(_vintages(spark, d), 28))


@query("damped_trend", _VN + """, hk AS (SELECT entity_key, y, row_number() OVER (PARTITION BY entity_key ORDER BY week) AS j FROM vn WHERE back <= 52),
hr AS (SELECT entity_key, j, ln(1 + y) AS level, 0.0::DOUBLE AS trend FROM hk WHERE j = 1 UNION ALL SELECT hk.entity_key, hk.j, 0.35 * ln(1 + hk.y) + 0.65 * (r.level + 0.85 * r.trend), 0.15 * (0.35 * ln(1 + hk.y) + 0.65 * (r.level + 0.85 * r.trend) - r.level) + 0.85 * 0.85 * r.trend FROM hr r JOIN hk ON hk.entity_key = r.entity_key AND hk.j = r.j + 1)
SELECT entity_key, round(greatest(0, exp(arg_max(level, j) + 0.85 * arg_max(trend, j)) - 1), 6) AS ahead_1w, round(greatest(0, exp(arg_max(level, j) + (0.85 + 0.85 ** 2) * arg_max(trend, j)) - 1), 6) AS ahead_2w,
 round(greatest(0, exp(arg_max(level, j) + (0.85 + 0.85 ** 2 + 0.85 ** 3 + 0.85 ** 4) * arg_max(trend, j)) - 1), 6) AS ahead_4w FROM hr GROUP BY 1""")
def damped_trend(spark, d):
    """Damped-trend forecasts from the last 52 weeks visible at the as-of date."""
    s = vintage.last(c("s"), 52)
    return _vintages(spark, d).frame.select("entity_key", *(r6(series.holt_damped(s, h), f"ahead_{h}w") for h in (1, 2, 4)))


# The month's normals: means of the years 2019 to 2021, the climatology of this input.
_NORMALS = "nm AS (SELECT country, month(week) AS month, avg(value) FILTER (WHERE variable = 't2m_mean_c') AS normal_tavg_c, avg(value) FILTER (WHERE variable = 'total_precipitation_mm') * 4.33 AS normal_prec_mm FROM cw WHERE reference_date < DATE '2022-01-01' GROUP BY 1, 2)"
_CW = T.COVARIATES + ", cw AS (SELECT *, CAST(date_trunc('week', reference_date) AS DATE) AS week FROM cv), " + _NORMALS + """,
wide AS (SELECT country, week, max(available_from) AS available_from, arg_max(value, struct_pack(a := available_from, i := covariate_id)) FILTER (WHERE variable = 't2m_mean_c') AS t, arg_max(value, struct_pack(a := available_from, i := covariate_id)) FILTER (WHERE variable = 'total_precipitation_mm') AS p
  FROM cw WHERE variable IN ('t2m_mean_c', 't2m_min_c', 't2m_max_c', 'total_precipitation_mm', 'relative_humidity_pct', 'soil_temperature_l1_c', 'volumetric_soil_water_l1', 'snow_depth_m') GROUP BY 1, 2),
cl AS (SELECT w.*, t - normal_tavg_c AS ta, p - normal_prec_mm / 4.33 AS pa, CASE WHEN t - normal_tavg_c IS NOT NULL THEN greatest(-(t - normal_tavg_c), 0.0) END AS cold0 FROM wide w LEFT JOIN nm ON nm.country = w.country AND nm.month = month(w.week)),
dis(disease, opt, tol, pe, cwt) AS (VALUES ('HPAI', 4.0, 7.5, 0.18, 0.35), ('ASF', 19.0, 11.0, -0.10, 0.05)),
mo AS (SELECT avg(p) AS m, stddev_samp(p) AS sd FROM wide),
su AS (SELECT country, disease, week, available_from, t, p, ta, pa, cold0 AS cold, CASE WHEN t IS NOT NULL AND p IS NOT NULL THEN exp(-0.5 * ((t - opt) / tol) ** 2) * least(1.8, greatest(0.4, 1 + pe * (p - m) / (sd + 1e-9))) * least(2.2, greatest(0.8, 1 + cwt * coalesce(cold0, 0) / 3)) END AS su FROM cl, dis, mo)"""


def _covariates(spark, d):
    return T.covariates(spark, d).withColumn("week", vintage.week_start(c("reference_date")))


def normals(covariates):
    """(country, month, normal_tavg_c, normal_prec_mm) from the years before 2022; the precipitation of a month is 4.33 weeks'."""
    before = covariates.where(c("reference_date") < pit.day("2022-01-01"))
    mean = lambda v: F.avg(F.when(c("variable") == v, c("value")))
    return before.groupBy("country", F.month("week").alias("month")).agg(mean("t2m_mean_c").alias("normal_tavg_c"), (mean("total_precipitation_mm") * 4.33).alias("normal_prec_mm"))


@query("climate_anomaly", f"WITH {_CW} SELECT country, week, round(ta, 6) AS temp_anomaly_c, round(pa, 6) AS precip_anomaly_mm, round(cold0, 6) AS cold_snap_index FROM cl")
def climate_anomaly(spark, d):
    """Temperature and precipitation against the month's normals."""
    cv = _covariates(spark, d)
    return rounded(families.climate(cv, normals(cv)).select("country", "week", "temp_anomaly_c", "precip_anomaly_mm", "cold_snap_index"))


@query("suitability", f"WITH {_CW} SELECT country, disease, week, round(su, 6) AS suitability FROM su")
def suitability(spark, d):
    cv = _covariates(spark, d)
    return rounded(families.suitabilities(families.climate(cv, normals(cv))).select("country", "disease", "week", "suitability"))


@query("environmental_family", f"""WITH {_CW}, w AS (SELECT *, avg(su) OVER (PARTITION BY country, disease ORDER BY week ROWS 3 PRECEDING) AS s4, coalesce(su - lag(su, 4) OVER (PARTITION BY country, disease ORDER BY week), 0) AS tr FROM su),
l AS (SELECT country || '|' || disease AS entity_key, week, available_from, unnest([struct_pack(f := 'env_suitability', v := su), struct_pack(f := 'env_suitability_4w', v := s4), struct_pack(f := 'env_suitability_trend', v := tr), struct_pack(f := 'env_temp_anomaly_c', v := ta), struct_pack(f := 'env_precip_anomaly_mm', v := pa),
 struct_pack(f := 'env_cold_snap_index', v := cold), struct_pack(f := 'env_t2m_mean_c', v := t)]) AS x FROM w)
SELECT entity_key, week, x.f AS feature, round(x.v, 6) AS value, available_from, 'environmental' AS family, 'ERA5+WorldClim' AS source FROM l WHERE x.v IS NOT NULL AND NOT isnan(x.v) AND available_from IS NOT NULL""")
def environmental_family(spark, d):
    cv = _covariates(spark, d)
    return rounded(families.environmental(cv, normals(cv)))


def stocks(spark, d):
    """Livestock numbers in head per (country, species, year), one row per release, as weekly covariates known on release."""
    from tidewatch.plans.core import with_common_units

    rows = table(spark, d, "faostat_livestock_annual_sample").where(F.lower("element").contains("stock")).select("row_id", "iso3", "item", "year", "element", "unit", "note", "value", "release_date")
    head = with_common_units(rows).where(c("common_unit") == "head")
    from tidewatch.functions.missing import code, date_value

    keyed = head.groupBy(code(c("iso3")).alias("country"), F.lower(F.trim("item")).alias("species"), vintage.week_start(F.make_date("year", F.lit(1), F.lit(1))).alias("week"), date_value(c("release_date")).alias("available_from"))
    return keyed.agg(F.max_by("common_value", "row_id").cast("double").alias("value"))


@query("exposure_family")
def exposure_family(spark, d):
    """Host density and national stocks; the stocks stand in for the gridded density. Units come out of the text of the rows,
    which SQL can't do: tests compare the operator with plain Python."""
    rows = stocks(spark, d)
    return rounded(families.exposure(rows, rows))


_SIG = f"(SELECT * FROM sg WHERE signal_name IN {S.ANOMALIES + S.KEPT_SIGNALS})"
_FUSED = f"(SELECT * FROM sg WHERE signal_name IN {S.ANOMALIES})"
_INTEL = f"""WITH {T.SIGNALS}, {neff_sql(f'SELECT * FROM {_FUSED}', 'entity_key, week')},
f AS (SELECT entity_key, week, max(available_from) AS available_from, sum(coalesce(reliability, 0.5) * value) / greatest(sum(coalesce(reliability, 0.5)), 1e-9) AS mean, max(value) AS top, CAST(count(*) FILTER (WHERE value > 1) AS DOUBLE) AS strong FROM {_FUSED} GROUP BY 1, 2),
l AS (SELECT entity_key, week, available_from, unnest([struct_pack(f := 'intel_fused_anomaly', v := mean * n_eff / n), struct_pack(f := 'intel_effective_sources', v := n_eff), struct_pack(f := 'intel_max_anomaly', v := top), struct_pack(f := 'intel_corroborating_sources', v := strong)]) AS x FROM f JOIN ne USING (entity_key, week)),
il AS (SELECT entity_key, week, signal_name AS feature, value, available_from, 'intelligence' AS family, source_name AS source FROM {_SIG} UNION ALL SELECT entity_key, week, x.f, x.v, available_from, 'intelligence', 'fusion' FROM l)"""


@query("intelligence_family", _INTEL + " SELECT entity_key, week, feature, round(value, 9) AS value, available_from, family, source FROM il")
def intelligence_family(spark, d):
    return families.intelligence(T.signals(spark, d)).withColumn("value", F.round("value", 9))


# --- assembly, labels, targets ---------------------------------------------------------------------------------------


def feature_store(spark, d):
    """The long feature store of the three families that are read from it."""
    cv, st = _covariates(spark, d), stocks(spark, d)
    return families.environmental(cv, normals(cv)).unionByName(families.exposure(st, st)).unionByName(families.intelligence(T.signals(spark, d)))


@query("design_matrix")
def design_matrix(spark, d):
    """The 60 features of every entity at the as-of date. Each family has SQL of its own; tests check that they partition the
    60 and that the matrix equals them."""
    from tidewatch.operators import delay

    v = _vintages(spark, d)
    reporting = delay.reporting_features(v, T.events(spark, d), T.places(spark, d))
    return rounded(families.assemble(v, T.places(spark, d), feature_store(spark, d), reporting))


_LABELS = f"""{_GRID}, kn AS (SELECT entity_key, min(greatest(week, available_week)) AS since FROM tri GROUP BY 1), pan AS (SELECT entity_key, as_of, least(as_of, w1) AS wn, w0 FROM kn, g, sp WHERE since <= as_of),
v8 AS (SELECT p.entity_key, p.as_of, sum(count) AS v FROM pan p JOIN tri t ON t.entity_key = p.entity_key AND t.available_week <= p.as_of AND t.week <= p.wn AND t.week > p.wn - 56 GROUP BY 1, 2),
ft AS (SELECT entity_key, as_of, sum(count) AS f FROM tri JOIN g ON available_week > as_of AND available_week <= as_of + 28 GROUP BY 1, 2),
lb AS (SELECT p.entity_key, p.as_of, coalesce(v, 0) / least(8, (wn - w0) // 7 + 1)::DOUBLE AS rate, coalesce(v, 0) AS v, coalesce(f, 0)::DOUBLE AS f FROM pan p LEFT JOIN v8 USING (entity_key, as_of) LEFT JOIN ft USING (entity_key, as_of)),
la AS (SELECT entity_key, as_of, CAST(f >= greatest(1.0, 1.5 * rate * 4) AS INT) AS label, as_of + 28 <= DATE '{CUTOFF}' AS label_observable, f AS future_published, greatest(1.0, 1.5 * rate * 4) AS label_threshold, rate AS current_run_rate, CAST(v <= 0 AS INT) AS is_quiet, CAST(f >= greatest(1.0, 1.5 * rate * 4) AND v <= 0 AS INT) AS is_emergence FROM lb)"""


@query("ew_labels", f"WITH {T.TRIANGLE}, {_LABELS} SELECT * EXCLUDE (label_threshold, current_run_rate), round(label_threshold, 6) AS label_threshold, round(current_run_rate, 6) AS current_run_rate FROM la")
def ew_labels(spark, d):
    """Early-warning labels of every entity at every Monday of the calendar from the first on which it is known."""
    tri = T.triangle(spark, d)
    return rounded(decide.labels(tri, vintage.visible(tri, full_grid(spark, tri)), CUTOFF))


_TARGETS = f"{_GRID}, h AS (SELECT unnest([7, 14, 28]) AS horizon_days), tg AS (SELECT entity_key, as_of, horizon_days, week AS target_week, y AS target_reported_final, week + 90 <= DATE '{CUTOFF}' AS target_complete FROM g, h JOIN ser ON ser.week = CAST(date_trunc('week', as_of + horizon_days) AS DATE))"


@query("forecast_targets", f"WITH {T.SERIES}, {_TARGETS} SELECT * FROM tg")
def forecast_targets(spark, d):
    return targets(spark, d)


def targets(spark, d):
    """Final counts of the week that lies a horizon after every Monday of the calendar; weeks off the calendar have none."""
    tri = T.triangle(spark, d)
    ask = full_grid(spark, tri).select("as_of", F.explode(F.array(*map(F.lit, S.HORIZONS))).alias("horizon_days"))
    ask = ask.withColumn("week", vintage.week_start(F.expr("date_add(as_of, horizon_days)")))
    found = T.series(spark, d).join(F.broadcast(ask), "week")  # a calendar
    return found.select("entity_key", "as_of", "horizon_days", c("week").alias("target_week"), c("y").alias("target_reported_final"), (F.date_add("week", 90) <= pit.day(CUTOFF)).alias("target_complete"))


@query("multi_asof_panel", f"WITH {T.TRIANGLE}, {_GRID} SELECT entity_key, as_of, CAST(sum(outbreaks) AS BIGINT) AS activity FROM ev JOIN g ON available_from <= as_of AND reference_date <= as_of AND reference_date > as_of - 28 GROUP BY 1, 2")
def multi_asof_panel(spark, d):
    tri = T.triangle(spark, d)
    return pit.many_as_of(T.events(spark, d), full_grid(spark, tri))


_PANEL = f"""{_GRID}, kn AS (SELECT entity_key, min(greatest(week, available_week)) AS since FROM tri GROUP BY 1), pan AS (SELECT entity_key, as_of, least(as_of, w1) AS wn, w0 FROM kn, g, sp WHERE since <= as_of),
pn AS (SELECT p.entity_key, p.as_of, coalesce(sum(count) FILTER (WHERE t.week > p.wn - 28), 0)::DOUBLE AS obs_last_4w, coalesce(sum(count) FILTER (WHERE t.week > p.wn - 91), 0)::DOUBLE AS obs_last_13w, coalesce(sum(count), 0)::DOUBLE AS obs_last_52w
  FROM pan p LEFT JOIN tri t ON t.entity_key = p.entity_key AND t.available_week <= p.as_of AND t.week <= p.wn AND t.week > p.wn - 364 GROUP BY 1, 2)"""


@query("assemble_many", f"WITH {T.TRIANGLE}, {_PANEL} SELECT * FROM pn")
def assemble_many(spark, d):
    """Trailing visible burdens of every (entity, as-of date) of the calendar in one pass. ``families.assemble`` takes the
    same vintages and gives all 60 columns."""
    tri = T.triangle(spark, d)
    return rounded(families.temporal(vintage.visible(tri, full_grid(spark, tri))).select("entity_key", "as_of", "obs_last_4w", "obs_last_13w", "obs_last_52w"))


@query("join_training", f"WITH {T.TRIANGLE}, {_LABELS}, {_PANEL.replace(_GRID + ', ', '').replace('kn AS', 'kn2 AS').replace('FROM kn, g', 'FROM kn2, g').replace('pan AS', 'pan2 AS').replace('FROM pan p', 'FROM pan2 p')} SELECT entity_key, as_of, obs_last_4w, obs_last_13w, obs_last_52w, label, CASE WHEN as_of <= DATE '2022-12-31' THEN 'train' WHEN as_of <= DATE '2023-12-31' THEN 'calibration' ELSE 'test' END AS split FROM pn JOIN la USING (entity_key, as_of) WHERE label_observable")
def join_training(spark, d):
    """Design rows with their observable labels and their chronological split."""
    tri = T.triangle(spark, d)
    v = vintage.visible(tri, full_grid(spark, tri))
    design = families.temporal(v).select("entity_key", "as_of", "obs_last_4w", "obs_last_13w", "obs_last_52w")
    return design.join(decide.labels(tri, v, CUTOFF).where("label_observable"), ["entity_key", "as_of"]).select("entity_key", "as_of", "obs_last_4w", "obs_last_13w", "obs_last_52w", "label", split_of(c("as_of")).alias("split"))


def split_of(day, train_end: str = "2022-12-31", calibration_end: str = "2023-12-31"):
    return F.when(day <= pit.day(train_end), "train").when(day <= pit.day(calibration_end), "calibration").otherwise("test")


_STRUCT = f"WITH RECURSIVE {T.vintage_sql(DECIDE)}, hk AS (SELECT entity_key, y, row_number() OVER (PARTITION BY entity_key ORDER BY week) AS j FROM vn WHERE back <= 52), hr AS (SELECT entity_key, j, ln(1 + y) AS level, 0.0::DOUBLE AS trend FROM hk WHERE j = 1 UNION ALL SELECT hk.entity_key, hk.j, 0.35 * ln(1 + hk.y) + 0.65 * (r.level + 0.85 * r.trend), 0.15 * (0.35 * ln(1 + hk.y) + 0.65 * (r.level + 0.85 * r.trend) - r.level) + 0.85 * 0.85 * r.trend FROM hr r JOIN hk ON hk.entity_key = r.entity_key AND hk.j = r.j + 1), hf AS (SELECT entity_key, arg_max(level, j) AS level, arg_max(trend, j) AS trend FROM hr GROUP BY 1), fin AS (SELECT entity_key, week, sum(count) AS y FROM tri GROUP BY 1, 2), st AS (" + " UNION ALL ".join(
    f"SELECT v.entity_key, {h} AS horizon_days, CAST(date_trunc('week', DATE '{DECIDE}' + {h}) AS DATE) AS target_week, any_value(greatest(0, exp(level + {sum(0.85**i for i in range(1, max(round(h / 7), 1) + 1))!r} * trend) - 1)) AS mu_damped_trend, coalesce(avg(v.y) FILTER (WHERE {_season(h)}), avg(v.y) FILTER (WHERE back <= 8)) AS mu_seasonal_climatology, sum(v.y) FILTER (WHERE back <= 4) AS obs_last_4w FROM vn v JOIN hf USING (entity_key) GROUP BY 1" for h in S.HORIZONS
) + ")"


@query("join_forecast_panel", _STRUCT + " SELECT st.entity_key, horizon_days, st.target_week, coalesce(y, 0)::DOUBLE AS target_reported_final, obs_last_4w, round(mu_damped_trend, 6) AS mu_damped_trend, round(mu_seasonal_climatology, 6) AS mu_seasonal_climatology FROM st LEFT JOIN fin ON fin.entity_key = st.entity_key AND fin.week = st.target_week WHERE st.target_week <= (SELECT max(week) FROM tri)")
def join_forecast_panel(spark, d):
    """Targets with design rows (inner) and the structural members' means (left) at one as-of date."""
    v = _vintages(spark, d)
    design = families.temporal(v).select("entity_key", "as_of", "obs_last_4w")
    panel = targets(spark, d).where(c("as_of") == pit.day(DECIDE)).join(design, ["entity_key", "as_of"]).join(families.structural(v), ["entity_key", "as_of", "horizon_days"], "left")
    means = (F.coalesce(x, F.lit(0.0)).alias(x) for x in ("mu_damped_trend", "mu_seasonal_climatology"))
    return rounded(panel.select("entity_key", "horizon_days", "target_week", "target_reported_final", "obs_last_4w", *means))


@query("crps_weights", _STRUCT + """, e AS (SELECT st.horizon_days, coalesce(y, 0) AS y, mu_damped_trend AS a, mu_seasonal_climatology AS b, obs_last_4w / 4 AS m FROM st LEFT JOIN fin ON fin.entity_key = st.entity_key AND fin.week = st.target_week WHERE st.target_week <= (SELECT max(week) FROM tri)),
s AS (SELECT 'damped_trend' AS member, avg(abs(a - y)) AS score FROM e UNION ALL SELECT 'seasonal_climatology', avg(abs(b - y)) FROM e UNION ALL SELECT 'recent_mean', avg(abs(m - y)) FROM e UNION ALL SELECT 'unscored', NULL),
r AS (SELECT member, coalesce(exp(-(score - min(score) OVER ()) / (abs(avg(score) OVER ()) * 0.5)), 0) AS r FROM s), f AS (SELECT member, greatest(r / sum(r) OVER (), 0.05) AS w FROM r) SELECT member, round(w / sum(w) OVER (), 6) AS weight FROM f""")
def crps_weights(spark, d):
    """Ensemble weights from the members' CRPS on the targets (of a point forecast: the mean absolute error)."""
    p = join_forecast_panel(spark, d)
    off = lambda x: F.avg(F.abs(x - c("target_reported_final")))
    one = p.agg(off(c("mu_damped_trend")).alias("damped_trend"), off(c("mu_seasonal_climatology")).alias("seasonal_climatology"), off(c("obs_last_4w") / 4).alias("recent_mean"), F.lit(None).cast("double").alias("unscored"))
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), c(m).alias("score")) for m in one.columns)))
    return decide.crps_weights(one.select(cells.alias("x")).select("x.member", "x.score"), "member", "score")


_HEUR = _TEMPORAL + f""", b AS (SELECT entity_key, coalesce(avg(y) FILTER (WHERE {_season(0)}), 0) AS base, avg(y) FILTER (WHERE back <= 4) AS recent FROM vn GROUP BY 1),
x AS (SELECT entity_key, 'ewma_control_chart' AS rule, z AS x FROM z UNION ALL SELECT entity_key, 'recent_activity', obs_last_4w FROM tf UNION ALL SELECT entity_key, 'seasonal_excess', (recent - base) / sqrt(base + 1) FROM b),
m AS (SELECT *, median(x) OVER (PARTITION BY rule) AS m FROM x), a AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY rule) AS mad FROM m)"""


@query("heuristic_scores", _HEUR + " SELECT entity_key, rule, round((x - m) / greatest(1.4826 * mad, 0.5), 5) AS score FROM a")
def heuristic_scores(spark, d):
    """The single-feature rules as robust z-scores at the as-of date (those whose features need no store)."""
    v = _vintages(spark, d)
    wide = families.temporal(v).join(families.baseline(v), families.KEY)
    rest = [f for f in S.HEURISTICS.values() if f not in wide.columns]
    found = families.heuristics(wide.select("*", *(F.lit(None).cast("double").alias(f) for f in rest)))
    return found.where(c("rule").isin("ewma_control_chart", "recent_activity", "seasonal_excess")).select("entity_key", "rule", F.round("score", 5).alias("score"))


@query("impute_panel", f"WITH {_CW}, x AS (SELECT country, disease, week, su, ta FROM su) SELECT country, disease, week, round(coalesce(su, median(su) OVER (PARTITION BY week), 0), 6) AS env_suitability, round(coalesce(ta, median(ta) OVER (PARTITION BY week), 0), 6) AS env_temp_anomaly_c FROM x")
def impute_panel(spark, d):
    """Missing environmental values filled with the median of all entities at the same date, else 0."""
    cv = _covariates(spark, d)
    rows = families.suitabilities(families.climate(cv, normals(cv))).select("country", "disease", "week", c("suitability").alias("env_suitability"), c("temp_anomaly_c").alias("env_temp_anomaly_c"))
    return rounded(families.impute(rows, ["env_suitability", "env_temp_anomaly_c"], "week"))


@query("control_chart", f"""WITH RECURSIVE {T.vintage_sql(DECIDE)}, h AS (SELECT entity_key, greatest(var_pop(ln(1 + y)), 0.25) AS v0 FROM vn WHERE k <= 8 GROUP BY 1),
r AS (SELECT n.entity_key, n.k, ln(1 + y) AS level, 0.7 * v0 AS var, 0.0::DOUBLE AS z FROM vn n JOIN h USING (entity_key) WHERE k = 1
 UNION ALL SELECT n.entity_key, n.k, 0.3 * ln(1 + n.y) + 0.7 * r.level, 0.7 * r.var + 0.3 * (ln(1 + n.y) - r.level) ** 2, (ln(1 + n.y) - r.level) / greatest(sqrt(r.var), 0.5) FROM r JOIN vn n ON n.entity_key = r.entity_key AND n.k = r.k + 1),
z AS (SELECT entity_key, arg_max(z, k) AS z FROM r GROUP BY 1), a AS (SELECT *, median(ln(1 + y)) OVER (PARTITION BY entity_key) AS m FROM vn), b AS (SELECT *, median(abs(ln(1 + y) - m)) OVER (PARTITION BY entity_key) AS mad FROM a),
cc AS (SELECT entity_key, k, sum((ln(1 + y) - m) / greatest(1.4826 * mad, 0.5) - 0.5) OVER (PARTITION BY entity_key ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM b), cs AS (SELECT entity_key, k, c - least(0, min(c) OVER (PARTITION BY entity_key ORDER BY k ROWS UNBOUNDED PRECEDING)) AS s FROM cc), ce AS (SELECT entity_key, arg_max(s, k) AS s FROM cs GROUP BY 1)
SELECT entity_key, round(z, 6) AS ewma_z, z >= 2 AS ewma_alarm, round(s, 4) AS cusum, s > 3 AS cusum_alarm FROM z JOIN ce USING (entity_key)""")
def control_chart(spark, d):
    """EWMA and CUSUM charts of the series visible at the as-of date: their last values and alarms."""
    v = _vintages(spark, d).frame
    z = series.ewma_last(F.transform("s", lambda x: F.log1p(x)))
    flat = v.select("entity_key", F.posexplode("s").alias("k", "y")).withColumn("l", F.log1p("y"))
    s = series.cusum(series.with_robust_z(flat, "l", "entity_key"), "z", "entity_key", "k").groupBy("entity_key").agg(F.max_by("s", "k").alias("s"))
    return v.select("entity_key", z.alias("z")).join(s, "entity_key").select("entity_key", r6(c("z"), "ewma_z"), (c("z") >= 2).alias("ewma_alarm"), F.round("s", 4).alias("cusum"), (c("s") > 3).alias("cusum_alarm"))


@query("alert_hysteresis", f"""WITH RECURSIVE {T.TRIANGLE}, {_GRID}, kn AS (SELECT entity_key, min(greatest(week, available_week)) AS since FROM tri GROUP BY 1), pan AS (SELECT entity_key, as_of, least(as_of, w1) AS wn FROM kn, g, sp WHERE since <= as_of),
ps AS (SELECT p.entity_key, p.as_of, 1 - exp(-coalesce(sum(count), 0) / 3.0) AS p FROM pan p LEFT JOIN tri t ON t.entity_key = p.entity_key AND t.available_week <= p.as_of AND t.week <= p.wn AND t.week > p.wn - 182 GROUP BY 1, 2),
lv AS (SELECT *, CASE WHEN p >= 0.65 THEN 4 WHEN p >= 0.40 THEN 3 WHEN p >= 0.20 THEN 2 WHEN p >= 0.08 THEN 1 ELSE 0 END AS up, CASE WHEN p >= 0.65 - 0.05 THEN 4 WHEN p >= 0.40 - 0.05 THEN 3 WHEN p >= 0.20 - 0.05 THEN 2 WHEN p >= 0.08 - 0.05 THEN 1 ELSE 0 END AS down, row_number() OVER (PARTITION BY entity_key ORDER BY as_of) AS k FROM ps),
rc AS (SELECT entity_key, k, as_of, up, CASE WHEN up > 0 THEN up ELSE 0 END AS l FROM lv WHERE k = 1 UNION ALL SELECT n.entity_key, n.k, n.as_of, n.up, CASE WHEN n.up > r.l THEN n.up WHEN n.down < r.l THEN n.down ELSE r.l END FROM rc r JOIN lv n ON n.entity_key = r.entity_key AND n.k = r.k + 1)
SELECT entity_key, as_of, ['NONE', 'INFO', 'WATCH', 'ALERT', 'CRITICAL'][up + 1] AS raw_level, ['NONE', 'INFO', 'WATCH', 'ALERT', 'CRITICAL'][l + 1] AS level FROM rc""")
def alert_hysteresis(spark, d):
    """Levels of every Monday that rise at once and fall only well below their bound."""
    tri = T.triangle(spark, d)
    p = vintage.visible(tri, full_grid(spark, tri)).frame.select("entity_key", "as_of", (1 - F.exp(-vintage.last_sum(c("s"), 26) / 3.0)).alias("p"))
    return decide.hysteresis(p, "entity_key", "as_of", "p").select("entity_key", "as_of", "raw_level", "level")


@query("trailing_windows", f"WITH {T.SERIES} SELECT entity_key, week, " + ", ".join(f"sum(y) OVER (PARTITION BY entity_key ORDER BY week ROWS {n - 1} PRECEDING) AS last_{n}" for n in (1, 4, 8, 13, 26, 52)) + ", CASE WHEN row_number() OVER (PARTITION BY entity_key ORDER BY week) >= 8 THEN sum(y) OVER (PARTITION BY entity_key ORDER BY week ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) ELSE 0 END AS previous_4, max(y) OVER (PARTITION BY entity_key ORDER BY week ROWS 12 PRECEDING) AS max_13, sum(CAST(y > 0 AS INT)) OVER (PARTITION BY entity_key ORDER BY week ROWS 51 PRECEDING)::BIGINT AS active_52 FROM ser")
def trailing_windows(spark, d):
    w = W.partitionBy("entity_key").orderBy("week")
    before = F.when(F.row_number().over(w) >= 8, F.sum("y").over(w.rowsBetween(-7, -4))).otherwise(0.0)
    return T.series(spark, d).select(
        "entity_key", "week", *(series.trailing("y", "entity_key", "week", n).alias(f"last_{n}") for n in (1, 4, 8, 13, 26, 52)), before.alias("previous_4"),
        series.trailing("y", "entity_key", "week", 13, F.max).alias("max_13"), F.sum((c("y") > 0).cast("long")).over(w.rowsBetween(-51, 0)).alias("active_52"),
    )


@query("anomaly_block", f"""WITH RECURSIVE {T.SERIES}, n AS (SELECT entity_key, week, y, row_number() OVER (PARTITION BY entity_key ORDER BY week) AS k FROM ser), h AS (SELECT entity_key, greatest(var_pop(ln(1 + y)), 0.25) AS v0 FROM n WHERE k <= 8 GROUP BY 1),
r AS (SELECT n.entity_key, n.k, n.week, ln(1 + y) AS level, 0.7 * v0 AS var, 0.0::DOUBLE AS z FROM n JOIN h USING (entity_key) WHERE k = 1
 UNION ALL SELECT n.entity_key, n.k, n.week, 0.3 * ln(1 + n.y) + 0.7 * r.level, 0.7 * r.var + 0.3 * (ln(1 + n.y) - r.level) ** 2, (ln(1 + n.y) - r.level) / greatest(sqrt(r.var), 0.5) FROM r JOIN n ON n.entity_key = r.entity_key AND n.k = r.k + 1),
gm AS (SELECT median(y) AS gm FROM ser), a AS (SELECT entity_key, week, ln(1 + y) AS v, y, CASE WHEN count(*) OVER b >= 2 THEN quantile_cont(y, 0.5) OVER b END AS m FROM ser WINDOW b AS (PARTITION BY entity_key ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT a.entity_key, a.week, round(v, 6) AS volume, round(z, 6) AS abnormal_volume, round(coalesce(v - 2 * lag(v) OVER w + lag(v, 2) OVER w, 0), 6) AS acceleration, round(least(25.0, greatest(0.0, (y + 1) / (coalesce(m, gm) + 1))), 6) AS baseline_ratio FROM a JOIN r ON r.entity_key = a.entity_key AND r.week = a.week, gm WINDOW w AS (PARTITION BY a.entity_key ORDER BY a.week)""")
def anomaly_block(spark, d):
    return rounded(series.anomaly_block(T.series(spark, d), "entity_key", "week", "y"))
