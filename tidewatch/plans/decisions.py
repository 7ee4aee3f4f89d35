"""Queries of source independence, nowcast core, decisions and scores at one as-of date, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import decide, families, independence, pit, vintage
from tidewatch.plans.registry import registry
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
c = F.col
#: Decisions are taken on this date; labels look LABEL_DAYS further.
DECIDE = "2024-12-02"
CUTOFF = "2024-12-31"


def r6(x, name):
    return F.round(x, 6).alias(name)


def one_date(spark, day: str = DECIDE):
    return pit.grid(spark, day, day).select(c("as_of").cast("date").alias("as_of"))


# --- independence ----------------------------------------------------------------------------------------------------


def _fold(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _cluster(x: str) -> str:
    return f"""CASE WHEN {_fold(x)} IN ('wahis', 'empresi') THEN 'official' WHEN {_fold(x)} IN ('gdelt', 'padiweb', 'promed', 'healthmap') THEN 'media' WHEN {_fold(x)} IN ('beacon', 'eios') THEN 'aggregator'
 WHEN {_fold(x)} IN ('era5', 'era5land', 'worldclim') THEN 'environmental' WHEN {_fold(x)} IN ('glw4', 'faostat') THEN 'exposure' ELSE 'unknown' END"""


def _rho(a: str, b: str) -> str:
    return f"""CASE WHEN {_fold(a)} = {_fold(b)} THEN 1.0 WHEN {_cluster(a)} = {_cluster(b)} THEN CASE {_cluster(a)} WHEN 'official' THEN 0.95 WHEN 'media' THEN 0.70 WHEN 'aggregator' THEN 0.55 WHEN 'environmental' THEN 0.80 WHEN 'exposure' THEN 0.60 ELSE 0.5 END
 WHEN {_cluster(a)} IN ('environmental', 'exposure') AND {_cluster(b)} IN ('environmental', 'exposure') THEN 0.10 ELSE 0.05 END::DOUBLE"""


def neff_sql(rows: str, keys: str) -> str:
    """CTEs s, q and ne(keys, n, n_clusters, n_eff) over ``rows`` by pairs of sources."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""s AS (SELECT {keys}, source_name, max(coalesce(reliability, 0.5)) AS w, {_cluster('source_name')} AS cl FROM ({rows}) WHERE source_name IS NOT NULL GROUP BY ALL),
q AS (SELECT {a_keys}, sum(a.w * b.w * {_rho('a.source_name', 'b.source_name')}) AS q FROM s a JOIN s b ON {on} GROUP BY ALL),
t AS (SELECT {keys}, sum(w) AS sw, count(*) AS n, count(DISTINCT cl) AS n_clusters FROM s GROUP BY ALL),
ne AS (SELECT t.*, CASE WHEN sw <= 0 THEN 0 WHEN q <= 0 THEN 1 ELSE least(n, greatest(1, sw * sw / q)) END::DOUBLE AS n_eff FROM t JOIN q USING ({keys}))"""


_NEFF = f"WITH {T.SIGNALS}, " + neff_sql("SELECT * FROM sg", "entity_key, week")


@query("n_eff", _NEFF + " SELECT entity_key, week, n AS n_sources, round(n_eff, 6) AS n_eff FROM ne")
def n_eff(spark, d):
    return independence.effective_sources(T.signals(spark, d), ["entity_key", "week"]).select("entity_key", "week", "n_sources", r6(c("n_eff"), "n_eff"))


@query("independence_report", f"WITH {T.SIGNALS}, " + neff_sql("SELECT * FROM sg", "entity_key") + """, cs AS (SELECT entity_key, string_agg(cl || '=' || names, ';' ORDER BY cl) AS by_cluster FROM (SELECT entity_key, cl, string_agg(source_name, ',' ORDER BY source_name) AS names FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT entity_key, n AS n_sources, n_clusters, round(n_eff, 3) AS n_eff, round(1 - n_eff / greatest(n, 1), 3) AS redundancy, by_cluster FROM ne JOIN cs USING (entity_key)""")
def independence_report(spark, d):
    """Sources, clusters, effective sources and redundancy of all signals of an entity, with the sources of each cluster."""
    found = independence.effective_sources(T.signals(spark, d), ["entity_key"])
    named = F.array_join(F.transform(F.array_sort(F.map_entries("by_cluster")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return found.select("entity_key", "n_sources", "n_clusters", F.round("n_eff", 3).alias("n_eff"), F.round(1 - c("n_eff") / F.greatest("n_sources", F.lit(1)), 3).alias("redundancy"), named.alias("by_cluster"))


@query("dependence_matrix", f"WITH {T.SIGNALS}, {T.EVENTS}, n AS (SELECT DISTINCT source_name FROM sg UNION SELECT DISTINCT source_name FROM ev UNION SELECT unnest(['ERA5', 'ERA5-Land', 'WorldClim', 'GLW4', 'FAOSTAT', 'EIOS', 'HealthMap'])) SELECT a.source_name AS a, b.source_name AS b, {_rho('a.source_name', 'b.source_name')} AS rho FROM n a, n b WHERE a.source_name IS NOT NULL AND b.source_name IS NOT NULL")
def dependence_matrix(spark, d):
    """Pairwise correlation of the sources seen and of those configured. The sources are a dimension of names."""
    more = spark.createDataFrame([(m,) for m in ("ERA5", "ERA5-Land", "WorldClim", "GLW4", "FAOSTAT", "EIOS", "HealthMap")], "source_name string")
    names = T.signals(spark, d).select("source_name").unionByName(T.events(spark, d).select("source_name")).unionByName(more).where(c("source_name").isNotNull()).distinct()
    return names.select(c("source_name").alias("a")).join(names.select(c("source_name").alias("b"))).select("a", "b", independence.correlation(c("a"), c("b")).alias("rho"))


_FUSED = "(SELECT entity_key, week, sum(coalesce(reliability, 0.5) * value) / greatest(sum(coalesce(reliability, 0.5)), 1e-9) AS mean, max(value) AS strongest, count(*) FILTER (WHERE value > 1) AS n_strong, max(available_from) AS available_from FROM {rows} GROUP BY 1, 2)"


@query("signal_fusion", _NEFF + f" SELECT entity_key, week, round(mean * n_eff / n, 6) AS fused, round(n_eff, 6) AS n_eff, round(strongest, 6) AS strongest, n_strong, available_from FROM {_FUSED.format(rows='sg')} JOIN ne USING (entity_key, week)")
def signal_fusion(spark, d):
    """Reliability-weighted mean of an entity's signals of a week, discounted by the dependence of their sources."""
    f = independence.fuse(T.signals(spark, d), ["entity_key", "week"])
    return f.select("entity_key", "week", r6(c("fused"), "fused"), r6(c("n_eff"), "n_eff"), r6(c("strongest"), "strongest"), "n_strong", "available_from")


# --- decisions -------------------------------------------------------------------------------------------------------

_SEEN = f"(SELECT * FROM sg WHERE signal_name IN {S.ANOMALIES} AND value IS NOT NULL)"
SCORED = f"""WITH RECURSIVE {T.vintage_sql(DECIDE)}, {T.SIGNALS.replace('sg AS', 'sg AS', 1)},
dl AS (SELECT disease, available_from - reference_date AS d FROM ev WHERE reference_date <= DATE '{DECIDE}' - 90 AND available_from - reference_date BETWEEN 0 AND 90),
wk AS (SELECT entity_key, disease, back - 1 AS b, y AS o, (DATE '{DECIDE}' - CAST(date_trunc('week', DATE '{DECIDE}') AS DATE)) + 7 * (back - 1) - 3 AS el FROM vn WHERE back <= 12),
els AS (SELECT DISTINCT el FROM wk WHERE el >= 0),
sh AS (SELECT disease, el, count(*) FILTER (WHERE d <= el) / count(*)::DOUBLE AS share, count(*) AS n FROM dl, els GROUP BY 1, 2), sha AS (SELECT el, count(*) FILTER (WHERE d <= el) / count(*)::DOUBLE AS share FROM dl, els GROUP BY 1),
cnt AS (SELECT disease, count(*) AS n FROM dl GROUP BY 1),
wp AS (SELECT wk.*, CASE WHEN wk.el < 0 THEN 0.25 ELSE greatest(0.25, coalesce(sh.share, sha.share, 1.0)) END AS p, coalesce(cnt.n, (SELECT count(*) FROM dl)) AS n FROM wk LEFT JOIN sh ON sh.disease = wk.disease AND sh.el = wk.el LEFT JOIN sha ON sha.el = wk.el LEFT JOIN cnt ON cnt.disease = wk.disease),
wu AS (SELECT *, (0.5 + o) * (1 - p) / (0.1 + p) AS u, (0.1 + p) / 1.1 AS q FROM wp),
nc AS (SELECT entity_key, sum(o) FILTER (WHERE b < 4) AS observed, sum(u) FILTER (WHERE b < 4) AS hidden, 2 * 1.6448536 * sqrt(sum((0.5 + o) * (1 - q) / (q * q)) FILTER (WHERE b < 4)) AS width, max(n) AS n_delays, max(p) FILTER (WHERE b = 5) AS rp FROM wu GROUP BY 1),
hk AS (SELECT entity_key, y, row_number() OVER (PARTITION BY entity_key ORDER BY week) AS j FROM vn WHERE back <= 52),
hr AS (SELECT entity_key, j, ln(1 + y) AS level, 0.0::DOUBLE AS trend FROM hk WHERE j = 1 UNION ALL SELECT hk.entity_key, hk.j, 0.35 * ln(1 + hk.y) + 0.65 * (r.level + 0.85 * r.trend), 0.15 * (0.35 * ln(1 + hk.y) + 0.65 * (r.level + 0.85 * r.trend) - r.level) + 0.85 * 0.85 * r.trend FROM hr r JOIN hk ON hk.entity_key = r.entity_key AND hk.j = r.j + 1),
fc AS (SELECT entity_key, greatest(0, exp(arg_max(level, j) + (0.85 + 0.85 * 0.85) * arg_max(trend, j)) - 1) AS forecast FROM hr GROUP BY 1),
{neff_sql(f'SELECT * FROM {_SEEN}', 'entity_key, week')},
fu AS (SELECT entity_key, week, available_from, mean * n_eff / n AS fused FROM {_FUSED.format(rows=_SEEN)} JOIN ne USING (entity_key, week)),
it AS (SELECT entity_key, arg_max(fused, week) AS intel FROM fu WHERE greatest(available_from, week) <= DATE '{DECIDE}' AND week >= DATE '{DECIDE}' - 90 GROUP BY 1),
pp AS (SELECT entity_key, 1 - exp(-sum(y) FILTER (WHERE back <= 26) / 3.0) AS p, sum(y) FILTER (WHERE back <= 8) / least(8, max(k)) AS rate FROM vn GROUP BY 1),
fu28 AS (SELECT entity_key, sum(count) AS f FROM tri WHERE available_week > DATE '{DECIDE}' AND available_week <= DATE '{DECIDE}' + 28 GROUP BY 1),
d0 AS (SELECT entity_key, observed, hidden, observed + hidden AS latent, width, n_delays, rp, forecast, coalesce(intel, 0) AS intel, p, CASE WHEN observed + hidden > 1e-9 THEN least(1, greatest(0, hidden / (observed + hidden))) ELSE 0 END AS gap,
  CAST(coalesce(f, 0) >= greatest(1.0, 1.5 * rate * 4) AS INT) AS label FROM nc JOIN fc USING (entity_key) JOIN pp USING (entity_key) LEFT JOIN it USING (entity_key) LEFT JOIN fu28 USING (entity_key)),
d1 AS (SELECT *, CASE WHEN latent > 0 THEN 1 / (1 + exp(-least(3.0, greatest(-1.0, forecast / greatest(latent, 1e-6) - 1)))) ELSE 0 END AS growth FROM d0),
sc AS (SELECT *, least(1.0, greatest(0.0, 0.34 * p + 0.22 * gap + 0.20 * (1 - exp(-latent / 5.0)) + 0.14 * growth + 0.10 / (1 + exp(-intel)))) AS priority,
  CASE WHEN p >= 0.65 THEN 'CRITICAL' WHEN p >= 0.4 THEN 'ALERT' WHEN p >= 0.2 THEN 'WATCH' WHEN p >= 0.08 THEN 'INFO' ELSE 'NONE' END AS level,
  least(1, greatest(0, 0.5 * rp + 0.3 / (1 + width / greatest(latent, 1)) + 0.2 * n_delays / (n_delays + 50.0))) AS confidence FROM d1)"""


def scored(spark, d, day: str = DECIDE):
    """Decisions at the as-of date from what was known by then; see ``decide.scores``."""
    events, tri = T.events(spark, d), T.triangle(spark, d)
    v = vintage.visible(tri, one_date(spark, day))
    fused = families.intelligence(T.signals(spark, d)).where(c("feature") == "intel_fused_anomaly")
    intel = families.store_panels(fused, v.grid, ["intel_fused_anomaly"], lags=()).select("entity_key", "as_of", c("intel_fused_anomaly").alias("intel"))
    return decide.scores(v, events, intel)


def labelled(spark, d, day: str = DECIDE):
    """Decisions with the label of the horizon that follows."""
    tri = T.triangle(spark, d)
    return scored(spark, d, day).join(decide.labels(tri, vintage.visible(tri, one_date(spark, day)), CUTOFF).select("entity_key", "as_of", "label"), ["entity_key", "as_of"])


@query("alert_level", SCORED + " SELECT entity_key, level FROM sc")
def alert_level(spark, d):
    return scored(spark, d).select("entity_key", "level")


@query("investigation_priority", SCORED + " SELECT entity_key, round(priority, 6) AS priority, round(growth, 6) AS growth, round(intel, 6) AS intel FROM sc")
def investigation_priority(spark, d):
    return scored(spark, d).select("entity_key", r6(c("priority"), "priority"), r6(c("growth"), "growth"), r6(c("intel"), "intel"))


@query("attention_list", SCORED + """, a AS (SELECT entity_key, level, round(priority, 6) AS priority, row_number() OVER (ORDER BY CASE level WHEN 'CRITICAL' THEN 0 WHEN 'ALERT' THEN 1 ELSE 2 END, round(priority, 6) DESC, entity_key) AS place FROM sc WHERE level IN ('WATCH', 'ALERT', 'CRITICAL')) SELECT * FROM a WHERE place <= 20""")
def attention_list(spark, d):
    """The twenty most urgent entities: CRITICAL before ALERT before WATCH, then by priority."""
    order = F.when(c("level") == "CRITICAL", 0).when(c("level") == "ALERT", 1).otherwise(2)
    ranked = scored(spark, d).where(c("level").isin("WATCH", "ALERT", "CRITICAL")).select("entity_key", "level", r6(c("priority"), "priority"))
    top = ranked.orderBy(order, F.desc("priority"), "entity_key").limit(20)
    return top.withColumn("place", F.row_number().over(decide.Window.orderBy(order, F.desc("priority"), "entity_key")))  # at most 20 rows


@query("gap_4w", SCORED + " SELECT entity_key, round(observed, 6) AS observed, round(hidden, 6) AS hidden, round(latent, 6) AS latent, round(gap, 6) AS gap FROM sc")
def gap_4w(spark, d):
    return scored(spark, d).select("entity_key", *(r6(c(x), x) for x in ("observed", "hidden", "latent", "gap")))


@query("nowcast_expected", SCORED + " SELECT entity_key, b AS weeks_back, o AS observed, round(p, 6) AS reporting_probability, round(u, 6) AS expected_unreported FROM wu")
def nowcast_expected(spark, d):
    """Expected unreported count of each of the last 12 weeks."""
    v = vintage.visible(T.triangle(spark, d), one_date(spark))
    weeks = decide.nowcast_core(v, T.events(spark, d)).select("entity_key", F.inline("weeks"))
    return weeks.select("entity_key", c("back").cast("long").alias("weeks_back"), c("o").alias("observed"), r6(c("p"), "reporting_probability"), r6(c("u"), "expected_unreported"))


@query("nowcast_confidence", SCORED + " SELECT entity_key, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.68 THEN 'high' WHEN confidence >= 0.40 THEN 'moderate' ELSE 'low' END AS band FROM sc")
def nowcast_confidence(spark, d):
    return scored(spark, d).select("entity_key", r6(c("confidence"), "confidence"), decide.band(c("confidence"), S.CONFIDENCE_BANDS).alias("band"))


@query("banding", SCORED + """ SELECT entity_key, CASE WHEN priority >= 0.72 THEN 'very_high' WHEN priority >= 0.52 THEN 'high' WHEN priority >= 0.30 THEN 'moderate' ELSE 'low' END AS priority_band,
 CASE WHEN gap >= 0.72 THEN 'severe' WHEN gap >= 0.50 THEN 'moderate' ELSE 'minor' END AS gap_band FROM sc""")
def banding(spark, d):
    return scored(spark, d).select("entity_key", decide.band(c("priority"), S.PRIORITY_BANDS).alias("priority_band"), decide.band(c("gap"), S.GAP_BANDS).alias("gap_band"))


@query("radar_kpis", SCORED + " SELECT count(*) FILTER (WHERE priority >= 0.30) AS n_30, count(*) FILTER (WHERE priority >= 0.52) AS n_52, count(*) FILTER (WHERE level IN ('WATCH', 'ALERT', 'CRITICAL')) AS n_attention, round(avg(gap), 6) AS mean_gap FROM sc")
def radar_kpis(spark, d):
    return scored(spark, d).agg(F.count_if(c("priority") >= 0.30).alias("n_30"), F.count_if(c("priority") >= 0.52).alias("n_52"), F.count_if(c("level").isin("WATCH", "ALERT", "CRITICAL")).alias("n_attention"), r6(F.avg("gap"), "mean_gap"))


_GATE = SCORED.replace("WITH RECURSIVE ", "WITH RECURSIVE ") + f""", k4 AS (SELECT * FROM sg WHERE available_from <= DATE '{DECIDE}' AND week > DATE '{DECIDE}' - 28 AND week <= DATE '{DECIDE}'),
{neff_sql('SELECT * FROM k4', 'entity_key').replace('s AS (', 'gs AS (', 1).replace('FROM s a JOIN s b', 'FROM gs a JOIN gs b').replace('q AS (', 'gq AS (', 1).replace('t AS (', 'gt AS (', 1).replace('FROM s GROUP', 'FROM gs GROUP').replace('ne AS (', 'gne AS (', 1).replace('SELECT t.*', 'SELECT gt.*').replace('FROM t JOIN q', 'FROM gt JOIN gq')}"""


@query("evidence_gate", _GATE + """ SELECT entity_key, level, round(coalesce(n_eff, 0), 6) AS n_eff, CASE WHEN level = 'CRITICAL' AND coalesce(n_eff, 0) >= 2.10 THEN 'CRITICAL' WHEN level IN ('CRITICAL', 'ALERT') AND coalesce(n_eff, 0) >= 1.35 THEN 'ALERT'
 WHEN level IN ('CRITICAL', 'ALERT') THEN 'WATCH' ELSE level END AS gated_level FROM sc LEFT JOIN gne USING (entity_key)""")
def evidence_gate(spark, d):
    """Levels capped where fewer independent sources than a level needs spoke in the last four weeks."""
    day = pit.day(DECIDE)
    known = T.signals(spark, d).where((c("available_from") <= day) & (c("week") > F.date_sub(day, 28)) & (c("week") <= day))
    n = independence.effective_sources(known, ["entity_key"]).select("entity_key", "n_eff")
    found = scored(spark, d).select("entity_key", "level").join(n, "entity_key", "left")
    return found.select("entity_key", "level", r6(F.coalesce("n_eff", F.lit(0.0)), "n_eff"), decide.gated(c("level"), c("n_eff")).alias("gated_level"))


# --- scores of predictions -------------------------------------------------------------------------------------------


@query("brier", SCORED + " SELECT round(avg((p - label) ** 2), 6) AS brier, count(*) AS n FROM sc")
def brier(spark, d):
    return labelled(spark, d).agg(r6(F.avg(F.pow(c("p") - c("label"), 2)), "brier"), F.count("*").alias("n"))


@query("ece", SCORED + ", b AS (SELECT greatest(0, least(9, CAST(ceil(p * 10) AS INT) - 1)) AS bin, avg(p) AS mp, avg(label) AS ml, count(*) AS n FROM sc GROUP BY 1) SELECT round(sum(n * abs(mp - ml)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    """Expected calibration error over ten bins of equal width, closed on the right."""
    b = labelled(spark, d).groupBy(F.greatest(F.lit(0), F.least(F.lit(9), F.ceil(c("p") * 10) - 1)).alias("bin")).agg(F.avg("p").alias("mp"), F.avg("label").alias("ml"), F.count("*").alias("n"))
    return b.agg(r6(F.sum(c("n") * F.abs(c("mp") - c("ml"))) / F.sum("n"), "ece"))


@query("reliability_bins", SCORED + """, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS es FROM sc)
SELECT len(list_filter(es, lambda x: x < p)) AS bin, round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS fraction_positive, count(*) AS n FROM sc, e GROUP BY 1""")
def reliability_bins(spark, d):
    """Mean prediction and positive share of ten quantile bins."""
    s = labelled(spark, d)
    edges = s.agg(F.percentile("p", F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("es"))
    b = s.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("es", lambda x: x < F.col("p"))).cast("long"))  # one row of edges
    return b.groupBy("bin").agg(r6(F.avg("p"), "mean_predicted"), r6(F.avg("label"), "fraction_positive"), F.count("*").alias("n"))


@query("roc_auc_rank", SCORED + ", r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM sc) SELECT round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM r")
def roc_auc_rank(spark, d):
    # ranks over distinct scores by range partitions, so no task holds all rows
    g = labelled(spark, d).groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    r = decide.prefix_sum(g, ["p"], "n", "below").withColumn("rk", c("below") + (c("n") + 1) / 2)
    np_, nn = F.sum("pos"), F.sum(c("n") - c("pos"))
    return r.agg(r6((F.sum(c("rk") * c("pos")) - np_ * (np_ + 1) / 2) / (np_ * nn), "auc"))


@query("pr_auc", SCORED + ", g AS (SELECT p, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1), r AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER () AS tp FROM g WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos / tp::DOUBLE * cp / cn), 6) AS pr_auc FROM r")
def pr_auc(spark, d):
    """Average precision: the precision at each distinct score, weighted by the recall it adds."""
    g = labelled(spark, d).groupBy((-c("p")).alias("o")).agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    r = decide.prefix_sum(decide.prefix_sum(g, ["o"], "n", "bn"), ["o"], "pos", "bp")
    precision = (c("bp") + c("pos")) / (c("bn") + c("n"))
    return r.agg(r6(F.sum(c("pos") * precision) / F.sum("pos"), "pr_auc"))


@query("calibration_slope", SCORED + " SELECT round(regr_slope(label, p), 6) AS slope, round(regr_intercept(label, p), 6) AS intercept FROM sc")
def calibration_slope(spark, d):
    return labelled(spark, d).agg(r6(F.regr_slope("label", "p"), "slope"), r6(F.regr_intercept("label", "p"), "intercept"))


@query("precision_at_k", SCORED + " SELECT round(avg(label), 6) AS precision FROM (SELECT label FROM sc ORDER BY p DESC, entity_key LIMIT 20)")
def precision_at_k(spark, d):
    return labelled(spark, d).orderBy(F.desc("p"), "entity_key").limit(20).agg(r6(F.avg("label"), "precision"))


@query("rank_average", SCORED + " SELECT entity_key, round(((row_number() OVER (ORDER BY p, entity_key) - 1) / (count(*) OVER () - 1)::DOUBLE + (row_number() OVER (ORDER BY gap, entity_key) - 1) / (count(*) OVER () - 1)::DOUBLE) / 2, 6) AS score FROM sc")
def rank_average(spark, d):
    """Mean over the members of the ordinal rank share, ranked without a window over all rows."""
    s = scored(spark, d).select("entity_key", "p", "gap")
    n = s.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    both = decide.ranks(decide.ranks(s, "p", "entity_key", "a"), "gap", "entity_key", "b")
    return both.crossJoin(F.broadcast(n)).select("entity_key", r6((c("a") / c("n") + c("b") / c("n")) / 2, "score"))  # one row


@query("coverage", SCORED + f", tw AS (SELECT entity_key, sum(count) AS final FROM tri WHERE week > DATE '{DECIDE}' - 28 AND week <= DATE '{DECIDE}' GROUP BY 1) SELECT round(avg(CAST(coalesce(final, 0) BETWEEN greatest(observed, latent - width / 2) AND latent + width / 2 AS INT)), 6) AS coverage, count(*) AS n FROM sc LEFT JOIN tw USING (entity_key)")
def coverage(spark, d):
    """Share of entities whose final count of the last four weeks lies in the nowcast's interval."""
    final = T.triangle(spark, d).where((c("week") > F.date_sub(pit.day(DECIDE), 28)) & (c("week") <= pit.day(DECIDE))).groupBy("entity_key").agg(F.sum("count").alias("final"))
    s = scored(spark, d).join(final, "entity_key", "left")
    inside = F.coalesce("final", F.lit(0)).between(F.greatest(c("observed"), c("latent") - c("width") / 2), c("latent") + c("width") / 2)
    return s.agg(r6(F.avg(inside.cast("double")), "coverage"), F.count("*").alias("n"))
