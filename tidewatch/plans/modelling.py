"""Queries of delay fits, latent-state nowcast, early-warning model, forecast ensemble and alerts. What SQL can't fit is
checked by tests: recovery of known parameters, brute force in numpy, held-out accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import alerts as A
from tidewatch.operators import decide, delay, families, models, pit, vintage
from tidewatch.plans.decisions import CUTOFF, DECIDE, SCORED, one_date, r6, scored
from tidewatch.plans.features import feature_store, full_grid, rounded, split_of, targets
from tidewatch.plans.registry import registry
from tidewatch.session import checkpointed
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
c = F.col


# --- delays and nowcast ----------------------------------------------------------------------------------------------


@query("delay_observations", f"WITH {T.EVENTS}, {T.PLACES} SELECT disease, coalesce(tier, 'medium') AS tier, CAST(available_from - reference_date AS INT) AS delay, CAST(DATE '{DECIDE}' - reference_date AS INT) AS truncation, count(*) AS n FROM ev LEFT JOIN pl USING (country) WHERE available_from <= DATE '{DECIDE}' AND available_from - reference_date BETWEEN 0 AND 90 GROUP BY ALL")
def delay_observations(spark, d):
    """Delays known at the as-of date with their truncation, by disease and surveillance tier."""
    refits = one_date(spark).withColumnRenamed("as_of", "refit")
    found = delay.observations(T.events(spark, d), T.places(spark, d), refits)
    return found.select("disease", "tier", "delay", "truncation", "n")


@query("delay_fits")
def delay_fits(spark, d):
    """Parameters, moments and P(reported within 7, 14, 28, 60 days) of each group at the as-of date."""
    refits = one_date(spark).withColumnRenamed("as_of", "refit")
    found = delay.fits(T.events(spark, d), T.places(spark, d), refits)
    return rounded(found.select("grp", "family", "p1", "p2", "n", "log_likelihood", "aic", "pooled", "weight", "mean", "median", "p90", *(F.element_at("cdf", k + 1).alias(f"p_{k}d") for k in (7, 14, 28, 60))))


@query("ascertainment_mean", f"WITH {T.EVENTS}, {T.PLACES}, m(tier, m) AS (VALUES ('high', 22.0 / 25), ('medium', 16.0 / 21), ('low', 10.0 / 18)) SELECT DISTINCT ev.entity_key, tier, round(least(1.0, greatest(0.05, m * CASE disease WHEN 'ASF' THEN 0.92 ELSE 1.0 END)), 6) AS ascertainment FROM ev JOIN pl USING (country) JOIN m USING (tier)")
def ascertainment_mean(spark, d):
    keys = T.events(spark, d).select("entity_key", "country", "disease").distinct().join(T.places(spark, d).select("country", "tier"), "country")
    return keys.select("entity_key", "tier", r6(delay.ascertainment_mean(c("tier"), c("disease")), "ascertainment"))


@query("latent_scale", SCORED + f", {T.PLACES}, m(tier, m) AS (VALUES ('high', 22.0 / 25), ('medium', 16.0 / 21), ('low', 10.0 / 18)), e AS (SELECT DISTINCT entity_key, country, disease FROM ev) SELECT sc.entity_key, round(forecast, 6) AS point, round(forecast / greatest(least(1.0, greatest(0.05, m * CASE e.disease WHEN 'ASF' THEN 0.92 ELSE 1.0 END)), 1e-6), 6) AS point_latent_scale FROM sc JOIN e ON e.entity_key = sc.entity_key JOIN pl USING (country) JOIN m USING (tier)")
def latent_scale(spark, d):
    """Two-week forecasts of reports on the scale of true events."""
    s = scored(spark, d).join(T.places(spark, d).select("country", "tier"), "country")
    return s.select("entity_key", r6(c("forecast"), "point"), r6(delay.latent_scale(c("forecast"), delay.ascertainment_mean(c("tier"), c("disease"))), "point_latent_scale"))


@query("nowcast")
def nowcast(spark, d):
    """Latent burden of the last 12 weeks of every entity by seeded draws; see ``delay.nowcast``."""
    v = vintage.visible(T.triangle(spark, d), one_date(spark))
    return rounded(delay.nowcast(v, T.events(spark, d), T.places(spark, d)))


# --- early warning ---------------------------------------------------------------------------------------------------


def panel(spark, d):
    """Design rows of every Monday of the calendar, with labels, written once."""
    tri, events, places = T.triangle(spark, d), T.events(spark, d), T.places(spark, d)
    v = vintage.visible(tri, full_grid(spark, tri))
    design = families.assemble(v, places, feature_store(spark, d), delay.reporting_features(v, events, places))
    labelled = design.join(decide.labels(tri, v, CUTOFF), families.KEY, "left").withColumn("split", split_of(c("as_of")))
    return checkpointed(labelled)


def _fitted(rows, kind="logistic", features=S.MODEL_FEATURES, **more):
    return models.EarlyWarning(features, kind, **more).fit(rows.where("label_observable"))


@query("early_warning")
def early_warning(spark, d):
    """Metrics of the calibrated classifier by split (logistic; ``kind='gbt'`` gives the boosted trees)."""
    rows = panel(spark, d)
    return rounded(models.metrics(_fitted(rows).predict(rows.where("label_observable"))))


@query("early_warning_official_only")
def early_warning_official_only(spark, d):
    """Metrics of the official-record-only model, the boosted-tree model and their stack, by split."""
    rows = panel(spark, d).where("label_observable")
    one = _fitted(rows, features=models.OFFICIAL_ONLY, calibration="none").predict(rows).withColumnRenamed("p", "official").drop("score")
    two = _fitted(rows, "gbt", calibration="none", rounds=30).predict(one).withColumnRenamed("p", "trees").drop("score")
    _, both = models.stack(checkpointed(two.select("split", "label", "official", "trees")), ["official", "trees"])
    out = None
    for name in ("official", "trees", "stacked"):
        part = models.metrics(both.select("split", "label", c(name).alias("p"))).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("feature_importance")
def feature_importance(spark, d):
    rows = panel(spark, d)
    return rounded(_fitted(rows).importance(spark))


@query("family_importance")
def family_importance(spark, d):
    """Importance summed over the evidence families, the largest first."""
    return feature_importance(spark, d).groupBy("family").agg(r6(F.sum("importance"), "importance"), F.count("*").alias("n_features")).orderBy(F.desc("importance"), "family")


@query("percentile_of", f"""WITH {T.TRIANGLE}, x AS (SELECT entity_key, sum(count)::DOUBLE AS v FROM tri WHERE available_week <= DATE '{DECIDE}' GROUP BY 1), q AS (SELECT quantile_cont(v, [{', '.join(f'{i / 100}' for i in range(101))}]) AS g FROM x)
SELECT entity_key, v AS value, least(1.0, greatest(0.0, len(list_filter(g, lambda y: y < v)) / 100.0)) AS percentile FROM x, q""")
def percentile_of(spark, d):
    """Where an entity's visible burden stands among all: the number of grid quantiles (0 to 100 %) below it, over 100."""
    x = T.triangle(spark, d).where(c("available_week") <= pit.day(DECIDE)).groupBy("entity_key").agg(F.sum("count").cast("double").alias("value"))
    grid = x.agg(F.percentile("value", F.array(*(F.lit(i / 100) for i in range(101)))).alias("g"))
    share = F.size(F.filter("g", lambda y: y < c("value"))) / 100
    return x.crossJoin(F.broadcast(grid)).select("entity_key", "value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("percentile"))  # one row


_TERMS = SCORED + ", x AS (SELECT entity_key, priority, unnest([struct_pack(f := 'probability', v := 0.34 * p), struct_pack(f := 'gap', v := 0.22 * gap), struct_pack(f := 'growth', v := 0.14 * growth), struct_pack(f := 'intelligence', v := 0.10 / (1 + exp(-intel)) - 0.05)]) AS t FROM sc)"


def _terms(spark, d):
    s = scored(spark, d)
    w = S.PRIORITY
    parts = {"probability": w["probability"] * c("p"), "gap": w["gap"] * c("gap"), "growth": w["growth"] * c("growth"), "intelligence": w["intelligence"] * decide.sigmoid(c("intel")) - 0.05}
    return s.select("entity_key", "priority", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), v.alias("v")) for k, v in parts.items()))).alias("t"))


@query("topk_abs", _TERMS + ", r AS (SELECT entity_key, t.f AS term, round(t.v, 6) AS value, row_number() OVER (PARTITION BY entity_key ORDER BY round(abs(t.v), 9) DESC, t.f) AS place FROM x) SELECT * FROM r WHERE place <= 2")
def topk_abs(spark, d):
    """The two terms that contribute most to each entity's priority, by absolute value."""
    items = F.array_sort(F.collect_list(F.struct((-F.round(F.abs("t.v"), 9)).alias("o"), c("t.f").alias("f"), c("t.v").alias("v"))))
    top = _terms(spark, d).groupBy("entity_key").agg(F.slice(items, 1, 2).alias("top"))
    return top.select("entity_key", F.posexplode("top").alias("i", "x")).select("entity_key", c("x.f").alias("term"), r6(c("x.v"), "value"), (c("i") + 1).cast("long").alias("place"))


@query("contribution_direction", _TERMS + """ SELECT entity_key, t.f AS term, CASE WHEN t.v > 1e-6 THEN 'increases_risk' WHEN t.v < -1e-6 THEN 'decreases_risk' ELSE 'neutral' END AS direction,
 CASE WHEN abs(t.v) < 0.01 THEN 'Removing ' || t.f || ' barely changes the assessment.' WHEN t.v > 0 THEN 'Without ' || t.f || ' the assessment falls.' ELSE 'Without ' || t.f || ' the assessment rises.' END AS reading FROM x""")
def contribution_direction(spark, d):
    """Direction of each term and what its absence would change."""
    t = _terms(spark, d)
    text = decide.interpretation(c("t.f"), c("priority"), c("priority") - c("t.v"))
    short = F.when(text.contains("barely"), text).when(text.contains("falls"), F.concat(F.lit("Without "), c("t.f"), F.lit(" the assessment falls."))).otherwise(F.concat(F.lit("Without "), c("t.f"), F.lit(" the assessment rises.")))
    return t.select("entity_key", c("t.f").alias("term"), decide.direction(c("t.v")).alias("direction"), short.alias("reading"))


# --- forecast and alerts ---------------------------------------------------------------------------------------------


def _forecast_panel(spark, d, rows, v):
    asked = rows.select("entity_key", "as_of", "country", "disease", *models.FORECAST_FEATURES).withColumn("horizon_days", F.explode(F.array(*map(F.lit, S.HORIZONS))))
    asked = asked.withColumn("target_week", vintage.week_start(F.expr("date_add(as_of, horizon_days)")))
    means = families.structural(v)
    out = asked.join(means, ["entity_key", "as_of", "horizon_days"], "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ("mu_damped_trend", "mu_seasonal_climatology")})


def forecasts(spark, d, rows, levels):
    """(ensemble, forecasts of the decision date): fitted on complete targets of the years before."""
    tri = T.triangle(spark, d)
    v = vintage.visible(tri, full_grid(spark, tri))
    whole = checkpointed(_forecast_panel(spark, d, rows, v))
    fit = whole.join(targets(spark, d).where("target_complete").select("entity_key", "as_of", "horizon_days", "target_reported_final"), ["entity_key", "as_of", "horizon_days"])
    ensemble = models.Ensemble().fit(checkpointed(fit), "2023-06-30")
    now = whole.where(c("as_of") == pit.day(DECIDE)).join(levels, families.KEY, "left")
    return ensemble, ensemble.predict(now)


@query("forecast")
def forecast(spark, d):
    """Ensemble forecasts 7, 14 and 28 days ahead at the decision date."""
    v = vintage.visible(T.triangle(spark, d), one_date(spark))
    level = delay.recent_nowcast(delay.nowcast(v, T.events(spark, d), T.places(spark, d))).select("entity_key", "as_of", c("latent").alias("level"))
    return rounded(forecasts(spark, d, panel(spark, d), level)[1])


@query("count_glm")
def count_glm(spark, d):
    """Standardised coefficients of the count regression for the 7-day horizon, and its dispersion."""
    tri = T.triangle(spark, d)
    v = vintage.visible(tri, full_grid(spark, tri))
    design = families.temporal(v).join(families.baseline(v), families.KEY)
    rows = design.join(targets(spark, d).where("target_complete and horizon_days = 7"), families.KEY)
    glm = models.CountGLM([f for f in models.FORECAST_FEATURES if f in design.columns]).fit(checkpointed(rows), "target_reported_final")
    return spark.createDataFrame([("(intercept)", float(glm.beta[0])), ("(dispersion)", glm.alpha), *((f, float(b)) for f, b in zip(glm.kept, glm.beta[1:]))], "term string, value double")


@query("alerts")
def alerts(spark, d):
    """The decision date's alerts: classifier, nowcast, forecast and explanation joined."""
    rows = panel(spark, d)
    model = _fitted(rows)
    now = checkpointed(model.predict(rows.where(c("as_of") == pit.day(DECIDE))))
    v = vintage.visible(T.triangle(spark, d), one_date(spark))
    recent = checkpointed(delay.recent_nowcast(delay.nowcast(v, T.events(spark, d), T.places(spark, d))))
    _, ahead = forecasts(spark, d, rows, recent.select("entity_key", "as_of", c("latent").alias("level")))
    return rounded(A.explained(A.build(now, recent, checkpointed(ahead)), now, model))
