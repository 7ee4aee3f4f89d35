"""Alerts: predictions, nowcast and forecast of an (entity, as-of date) joined into one decision row with its explanation.

Joins on (entity_key, as_of) and expressions only; explanations, which are dear, are made for WATCH and above and for the
latest as-of date alone, before any row meets the features it is explained by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import settings as S
from tidewatch.operators import decide

KEY = ["entity_key", "as_of"]


def build(predictions: DataFrame, nowcast: DataFrame, forecast: DataFrame) -> DataFrame:
    """``predictions``: design rows with p and score. ``nowcast``: ``delay.recent_nowcast``. ``forecast``: FORECAST_SCHEMA.

    Rows without a nowcast give no alert; missing forecasts are null and give no growth."""
    h = lambda days, cols: [F.max(F.when(F.col("horizon_days") == days, F.col(c))).alias(f"{name}_{days}d") for c, name in cols]
    base = (("point", "forecast"), ("lower", "forecast_lower"), ("upper", "forecast_upper"))
    wide = forecast.groupBy(*KEY).agg(*h(7, base), *h(14, (*base, ("mean", "mean"), ("p_exceed", "p_exceed"), ("p_increase", "p_increase"))), *h(28, (*base, ("p_new", "p_new"))))
    rows = predictions.select(*KEY, "country", "disease", "p", "score", *(F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (
        ("obs_ewma_z", "temporal_anomaly"), ("spa_neighbour_activity_4w", "spatial_risk"), ("env_suitability", "environmental_signal"), ("exp_host_density_log", "livestock_exposure"),
        ("intel_fused_anomaly", "intelligence_signal"), ("hist_seasonal_baseline", "historical_baseline"))), F.coalesce("intel_effective_sources", F.lit(1.0)).alias("evidence_independence"))
    found = rows.join(nowcast.drop("country", "disease"), KEY).join(wide, KEY, "left")
    found = found.withColumn("growth", decide.growth(F.col("mean_14d"), F.col("latent")))
    found = found.withColumn("investigation_priority", decide.priority(F.col("p"), F.col("gap"), F.col("latent"), F.col("growth"), F.col("intelligence_signal")))
    return found.select(
        F.concat_ws("-", F.lit("AHR"), "country", "disease", F.col("as_of").cast("string")).alias("alert_id"), "*", decide.alert_level(F.col("p")).alias("alert_level"),
        decide.band(F.col("investigation_priority"), S.PRIORITY_BANDS).alias("priority_band"), decide.band(F.col("confidence"), S.CONFIDENCE_BANDS).alias("confidence_band"),
    )


def explained(alerts: DataFrame, predictions: DataFrame, model, k: int = 8) -> DataFrame:
    """Adds ``explanation``: headline, narrative, the k largest contributions and the family ablations, nested."""
    latest = alerts.agg(F.max("as_of").alias("_last"))
    chosen = alerts.crossJoin(F.broadcast(latest)).where(~F.col("alert_level").isin("NONE", "INFO") | (F.col("as_of") == F.col("_last"))).select(*KEY)  # one row
    rows = predictions.join(chosen, KEY, "left_semi")
    family = F.create_map(*(F.lit(x) for f in S.FAMILY_OF.items() for x in f))
    item = F.struct((-F.abs("contribution")).alias("o"), "feature", F.try_element_at(family, F.col("feature")).alias("family"), "value", "contribution", decide.direction(F.col("contribution")).alias("direction"))
    top = model.contributions(rows, KEY).groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("c"))
    delta = F.col("p_with") - F.col("p_without")
    lost = F.struct((-F.abs(delta)).alias("o"), "family", "n_features", "p_with", "p_without", delta.alias("delta"), decide.interpretation(F.col("family"), F.col("p_with"), F.col("p_without")).alias("interpretation"))
    cut = model.ablations(rows, KEY).groupBy(*KEY).agg(F.array_sort(F.collect_list(lost)).alias("a"))
    percent = F.concat(F.format_string("%.0f", F.col("p") * 100), F.lit("%"))
    headline = F.concat(F.when(F.col("p") >= 0.4, "Model-indicated elevated official-visibility probability ").otherwise("Model-indicated early-warning probability "), percent)
    named = F.array_join(F.transform(F.slice("c", 1, 3), lambda x: F.concat(x["feature"], F.lit(" ("), F.format_string("%+.2f", x["contribution"]), F.lit(")"))), "; ")
    deferred = F.concat(F.lit("Early-warning probability "), percent)
    joined = alerts.join(top, KEY, "left").join(cut, KEY, "left")
    drop = lambda x: x.dropFields("o")
    made = F.struct(
        F.when(F.col("c").isNotNull(), headline).otherwise(deferred).alias("headline"), F.when(F.col("c").isNotNull(), F.concat(F.lit("Top contributions: "), named)).otherwise("Deferred.").alias("narrative"),
        F.transform("c", drop).alias("top_contributions"), F.transform("a", drop).alias("counterfactuals"),
    )
    return joined.withColumn("explanation", made).drop("c", "a")
