"""Published settings of the surveillance panel. All of these are fixed values that results depend on."""

from __future__ import annotations

# Clusters of sources that aren't independent, and the correlation of two sources of one cluster.
CLUSTERS = {
    "official": (0.95, ("WAHIS", "EMPRES-i")),
    "media": (0.70, ("GDELT", "PADIWeb", "ProMED", "HealthMap")),
    "aggregator": (0.55, ("BEACON", "EIOS")),
    "environmental": (0.80, ("ERA5", "ERA5-Land", "WorldClim")),
    "exposure": (0.60, ("GLW4", "FAOSTAT")),
}
#: Correlation inside the cluster of unlisted sources, and of two different clusters, except the pairs named.
UNKNOWN_WITHIN, CROSS_DEFAULT = 0.5, 0.05
#: Pairs are looked up by their sorted names; the published settings for official, media and aggregator pairs are written
#: in the other order, so that the default holds for them.
CROSS = {("environmental", "exposure"): 0.10}

# Lower bounds of the alert levels on a probability, of priority, confidence and reporting-gap bands.
LEVELS = (("NONE", None), ("INFO", 0.08), ("WATCH", 0.20), ("ALERT", 0.40), ("CRITICAL", 0.65))
PRIORITY_BANDS = (("low", None), ("moderate", 0.30), ("high", 0.52), ("very_high", 0.72))
CONFIDENCE_BANDS = (("low", None), ("moderate", 0.40), ("high", 0.68))
GAP_BANDS = (("minor", None), ("moderate", 0.50), ("severe", 0.72))
#: Lowering a level needs a probability this far below its bound; a change needs this many weeks in a row.
ESCALATE_MARGIN, DEESCALATE_MARGIN, PERSISTENCE_WEEKS = 0.00, 0.05, 1
#: Effective independent sources that a level needs.
GATES = {"ALERT": 1.35, "CRITICAL": 2.10}
# Weights of the investigation priority.
PRIORITY = {"probability": 0.34, "gap": 0.22, "latent": 0.20, "growth": 0.14, "intelligence": 0.10}

# Labels and nowcast.
LABEL_DAYS, ESCALATION, RUN_RATE_WEEKS = 28, 1.5, 8
MAX_DELAY_DAYS, NOWCAST_WEEKS, MIN_REPORTED, MIDPOINT_DAYS = 90, 12, 0.25, 3
PRIOR_SHAPE, PRIOR_RATE = 0.5, 0.1
ASCERTAINMENT = {"high": (22.0, 3.0), "medium": (16.0, 5.0), "low": (10.0, 8.0)}
DISEASE_MULTIPLIER = {"HPAI": 1.00, "ASF": 0.92}
HORIZONS = (7, 14, 28)

# Environmental response and host species of the configured diseases.
ENVIRONMENT = {
    "HPAI": {"optimum": 4.0, "tolerance": 7.5, "precipitation": 0.18, "cold": 0.35},
    "ASF": {"optimum": 19.0, "tolerance": 11.0, "precipitation": -0.10, "cold": 0.05},
}
HOST = {"HPAI": "chickens", "ASF": "pigs"}
SPATIAL_KM, BORDER_BONUS, NO_ACTIVE_KM = 900.0, 0.35, 6000.0

# The feature families and their features, in the order of the design matrix.
FAMILIES = {
    "temporal": (
        "obs_last_1w", "obs_last_4w", "obs_last_8w", "obs_last_13w", "obs_last_26w", "obs_last_52w", "obs_active_weeks_52w", "obs_weeks_since_last",
        "obs_log_growth_4w", "obs_ewma_z", "obs_max_week_13w", "obs_is_currently_reporting",
    ),
    "spatial": ("spa_neighbour_activity_4w", "spa_neighbour_activity_13w", "spa_neighbour_growth", "spa_neighbour_active_share", "spa_nearest_active_km", "spa_border_pressure"),
    "baseline": ("hist_seasonal_baseline", "hist_seasonal_baseline_log", "hist_excess_over_baseline", "hist_years_of_history", "hist_ever_reported", "hist_annual_mean"),
    "environmental": ("env_suitability", "env_suitability_4w", "env_suitability_trend", "env_temp_anomaly_c", "env_precip_anomaly_mm", "env_cold_snap_index", "env_t2m_mean_c"),
    "exposure": ("exp_host_density_log", "exp_host_density_rank", "exp_national_stock_log", "exp_stock_trend"),
    "intelligence": (
        "intel_fused_anomaly", "intel_fused_anomaly_lag1", "intel_fused_anomaly_lag4", "intel_effective_sources", "intel_max_anomaly", "intel_corroborating_sources",
        "gdelt_abnormal_volume", "gdelt_acceleration", "gdelt_source_diversity", "gdelt_baseline_ratio", "padiweb_abnormal_volume", "padiweb_event_rate", "padiweb_mean_relevance",
        "beacon_abnormal_volume", "beacon_verified_signals", "beacon_max_strength", "healthmap_abnormal_volume", "healthmap_unique_alerts", "promed_confidence_weighted", "eios_abnormal_volume",
    ),
    "reporting": ("rep_expected_delay_days", "rep_median_delay_days", "rep_delay_p90_days", "rep_reporting_probability", "rep_p_reported_14d"),
}
MODEL_FEATURES = tuple(f for members in FAMILIES.values() for f in members)
FAMILY_OF = {f: family for family, members in FAMILIES.items() for f in members}
#: Features whose natural absence is zero; others take the median of their as-of date.
ZERO_FILLED = ("obs_", "spa_", "hist_", "intel_", "gdelt_", "padiweb_", "beacon_", "healthmap_", "promed_", "eios_")
# Signals that are anomalies and can be fused, and those kept as they are.
ANOMALIES = ("gdelt_abnormal_volume", "padiweb_abnormal_volume", "beacon_abnormal_volume", "healthmap_abnormal_volume", "eios_abnormal_volume")
KEPT_SIGNALS = (
    "gdelt_acceleration", "gdelt_source_diversity", "gdelt_baseline_ratio", "gdelt_tone_negativity", "padiweb_acceleration", "padiweb_event_rate",
    "padiweb_mean_relevance", "beacon_verified_signals", "beacon_verified_strength", "beacon_max_strength", "beacon_media_dependence",
    "healthmap_unique_alerts", "healthmap_duplicate_share", "promed_confidence_weighted", "promed_post_count", "eios_retained_items", "eios_mean_relevance",
)
# Single-feature rules that a model is compared with.
HEURISTICS = {
    "ewma_control_chart": "obs_ewma_z", "recent_activity": "obs_last_4w", "seasonal_excess": "hist_excess_over_baseline",
    "intelligence_only": "intel_fused_anomaly", "neighbour_activity": "spa_neighbour_activity_4w", "environmental_only": "env_suitability_4w",
}
