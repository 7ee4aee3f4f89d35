"""Queries of the point-in-time algebra, the reporting triangle and the feature store, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch.functions.missing import code, date_value
from tidewatch.operators import decide, pit
from tidewatch.plans.registry import registry
from tidewatch.session import checkpointed, table
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
AS_OF = "2022-06-06"
#: The media signals cover a shorter history.
MEDIA_AS_OF = "2024-12-02"
#: The SQL of store_panel has to name its columns; the query takes all features of the store, which are these.
FEATURES = ("news_article_count", "padiweb_event_count", "gdelt_abnormal_volume", "beacon_signal_strength", "healthmap_alert_count")
STORE = T.SIGNALS + """, st AS (SELECT entity_key, week, signal_name AS feature, CASE WHEN greatest(available_from, week) IS NULL THEN NULL ELSE greatest(available_from, week) END AS available_from, round(avg(value), 6) AS value FROM sg GROUP BY 1, 2, 3, 4)"""


def store(spark, d):
    """Feature store in long form: (entity, week, feature, availability, value)."""
    return T.signals(spark, d).groupBy("entity_key", "week", F.col("signal_name").alias("feature"), F.greatest("available_from", "week").alias("available_from")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("asof_filter", f"WITH {T.EVENTS} SELECT event_id, entity_key, reference_date, available_from FROM ev WHERE available_from <= DATE '{AS_OF}' AND reference_date BETWEEN DATE '2021-01-01' AND DATE '{AS_OF}'")
def asof_filter(spark, d):
    return pit.filter_as_of(T.events(spark, d), AS_OF, reference="reference_date", low="2021-01-01", high=AS_OF).select("event_id", "entity_key", "reference_date", "available_from")


@query("asof_latest", f"WITH {T.EVENTS} SELECT entity_key, available_from, event_id, cases FROM ev WHERE available_from <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY available_from DESC, event_id DESC) = 1")
def asof_latest(spark, d):
    return pit.latest_as_of(T.events(spark, d), AS_OF, ["entity_key"], ["available_from", "event_id"], ["cases"])


@query("asof_violations", f"WITH {T.EVENTS} SELECT count(*) FILTER (WHERE available_from > DATE '{AS_OF}') AS n_violations, max(available_from) FILTER (WHERE available_from > DATE '{AS_OF}') AS worst FROM ev")
def asof_violations(spark, d):
    return pit.violations(T.events(spark, d), AS_OF)


@query("attach_availability", f"WITH {T.EVENTS} SELECT event_id, greatest(reference_date + 10, DATE '2020-01-01') AS available FROM ev")
def attach_availability(spark, d):
    return T.events(spark, d).select("event_id", pit.attach_availability(F.col("reference_date"), 10, "2020-01-01").alias("available"))


@query("asof_grid", "SELECT CAST(unnest(generate_series(TIMESTAMP '2019-01-07', TIMESTAMP '2024-12-30', INTERVAL 7 DAY)) AS DATE) AS as_of")
def asof_grid(spark, d):
    return pit.grid(spark, "2019-01-07", "2024-12-30").select(F.col("as_of").cast("date").alias("as_of"))


@query("store_validate", f"""WITH {T.SIGNALS} SELECT signal_name AS feature, count(*) AS n, count(*) FILTER (WHERE available_from < week) AS n_leaking, count(*) FILTER (WHERE available_from < reference_date) AS n_early FROM sg GROUP BY 1""")
def store_validate(spark, d):
    s = T.signals(spark, d)
    return s.groupBy(F.col("signal_name").alias("feature")).agg(F.count("*").alias("n"), F.count_if(F.col("available_from") < F.col("week")).alias("n_leaking"), F.count_if(F.col("available_from") < F.col("reference_date")).alias("n_early"))


@query("store_asof_long", f"WITH {STORE} SELECT * FROM st WHERE available_from <= DATE '{MEDIA_AS_OF}' AND week <= DATE '{MEDIA_AS_OF}' AND week >= DATE '{MEDIA_AS_OF}' - 56")
def store_asof_long(spark, d):
    s = pit.filter_as_of(store(spark, d), MEDIA_AS_OF)
    return s.where((F.col("week") <= pit.day(MEDIA_AS_OF)) & (F.col("week") >= F.date_sub(pit.day(MEDIA_AS_OF), 56))).select("entity_key", "week", "feature", "available_from", "value")


@query("store_latest", f"WITH {STORE} SELECT entity_key, feature, week, available_from, value FROM st WHERE available_from <= DATE '{MEDIA_AS_OF}' QUALIFY row_number() OVER (PARTITION BY entity_key, feature ORDER BY week DESC, available_from DESC) = 1")
def store_latest(spark, d):
    return pit.latest_as_of(store(spark, d), MEDIA_AS_OF, ["entity_key", "feature"], ["week", "available_from"], ["value"])


_PANEL = ", ".join(
    f"arg_max(value, week) FILTER (WHERE feature = '{f}') AS {f}, CAST((DATE '{MEDIA_AS_OF}' - max(week) FILTER (WHERE feature = '{f}')) / 7 AS INT) AS {f}_staleness_weeks, "
    + ", ".join(f"max(value) FILTER (WHERE feature = '{f}' AND week = DATE '{MEDIA_AS_OF}' - {7 * k}) AS {f}_lag{k}" for k in (1, 4))
    for f in FEATURES
)


@query("store_panel", f"""WITH {STORE}, c AS (SELECT entity_key, week, feature, arg_max(value, struct_pack(a := available_from, v := value)) AS value FROM st WHERE available_from <= DATE '{MEDIA_AS_OF}' AND week <= DATE '{MEDIA_AS_OF}' AND week >= DATE '{MEDIA_AS_OF}' - 84 GROUP BY 1, 2, 3)
SELECT entity_key, {_PANEL} FROM c GROUP BY 1""")
def store_panel(spark, d):
    return pit.panel_as_of(store(spark, d), MEDIA_AS_OF)


@query("availability_profile", f"WITH {T.SIGNALS} SELECT signal_name AS feature, median(available_from - reference_date) AS median_lag, max(available_from - reference_date) AS max_lag, count(*) AS n FROM sg GROUP BY 1")
def availability_profile(spark, d):
    """Lags of a feature: counted per whole day first, so that a feature is a few hundred rows."""
    lags = T.signals(spark, d).groupBy(F.col("signal_name").alias("feature"), F.datediff("available_from", "reference_date").alias("lag")).agg(F.count("*").alias("n"))
    return lags.groupBy("feature").agg(F.percentile("lag", F.lit(0.5), F.col("n")).alias("median_lag"), F.max("lag").alias("max_lag"), F.sum("n").alias("n"))


@query("store_catalogue", f"WITH {T.SIGNALS} SELECT signal_name AS feature, count(DISTINCT entity_key) AS n_entities, string_agg(DISTINCT source_name, ';' ORDER BY source_name) AS sources FROM sg GROUP BY 1")
def store_catalogue(spark, d):
    return T.signals(spark, d).groupBy(F.col("signal_name").alias("feature")).agg(F.count_distinct("entity_key").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("source_name")), ";").alias("sources"))


@query("reporting_triangle", f"WITH {T.TRIANGLE} SELECT entity_key, week, available_week, count, delay_weeks FROM tri")
def reporting_triangle(spark, d):
    return T.triangle(spark, d).select("entity_key", "week", "available_week", "count", "delay_weeks")


@query("vintage_series", f"WITH {T.EVENTS} SELECT entity_key, week, CAST(sum(outbreaks) AS BIGINT) AS y FROM ev WHERE available_from <= DATE '{AS_OF}' AND week <= DATE '{AS_OF}' GROUP BY 1, 2")
def vintage_series(spark, d):
    return pit.vintage(T.events(spark, d), AS_OF)


@query("published_between", f"WITH {T.EVENTS} SELECT entity_key, CAST(sum(outbreaks) AS BIGINT) AS total FROM ev WHERE available_from > DATE '2022-05-09' AND available_from <= DATE '{AS_OF}' GROUP BY 1")
def published_between(spark, d):
    return pit.between(T.events(spark, d), "available_from", "2022-05-09", AS_OF)


@query("occurred_between", f"WITH {T.EVENTS} SELECT entity_key, CAST(sum(outbreaks) AS BIGINT) AS total FROM ev WHERE week > DATE '2022-05-09' AND week <= DATE '{AS_OF}' GROUP BY 1")
def occurred_between(spark, d):
    return pit.between(T.events(spark, d), "week", "2022-05-09", AS_OF)


@query("final_series", f"WITH {T.SERIES} SELECT * FROM ser")
def final_series(spark, d):
    return T.series(spark, d)


@query("delay_profile", f"WITH {T.TRIANGLE} SELECT delay_weeks, CAST(sum(count) AS BIGINT) AS n, round(sum(count) / sum(sum(count)) OVER (), 6) AS share FROM tri GROUP BY 1")
def delay_profile(spark, d):
    g = T.triangle(spark, d).groupBy("delay_weeks").agg(F.sum("count").alias("n"))
    return g.select("delay_weeks", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("scan_parquet", "SELECT event_id, country_iso3, cases FROM canonical_events WHERE cases > 100")
def scan_parquet(spark, d):
    return table(spark, d, "canonical_events").where(F.col("cases") > 100).select("event_id", "country_iso3", "cases")


@query("scan_filter_project", "SELECT event_id, disease_raw, outbreaks FROM canonical_events WHERE regexp_matches(lower(disease_raw), 'influenza|avian|hpai')")
def scan_filter_project(spark, d):
    return table(spark, d, "canonical_events").where(F.lower("disease_raw").rlike("influenza|avian|hpai")).select("event_id", "disease_raw", "outbreaks")


@query("provenance_dedup", "SELECT upper(trim(provenance_id)) AS provenance_id, CAST(epoch(max(retrieved_at)) AS BIGINT) AS retrieved_at, count(*) AS n_copies FROM source_provenance GROUP BY 1")
def provenance_dedup(spark, d):
    return table(spark, d, "source_provenance").groupBy(code(F.col("provenance_id")).alias("provenance_id")).agg(F.unix_seconds(F.max("retrieved_at").cast("timestamp")).alias("retrieved_at"), F.count("*").alias("n_copies"))


@query("panel_centroids", f"WITH {T.EVENTS} SELECT country, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(lat) AS n FROM ev GROUP BY 1")
def panel_centroids(spark, d):
    return T.events(spark, d).groupBy("country").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("lat").alias("n"))


@query("lead_time", f"""WITH {T.EVENTS}, n AS (SELECT DISTINCT entity_key, notification_date AS nd FROM ev WHERE notification_date IS NOT NULL),
w AS (SELECT *, CASE WHEN nd - lag(nd) OVER (PARTITION BY entity_key ORDER BY nd) < 56 THEN 0 ELSE 1 END AS new FROM n),
e AS (SELECT *, sum(new) OVER (PARTITION BY entity_key ORDER BY nd) AS episode FROM w),
ep AS (SELECT entity_key, CAST(episode AS BIGINT) AS episode, min(nd) AS first_date, max(nd) AS last_date, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS as_of FROM (SELECT date_trunc('week', min(reference_date)) AS a, max(greatest(available_from, notification_date)) AS b FROM ev)),
sc AS (SELECT entity_key, as_of, 1 - exp(-sum(outbreaks) / 3.0) AS p FROM ev JOIN g ON available_from <= as_of AND reference_date <= as_of AND reference_date > as_of - 182 GROUP BY 1, 2),
x AS (SELECT ep.entity_key, ep.episode, min(CASE WHEN p >= 0.40 THEN as_of END) AS first_alert, max(p) AS max_p FROM ep JOIN sc ON sc.entity_key = ep.entity_key AND sc.as_of < ep.first_date GROUP BY 1, 2),
c AS (SELECT ep.*, first_alert, round(max_p, 6) AS max_p, first_alert IS NOT NULL AS detected, first_date - first_alert AS lead_days FROM ep LEFT JOIN x USING (entity_key, episode)),
r AS (SELECT count(*) AS n_episodes, count(*) FILTER (WHERE detected) AS n_detected, round(avg(CAST(detected AS INT)), 6) AS detection_rate, quantile_cont(lead_days, 0.25) AS lead_days_p25,
  quantile_cont(lead_days, 0.5) AS lead_days_median, quantile_cont(lead_days, 0.75) AS lead_days_p75, round(avg(lead_days), 6) AS lead_days_mean FROM c)
SELECT * FROM c, r""")
def lead_time(spark, d):
    """Lead time by episode of official notifications per entity (quiet gap of 56 days), and the report over all episodes.

    An episode is detected if the score of a week before its first date reached the alert level; lead_days run from the
    first such week. Every row carries the report: episodes, detected ones and their share, quantiles and mean of lead_days.
    """
    from tidewatch.operators.series import episodes

    ev = T.events(spark, d)
    n = ev.where(F.col("notification_date").isNotNull()).select("entity_key", F.col("notification_date").alias("nd")).distinct()
    found = episodes(n, "entity_key", "nd").groupBy("entity_key", "episode").agg(F.min("nd").alias("first_date"), F.max("nd").alias("last_date"), F.count("*").alias("n"))
    return with_lead_time(found, weekly_scores(ev))


def weekly_scores(ev):
    """(entity_key, as_of, p): the score of ``decide.scores`` on every Monday of the events' span, left out where it is 0."""
    first, last = ev.agg(F.date_trunc("week", F.min("reference_date")).cast("date").alias("a"), F.max(F.greatest("available_from", "notification_date")).alias("b")).first()
    if first is None:
        return ev.sparkSession.createDataFrame([], "entity_key string, as_of date, p double")
    grid = pit.grid(ev.sparkSession, str(first), str(last)).select(F.col("as_of").cast("date").alias("as_of"))
    return pit.many_as_of(ev, grid, 26).select("entity_key", "as_of", (1 - F.exp(-F.col("activity") / 3.0)).alias("p"))


def with_lead_time(found, scores):
    """``found``: episodes with entity_key and first_date."""
    first = pit.first_crossing(scores, found.select("entity_key", F.col("first_date").alias("event_date")), dict(decide.LEVELS)["ALERT"])
    cases = checkpointed(
        found.join(first.withColumnRenamed("event_date", "first_date"), ["entity_key", "first_date"], "left")
        .withColumn("detected", F.col("first_alert").isNotNull())
        .withColumn("lead_days", F.datediff("first_date", "first_alert"))
    )
    at = lambda q: F.percentile("lead_days", F.lit(q))
    report = cases.agg(
        F.count("*").alias("n_episodes"), F.count_if("detected").alias("n_detected"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("detection_rate"),
        at(0.25).alias("lead_days_p25"), at(0.5).alias("lead_days_median"), at(0.75).alias("lead_days_p75"), F.round(F.avg("lead_days"), 6).alias("lead_days_mean"),
    )
    return cases.crossJoin(F.broadcast(report))


@query("asof_join", f"""WITH {T.SIGNALS}, {T.EVENTS} SELECT e.event_id, arg_max(s.value, struct_pack(r := s.reference_date, a := s.available_from, i := s.signal_id)) AS last_value FROM ev e JOIN sg s ON s.entity_key = e.entity_key AND s.signal_name = 'beacon_signal_strength' AND s.reference_date <= e.reference_date AND s.available_from <= e.reference_date GROUP BY 1""")
def asof_join(spark, d):
    from tidewatch.operators.versions import as_known

    s = T.signals(spark, d).where(F.col("signal_name") == "beacon_signal_strength")
    e = T.events(spark, d).select("event_id", "entity_key", "reference_date")
    found = as_known(e, F.col("entity_key"), F.col("reference_date"), s, F.col("entity_key"), [F.col("reference_date"), F.col("available_from")], [F.col("reference_date"), F.col("available_from"), F.col("signal_id")], F.col("value").cast("string"))
    return found.select("event_id", F.col("chosen").cast("double").alias("last_value"))


@query("period_start", f"WITH {T.EVENTS} SELECT event_id, CAST(date_trunc('week', reference_date) AS DATE) AS week, CAST(date_trunc('month', reference_date) AS DATE) AS month FROM ev")
def period_start(spark, d):
    return T.events(spark, d).select("event_id", F.date_trunc("week", "reference_date").cast("date").alias("week"), F.date_trunc("month", "reference_date").cast("date").alias("month"))


@query("iso_calendar", "SELECT DISTINCT reference_date AS day, CAST(extract(isoyear FROM reference_date) AS INT) AS iso_year, CAST(extract(week FROM reference_date) AS INT) AS iso_week FROM signal_records WHERE reference_date IS NOT NULL")
def iso_calendar(spark, d):
    return table(spark, d, "signal_records").select(date_value(F.col("reference_date")).alias("day")).where("day is not null").distinct().select("day", F.expr("extract(yearofweek from day)").cast("int").alias("iso_year"), F.weekofyear("day").alias("iso_week"))


@query("fourier_terms", "SELECT DISTINCT reference_date AS day, " + ", ".join(f"round({fn}(2 * pi() * {k} * (reference_date - DATE '2020-01-06') / 7.0 / 52.18), 6) AS {fn}_{k}" for k in (1, 2) for fn in ("sin", "cos")) + " FROM signal_records WHERE reference_date IS NOT NULL")
def fourier_terms(spark, d):
    """Two seasonal harmonics of each day, by weeks since 2020-01-06."""
    turn = lambda k: 2 * F.pi() * k * (F.datediff("day", pit.day("2020-01-06")) / 7.0) / 52.18
    days = table(spark, d, "signal_records").select(F.col("reference_date").alias("day")).where("day is not null").distinct()
    return days.select("day", *(F.round((F.sin if fn == "sin" else F.cos)(turn(k)), 6).alias(f"{fn}_{k}") for k in (1, 2) for fn in ("sin", "cos")))
