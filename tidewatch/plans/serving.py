"""Queries of entity resolution, crossings and the read-only serving views, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.missing import code, date_value, text_value
from tidewatch.operators import decide, pit, resolve, series, vintage
from tidewatch.plans.analytics import _PAIRS
from tidewatch.plans.decisions import DECIDE, r6
from tidewatch.plans.features import _GRID, full_grid
from tidewatch.plans.registry import registry
from tidewatch.session import table
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
c = F.col
#: Replays look at this date: later weeks are known, and so are its signals.
REPLAY = "2024-10-07"


# --- entity resolution -----------------------------------------------------------------------------------------------

_CITE = f"""WITH RECURSIVE {T.EVENTS}, ce AS (SELECT e.event_id AS a, o.event_id AS b FROM ev e JOIN ev o ON o.event_id = e.cited AND o.event_id <> e.event_id), cd AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce),
re AS (SELECT a AS s, a AS t FROM cd UNION SELECT re.s, cd.b FROM re JOIN cd ON cd.a = re.t), cc AS (SELECT e.event_id, coalesce(min(re.t), e.event_id) AS cluster FROM ev e LEFT JOIN re ON re.s = e.event_id GROUP BY e.event_id)"""


def _cited(spark, d):
    ev = T.events(spark, d)
    return ev, resolve.components(ev.select(c("event_id").alias("v")), resolve.citations(ev)).select(c("v").alias("event_id"), c("root").alias("cluster"))


@query("connected_components", _CITE + " SELECT event_id, cluster FROM cc")
def connected_components(spark, d):
    """Clusters by explicit citation; the smallest record names a cluster."""
    return _cited(spark, d)[1]


@query("cluster_summary", _CITE + """ SELECT cluster, count(*) AS n_records, count(DISTINCT source_name) AS n_sources, string_agg(DISTINCT source_name, ';' ORDER BY source_name) AS sources, min(available_from) AS first_seen, coalesce(bool_or(is_official), FALSE) AS has_official,
 coalesce(min(reference_date) FILTER (WHERE is_official), min(reference_date)) AS anchor, max(reference_date) FILTER (WHERE is_official) AS last_official, round(avg(lat) FILTER (WHERE is_official), 6) AS lat, round(avg(lon) FILTER (WHERE is_official), 6) AS lon,
 CAST(coalesce(sum(outbreaks) FILTER (WHERE is_official), 0) AS BIGINT) AS burden, CASE WHEN min(available_from) FILTER (WHERE is_official) IS NOT NULL THEN greatest(0, min(available_from) FILTER (WHERE is_official) - min(available_from)) END AS lead_days FROM ev JOIN cc USING (event_id) GROUP BY 1""")
def cluster_summary(spark, d):
    ev, members = _cited(spark, d)
    return resolve.summaries(ev, members).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("join_interval_match", _PAIRS + " SELECT i, j, days FROM s")
def join_interval_match(spark, d):
    from tidewatch.operators import geo

    return geo.interval_candidates(T.events(spark, d)).select("i", "j", "days")


@query("resolve_entities")
def resolve_entities(spark, d):
    """Records with their cluster after both rules; tests compare with a plain sequential merge."""
    return resolve.resolve(T.events(spark, d))[0]


@query("linkage_audit")
def linkage_audit(spark, d):
    """The accepted merges, with rule, score and detail."""
    return resolve.resolve(T.events(spark, d))[1]


@query("window_aggback", f"WITH {T.EVENTS} SELECT event_id, outbreaks, count(*) OVER w AS n_group, CAST(sum(outbreaks) OVER w AS BIGINT) AS group_outbreaks, min(available_from) OVER w AS group_first FROM ev WINDOW w AS (PARTITION BY entity_key, week)")
def window_aggback(spark, d):
    """Group aggregates merged to the detail: aggregated first, so that a hot group is joined and never sorted as a whole."""
    ev = T.events(spark, d)
    g = ev.groupBy("entity_key", "week").agg(F.count("*").alias("n_group"), F.sum("outbreaks").alias("group_outbreaks"), F.min("available_from").alias("group_first"))
    return ev.join(g, ["entity_key", "week"]).select("event_id", "outbreaks", "n_group", "group_outbreaks", "group_first")


# --- predictions and crossings ---------------------------------------------------------------------------------------

_PS = f"""{_GRID}, kn AS (SELECT entity_key, disease, min(greatest(week, available_week)) AS since FROM tri GROUP BY 1, 2), pan AS (SELECT entity_key, disease, as_of, least(as_of, w1) AS wn FROM kn, g, sp WHERE since <= as_of),
pd AS (SELECT p.entity_key, p.disease, p.as_of, round(1 - exp(-coalesce(sum(count), 0) / 3.0), 6) AS p, CAST(coalesce(sum(count) FILTER (WHERE t.week > p.wn - 28), 0) AS DOUBLE) AS observed FROM pan p LEFT JOIN tri t ON t.entity_key = p.entity_key AND t.available_week <= p.as_of AND t.week <= p.wn AND t.week > p.wn - 182 GROUP BY 1, 2, 3),
pred AS (SELECT *, CASE WHEN p >= 0.65 THEN 'CRITICAL' WHEN p >= 0.4 THEN 'ALERT' WHEN p >= 0.2 THEN 'WATCH' WHEN p >= 0.08 THEN 'INFO' ELSE 'NONE' END AS level FROM pd)"""


def predictions(spark, d):
    """(entity_key, disease, as_of, p, observed, level) of every Monday, as a scored panel is served."""
    tri = T.triangle(spark, d)
    s = c("s")
    rows = vintage.visible(tri, full_grid(spark, tri)).frame.select("entity_key", "disease", "as_of", r6(1 - F.exp(-vintage.last_sum(s, 26) / 3.0), "p"), vintage.last_sum(s, 4).alias("observed"))
    return rows.withColumn("level", decide.alert_level(c("p")))


@query("predictions_as_of", f"WITH {T.TRIANGLE}, {_PS} SELECT * FROM pred WHERE as_of = DATE '{DECIDE}' AND disease = 'HPAI'")
def predictions_as_of(spark, d):
    """Predictions of one date and disease."""
    return predictions(spark, d).where((c("as_of") == pit.day(DECIDE)) & (c("disease") == "HPAI"))


@query("entity_series", f"WITH {T.TRIANGLE}, {_PS} SELECT as_of, p, observed, level FROM pred WHERE entity_key = (SELECT entity_key FROM tri GROUP BY 1 ORDER BY sum(count) DESC, entity_key LIMIT 1)")
def entity_series(spark, d):
    """The scored series of one entity, here the one with the largest burden."""
    top = T.triangle(spark, d).groupBy("entity_key").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "entity_key").limit(1).select("entity_key")
    return predictions(spark, d).join(F.broadcast(top), "entity_key", "left_semi").orderBy("as_of").select("as_of", "p", "observed", "level")


@query("alert_crossing", f"WITH {T.TRIANGLE}, {_PS} SELECT entity_key, min(as_of) FILTER (WHERE level IN ('WATCH', 'ALERT', 'CRITICAL')) AS first_watch, min(as_of) FILTER (WHERE level IN ('ALERT', 'CRITICAL')) AS first_alert, min(as_of) FILTER (WHERE level = 'CRITICAL') AS first_critical FROM pred GROUP BY 1")
def alert_crossing(spark, d):
    return crossings(predictions(spark, d))


def crossings(frame, until=None, suffix=""):
    """First dates on which each level or a higher one was reached."""
    seen = F.lit(True) if until is None else c("as_of") <= pit.day(until)
    at = lambda *levels: F.min(F.when(c("level").isin(*levels) & seen, c("as_of")))
    return frame.groupBy("entity_key").agg(at("WATCH", "ALERT", "CRITICAL").alias(f"first_watch{suffix}"), at("ALERT", "CRITICAL").alias(f"first_alert{suffix}"), at("CRITICAL").alias(f"first_critical{suffix}"))


@query("first_crossing", f"""WITH {T.TRIANGLE}, {_PS}, n AS (SELECT DISTINCT entity_key, notification_date AS nd FROM ev WHERE notification_date IS NOT NULL), w AS (SELECT *, CASE WHEN nd - lag(nd) OVER (PARTITION BY entity_key ORDER BY nd) < 56 THEN 0 ELSE 1 END AS new FROM n), ep AS (SELECT entity_key, nd FROM w WHERE new = 1)
SELECT ep.entity_key, nd AS notification_date, min(as_of) FILTER (WHERE p >= 0.40) AS first_cross, nd - min(as_of) FILTER (WHERE p >= 0.40) AS lead_days, max(p) AS max_before, arg_min(p, as_of) FILTER (WHERE p >= 0.40) AS p_at_cross FROM ep LEFT JOIN pred ON pred.entity_key = ep.entity_key AND as_of < nd GROUP BY 1, 2""")
def first_crossing(spark, d):
    """Earliest date before each episode's first notification on which the probability reached the alert level."""
    n = T.events(spark, d).where(c("notification_date").isNotNull()).select("entity_key", c("notification_date").alias("nd")).distinct()
    first = series.episodes(n, "entity_key", "nd").groupBy("entity_key", "episode").agg(F.min("nd").alias("nd")).drop("episode")
    # an entity's scores and episodes are bounded by the calendar
    both = first.join(predictions(spark, d).select("entity_key", "as_of", "p"), "entity_key", "left").where(c("as_of").isNull() | (c("as_of") < c("nd")))
    over = c("p") >= 0.40
    g = both.groupBy("entity_key", "nd").agg(F.min(F.when(over, c("as_of"))).alias("first_cross"), F.max("p").alias("max_before"), F.min_by(F.when(over, c("p")), F.when(over, c("as_of"))).alias("p_at_cross"))
    out = first.join(g, ["entity_key", "nd"], "left")
    return out.select("entity_key", c("nd").alias("notification_date"), "first_cross", F.datediff("nd", "first_cross").alias("lead_days"), "max_before", "p_at_cross")


# --- serving ---------------------------------------------------------------------------------------------------------


@query("evidence_timeline", f"""WITH {T.TRIANGLE}, {T.SIGNALS}, {_PS}, x AS (SELECT entity_key, min(as_of) AS ts, 'Model crosses ' || level AS event, 'model' AS family, 0 AS kind, '' AS id, arg_min(p, as_of) AS value FROM pred WHERE as_of <= DATE '{DECIDE}' AND level IN ('WATCH', 'ALERT', 'CRITICAL') GROUP BY entity_key, level),
s AS (SELECT entity_key, available_from AS ts, signal_name AS event, source_name AS family, 1 AS kind, signal_id AS id, value FROM sg WHERE available_from BETWEEN DATE '{DECIDE}' - 60 AND DATE '{DECIDE}' QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY available_from DESC, signal_id DESC) <= 12)
SELECT entity_key, ts, event, family, round(value, 6) AS value FROM (SELECT * FROM x UNION ALL SELECT * FROM s) QUALIFY row_number() OVER (PARTITION BY entity_key, ts, event ORDER BY kind, id) = 1""")
def evidence_timeline(spark, d):
    """For every entity: first crossing of each exact level, and the last 12 signals of the 60 days before the as-of date; of
    equal (day, event) the first stands."""
    day = pit.day(DECIDE)
    seen = predictions(spark, d).where((c("as_of") <= day) & c("level").isin("WATCH", "ALERT", "CRITICAL"))
    x = seen.groupBy("entity_key", "level").agg(F.min("as_of").alias("ts"), F.min_by("p", "as_of").alias("value")).select("entity_key", "ts", F.concat(F.lit("Model crosses "), "level").alias("event"), F.lit("model").alias("family"), F.lit(0).alias("kind"), F.lit("").alias("id"), "value")
    near = T.signals(spark, d).where(c("available_from").between(F.date_sub(day, 60), day))
    # Spark keeps twelve rows a key before the shuffle (window group limit)
    last = near.withColumn("n", pit.by_latest(["entity_key"], F.desc("available_from"), F.desc("signal_id"))).where("n <= 12")
    s = last.select("entity_key", c("available_from").alias("ts"), c("signal_name").alias("event"), c("source_name").alias("family"), F.lit(1).alias("kind"), c("signal_id").alias("id"), "value")
    one = x.unionByName(s).groupBy("entity_key", "ts", "event").agg(F.min(F.struct("kind", "id", "family", "value")).alias("m"))
    return one.select("entity_key", "ts", "event", c("m.family").alias("family"), r6(c("m.value"), "value"))


_LEDGER = f"led AS (SELECT DISTINCT upper(trim(provenance_id)) AS pid, record_id, source_name, available_from FROM source_provenance WHERE available_from <= DATE '{DECIDE}')"


@query("provenance_lookup", f"""WITH {T.EVENTS}, {_LEDGER}, ents AS (SELECT DISTINCT entity_key, country, disease FROM ev),
sp AS (SELECT DISTINCT upper(trim(country_iso3)) || '|' || upper(trim(disease)) AS entity_key, upper(trim(provenance_id)) AS pid FROM signal_records WHERE available_from BETWEEN DATE '1970-01-02' AND DATE '{DECIDE}'),
t1 AS (SELECT entity_key, led.*, 1 AS tier FROM ents JOIN sp USING (entity_key) JOIN led USING (pid)),
t2 AS (SELECT entity_key, led.*, 2 AS tier FROM ents JOIN led ON upper(regexp_extract(record_id, '([A-Za-z]{{3}})-([A-Za-z0-9]+)', 1)) = country AND upper(regexp_extract(record_id, '([A-Za-z]{{3}})-([A-Za-z0-9]+)', 2)) = disease AND entity_key NOT IN (SELECT entity_key FROM t1)),
top AS (SELECT * FROM led ORDER BY available_from DESC, pid, record_id, source_name LIMIT 40), t3 AS (SELECT entity_key, top.*, 3 AS tier FROM ents, top WHERE entity_key NOT IN (SELECT entity_key FROM t1 UNION SELECT entity_key FROM t2))
SELECT entity_key, record_id, source_name, available_from, tier FROM (SELECT entity_key, pid, record_id, source_name, available_from, tier FROM t1 UNION ALL SELECT entity_key, pid, record_id, source_name, available_from, tier FROM t2 UNION ALL SELECT entity_key, pid, record_id, source_name, available_from, tier FROM t3) QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY available_from DESC, pid, record_id, source_name) <= 40""")
def provenance_lookup(spark, d):
    """For every entity the 40 latest ledger entries known at the as-of date: those its signals point to; without any, those
    whose record id names the entity; without any, the latest of all."""
    day = pit.day(DECIDE)
    ents = T.events(spark, d).select("entity_key", "country", "disease").distinct()
    ledger = table(spark, d, "source_provenance").where(c("available_from") <= day).select(code(c("provenance_id")).alias("pid"), "record_id", "source_name", "available_from").distinct()
    raw = table(spark, d, "signal_records").where(date_value(c("available_from")) <= day)
    linked = raw.select(F.concat_ws("|", code(c("country_iso3")), code(c("disease"))).alias("entity_key"), code(c("provenance_id")).alias("pid")).distinct()
    keep = lambda f, tier: f.select("entity_key", "pid", "record_id", "source_name", "available_from", F.lit(tier).alias("tier"))
    one = keep(ents.join(linked, "entity_key").join(ledger, "pid"), 1)
    part = lambda k: F.upper(F.regexp_extract("record_id", "([A-Za-z]{3})-([A-Za-z0-9]+)", k))
    rest = ents.join(one.select("entity_key").distinct(), "entity_key", "left_anti")
    two = keep(rest.join(ledger.select("*", part(1).alias("country"), part(2).alias("disease")), ["country", "disease"]), 2)
    none = rest.join(two.select("entity_key").distinct(), "entity_key", "left_anti")
    top = ledger.orderBy(F.desc("available_from"), "pid", "record_id", "source_name").limit(40)
    three = keep(none.crossJoin(F.broadcast(top)), 3)  # 40 rows
    both = one.unionByName(two).unionByName(three)
    return both.withColumn("n", pit.by_latest(["entity_key"], F.desc("available_from"), c("pid"), c("record_id"), c("source_name"))).where("n <= 40").select("entity_key", "record_id", "source_name", "available_from", "tier")


_HEAD = f"""WITH a AS (SELECT upper(trim(country_iso3)) || '|' || upper(trim(disease)) AS entity_key, trim(summary) AS headline, publication_date AS published, trim(source_name) AS source FROM canonical_events WHERE trim(source_name) = 'PADI-web'
  UNION ALL SELECT upper(trim(country_iso3)) || '|' || upper(trim(disease)), trim(summary), publication_date, trim(source_name) FROM alert_events WHERE trim(source_name) IN ('BEACON', 'EIOS')),
k AS (SELECT DISTINCT entity_key, headline, published, source, CASE source WHEN 'PADI-web' THEN 0 WHEN 'BEACON' THEN 1 ELSE 2 END AS o FROM a WHERE entity_key IS NOT NULL AND published BETWEEN DATE '1970-01-02' AND DATE '{DECIDE}' AND lower(headline) NOT IN {T._FILL}),
l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY entity_key, source ORDER BY published DESC, headline) <= CASE source WHEN 'EIOS' THEN 10 ELSE 20 END),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity_key, headline ORDER BY o, published DESC) = 1)"""


@query("headlines", _HEAD + " SELECT entity_key, published, source, headline FROM u QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY published DESC, headline) <= 20")
def headlines(spark, d):
    """The latest 20 headlines of every entity from three sources (20, 20 and 10 of each); equal headlines count once."""
    cols = lambda t: table(spark, d, t).select(code(c("country_iso3")).alias("country"), code(c("disease")).alias("disease"), text_value(c("summary")).alias("headline"), date_value(c("publication_date")).alias("published"), F.trim("source_name").alias("source"))
    both = cols("canonical_events").where("source = 'PADI-web'").unionByName(cols("alert_events").where(c("source").isin("BEACON", "EIOS")))
    order = F.when(c("source") == "PADI-web", 0).when(c("source") == "BEACON", 1).otherwise(2)
    known = both.where(c("country").isNotNull() & c("disease").isNotNull() & c("headline").isNotNull() & (c("published") <= pit.day(DECIDE))).select(F.concat_ws("|", "country", "disease").alias("entity_key"), "headline", "published", "source", order.alias("o")).distinct()
    latest = known.withColumn("n", F.row_number().over(W.partitionBy("entity_key", "source").orderBy(F.desc("published"), "headline"))).where("n <= 20").where((c("source") != "EIOS") | (c("n") <= 10))
    once = latest.groupBy("entity_key", "headline").agg(F.min(F.struct("o", (-F.unix_date("published")).alias("d"), "published", "source")).alias("m")).select("entity_key", "headline", "m.published", "m.source")
    return once.withColumn("n", pit.by_latest(["entity_key"], F.desc("published"), c("headline"))).where("n <= 20").select("entity_key", "published", "source", "headline")


_SEM = "CASE WHEN month(reference_date) <= 6 THEN make_date(year(reference_date), 6, 30) ELSE make_date(year(reference_date), 12, 31) END"
_TOKENS = "present|disease present|confirmed infection|infection|suspected"


@query("semester_status", f"""SELECT upper(trim(country_iso3)) || '|' || upper(trim(disease)) AS entity_key, {_SEM} AS semester_end, max(CAST(regexp_matches(lower(coalesce(event_status, '')), '{_TOKENS}') OR regexp_matches(lower(coalesce(confirmation_status, '')), '{_TOKENS}') AS INT)) AS present, max(greatest(available_from, {_SEM})) AS knowable
FROM (SELECT * REPLACE (CASE WHEN available_from {T._OK} THEN available_from END AS available_from) FROM canonical_events WHERE reference_date {T._OK}) WHERE country_iso3 IS NOT NULL AND disease IS NOT NULL GROUP BY 1, 2""")
def semester_status(spark, d):
    """Semester ends of each entity with the flag that a status label tells presence, and when the semester was knowable."""
    e = table(spark, d, "canonical_events").select(code(c("country_iso3")).alias("country"), code(c("disease")).alias("disease"), date_value(c("reference_date")).alias("r"), date_value(c("available_from")).alias("a"), "event_status", "confirmation_status")
    end = semester_end(c("r"))
    flag = F.lower(F.coalesce("event_status", F.lit(""))).rlike(_TOKENS) | F.lower(F.coalesce("confirmation_status", F.lit(""))).rlike(_TOKENS)
    rows = e.where(c("r").isNotNull() & c("country").isNotNull() & c("disease").isNotNull())
    return rows.groupBy(F.concat_ws("|", "country", "disease").alias("entity_key"), end.alias("semester_end")).agg(F.max(flag.cast("int")).alias("present"), F.max(F.greatest(c("a"), end)).alias("knowable"))


def semester_end(day):
    year = F.year(day)
    return F.when(F.month(day) <= 6, F.make_date(year, F.lit(6), F.lit(30))).otherwise(F.make_date(year, F.lit(12), F.lit(31)))


# Semester reports stand in for six-month reports: the burden of the semester, knowable 75 days after its end.
_SV = f"""sm AS (SELECT entity_key, {_SEM} AS semester_end, {_SEM} + 75 AS knowable, sum(outbreaks)::DOUBLE AS new_outbreaks FROM ev GROUP BY 1, 2),
mk AS (SELECT entity_key, coalesce(min(as_of) FILTER (WHERE level IN ('ALERT', 'CRITICAL') AND as_of <= DATE '{REPLAY}'), min(as_of) FILTER (WHERE level IN ('WATCH', 'ALERT', 'CRITICAL') AND as_of <= DATE '{REPLAY}'), min(as_of) FILTER (WHERE level IN ('ALERT', 'CRITICAL')), min(as_of) FILTER (WHERE level IN ('WATCH', 'ALERT', 'CRITICAL'))) AS marker FROM pred GROUP BY 1),
tr AS (SELECT sm.*, marker, CASE WHEN (semester_end - 183 <= coalesce(marker, DATE '{REPLAY}') AND coalesce(marker, DATE '{REPLAY}') <= semester_end) OR (semester_end - 183 <= DATE '{REPLAY}' AND DATE '{REPLAY}' <= semester_end) THEN 0 WHEN semester_end < DATE '{REPLAY}' AND DATE '{REPLAY}' - semester_end <= 45 THEN 1 ELSE 2 END AS tier FROM sm LEFT JOIN mk USING (entity_key) WHERE knowable > DATE '{REPLAY}'),
sv AS (SELECT entity_key, semester_end, knowable, new_outbreaks, tier, new_outbreaks > 0 AS validates, knowable - coalesce(marker, DATE '{REPLAY}') AS lead_days FROM tr QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY CASE WHEN tier <= 1 THEN 0 ELSE 1 END, knowable, tier, semester_end) = 1)"""


def semesters(spark, d):
    ev = T.events(spark, d)
    end = semester_end(c("reference_date"))
    return ev.groupBy("entity_key", end.alias("semester_end")).agg(F.sum("outbreaks").cast("double").alias("new_outbreaks")).withColumn("knowable", F.date_add("semester_end", 75))


def markers(frame):
    """The date of model concern: ALERT by the replay date, else WATCH by it, else the first ALERT or WATCH at all."""
    early, any_ = crossings(frame, REPLAY, "_then"), crossings(frame)
    return early.join(any_, "entity_key").withColumn("marker", F.coalesce("first_alert_then", "first_watch_then", "first_alert", "first_watch"))


def validated(semester_rows, marked):
    """The semester report that can support the replay: overlapping or just closed ones before later ones, the earliest
    knowable first."""
    day = pit.day(REPLAY)
    at = F.coalesce("marker", day)
    rows = semester_rows.where(c("knowable") > day).join(marked.select("entity_key", "marker"), "entity_key", "left")
    start = F.date_sub("semester_end", 183)
    overlaps = ((start <= at) & (at <= c("semester_end"))) | ((start <= day) & (day <= c("semester_end")))
    tier = F.when(overlaps, 0).when((c("semester_end") < day) & (F.datediff(day, "semester_end") <= 45), 1).otherwise(2)
    one = rows.withColumn("tier", tier).groupBy("entity_key").agg(F.min(F.struct((c("tier") > 1).alias("far"), "knowable", "tier", "semester_end", "new_outbreaks", "marker")).alias("m"))
    return one.select("entity_key", "m.semester_end", "m.knowable", "m.new_outbreaks", "m.tier", (c("m.new_outbreaks") > 0).alias("validates"), F.datediff("m.knowable", F.coalesce("m.marker", day)).alias("lead_days"))


@query("semester_validation", f"WITH {T.TRIANGLE}, {_PS}, {_SV} SELECT * FROM sv")
def semester_validation(spark, d):
    return validated(semesters(spark, d), markers(predictions(spark, d)))


_RP = f"""fin AS (SELECT entity_key, week, sum(count)::DOUBLE AS y FROM tri GROUP BY 1, 2 HAVING sum(count) > 0),
fo AS (SELECT entity_key, max(week) FILTER (WHERE week <= DATE '{REPLAY}') AS last_before, arg_max(y, week) FILTER (WHERE week <= DATE '{REPLAY}') AS last_before_count, min(week) FILTER (WHERE week > DATE '{REPLAY}') AS first_after, arg_min(y, week) FILTER (WHERE week > DATE '{REPLAY}') AS first_after_count,
 sum(y) FILTER (WHERE week > DATE '{REPLAY}' AND week <= DATE '{REPLAY}' + 28) AS next_28d, sum(y) FILTER (WHERE week > DATE '{REPLAY}' AND week <= DATE '{REPLAY}' + 90) AS next_90d FROM fin GROUP BY 1),
si AS (SELECT entity_key, count(*) AS n_signals, min(available_from) AS first_signal FROM sg WHERE available_from <= DATE '{REPLAY}' GROUP BY 1),
rp AS (SELECT pred.entity_key, level, p, observed, last_before, last_before_count, DATE '{REPLAY}' - last_before AS days_since_last, first_after, first_after_count, CASE WHEN first_after IS NOT NULL THEN coalesce(next_28d, 0) END AS next_28d, CASE WHEN first_after IS NOT NULL THEN coalesce(next_90d, 0) END AS next_90d,
 coalesce(n_signals, 0) AS n_signals, first_signal, marker, first_after - marker AS lead_days FROM pred LEFT JOIN fo USING (entity_key) LEFT JOIN si USING (entity_key) LEFT JOIN mk USING (entity_key) WHERE as_of = DATE '{REPLAY}')"""


def replayed(spark, d):
    day = pit.day(REPLAY)
    frame = predictions(spark, d)
    final = T.triangle(spark, d).groupBy("entity_key", "week").agg(F.sum("count").cast("double").alias("y")).where("y > 0")
    before, after = c("week") <= day, c("week") > day
    ahead = lambda n: F.sum(F.when(after & (c("week") <= F.date_add(day, n)), c("y")))
    official = final.groupBy("entity_key").agg(
        F.max(F.when(before, c("week"))).alias("last_before"), F.max_by(F.when(before, c("y")), F.when(before, c("week"))).alias("last_before_count"), F.min(F.when(after, c("week"))).alias("first_after"), F.min_by(F.when(after, c("y")), F.when(after, c("week"))).alias("first_after_count"),
        ahead(28).alias("n28"), ahead(90).alias("n90"),
    )
    signals = T.signals(spark, d).where(c("available_from") <= day).groupBy("entity_key").agg(F.count("*").alias("n_signals"), F.min("available_from").alias("first_signal"))
    known = lambda x: F.when(c("first_after").isNotNull(), F.coalesce(x, F.lit(0.0)))
    out = frame.where(c("as_of") == day).join(official, "entity_key", "left").join(signals, "entity_key", "left").join(markers(frame).select("entity_key", "marker"), "entity_key", "left")
    return out.select("entity_key", "level", "p", "observed", "last_before", "last_before_count", F.datediff(day, "last_before").alias("days_since_last"), "first_after", "first_after_count", known("n28").alias("next_28d"), known("n90").alias("next_90d"), F.coalesce("n_signals", F.lit(0)).alias("n_signals"), "first_signal", "marker", F.datediff("first_after", "marker").alias("lead_days"))


@query("replay", f"WITH {T.TRIANGLE}, {T.SIGNALS}, {_PS}, {_SV}, {_RP} SELECT * FROM rp")
def replay(spark, d):
    """What was known at the replay date against what became officially visible afterwards, for every entity."""
    return replayed(spark, d)


@query("lead_outcome", f"""WITH {T.TRIANGLE}, {T.SIGNALS}, {_PS}, {_SV}, {_RP} SELECT rp.entity_key, CASE WHEN rp.lead_days >= 0 THEN 'lead' WHEN rp.lead_days < 0 THEN 'report_first' WHEN validates AND sv.lead_days >= 0 AND marker IS NOT NULL THEN 'semester_only'
 WHEN last_before IS NOT NULL AND first_after IS NULL AND marker IS NOT NULL THEN 'history_only' ELSE 'none' END AS outcome FROM rp LEFT JOIN sv USING (entity_key)""")
def lead_outcome(spark, d):
    """How a replay ends: lead, report first, semester validation only, history only, or none; the first that holds."""
    marked = markers(predictions(spark, d))
    v = validated(semesters(spark, d), marked).select("entity_key", "validates", c("lead_days").alias("semester_lead"))
    r = replayed(spark, d).join(v, "entity_key", "left")
    concern = c("marker").isNotNull()
    out = F.when(c("lead_days") >= 0, "lead").when(c("lead_days") < 0, "report_first").when(c("validates") & (c("semester_lead") >= 0) & concern, "semester_only").when(c("last_before").isNotNull() & c("first_after").isNull() & concern, "history_only").otherwise("none")
    return r.select("entity_key", out.alias("outcome"))


@query("source_diversity", f"WITH {T.SIGNALS} SELECT entity_key, week, round(least(2.0, greatest(0.0, least(1.0, greatest(0.0, count(DISTINCT source_name) / greatest(count(*), 1)::DOUBLE)) * (1 + 0.18 * (count(DISTINCT signal_name) - 1)))), 6) AS diversity, round(least(2.0, greatest(-1.0, -CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) / count(*) / 10)), 9) AS tone FROM sg GROUP BY 1, 2")
def source_diversity(spark, d):
    """Distinct sources per item, raised by the number of kinds (which stand in for languages), and the clipped tone."""
    share = decide.clip(F.size(F.collect_set("source_name")) / F.greatest(F.count("*"), F.lit(1)), 0.0, 1.0)
    more = 1 + 0.18 * (F.size(F.collect_set("signal_name")) - 1)
    return T.signals(spark, d).groupBy("entity_key", "week").agg(r6(decide.clip(share * more, 0.0, 2.0), "diversity"), F.round(decide.clip(-F.sum(c("value").cast("decimal(24,6)")).cast("double") / F.count("*") / 10, -1.0, 2.0), 9).alias("tone"))


@query("json_lookup", f"WITH {T.TRIANGLE}, {_PS} SELECT 'AHR-' || replace(entity_key, '|', '-') || '-{DECIDE}' AS alert_id, level, p FROM pred WHERE as_of = DATE '{DECIDE}' AND level = 'CRITICAL'")
def json_lookup(spark, d):
    """Explanations are stored as one JSON array; the lookup reads those of critical alerts back from it."""
    p = predictions(spark, d).where(c("as_of") == pit.day(DECIDE))
    stored = p.select(F.to_json(F.struct(F.concat(F.lit("AHR-"), F.replace("entity_key", F.lit("|"), F.lit("-")), F.lit(f"-{DECIDE}")).alias("alert_id"), F.struct("level", "p").alias("explanation"))).alias("j"))
    read = stored.select(F.from_json("j", "alert_id string, explanation struct<level: string, p: double>").alias("x"))
    return read.where(c("x.explanation.level") == "CRITICAL").select("x.alert_id", "x.explanation.level", "x.explanation.p")


@query("crps", f"WITH {T.TRIANGLE}, f AS (SELECT entity_key, week, sum(count)::DOUBLE AS y FROM tri GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY week DESC) AS b FROM f), o AS (SELECT entity_key, y FROM n WHERE b = 1), h AS (SELECT entity_key, y AS x FROM n WHERE b BETWEEN 2 AND 53), a AS (SELECT h.entity_key, avg(abs(x - o.y)) AS t1, count(*) AS m FROM h JOIN o USING (entity_key) GROUP BY 1), bb AS (SELECT p.entity_key, sum(abs(p.x - q.x)) AS t2 FROM h p JOIN h q USING (entity_key) GROUP BY 1) SELECT entity_key, round(t1 - t2 / (2.0 * m * m), 6) AS crps FROM a JOIN bb USING (entity_key)")
def crps(spark, d):
    """CRPS of each entity's last active week against the sample of its (up to 52) weeks before, by the sorted-sample identity."""
    f = T.triangle(spark, d).groupBy("entity_key", "week").agg(F.sum("count").cast("double").alias("y"))
    weeks = f.groupBy("entity_key").agg(F.sort_array(F.collect_list(F.struct("week", "y")), asc=False).alias("w"))  # bounded by the calendar
    s = weeks.select("entity_key", c("w")[0]["y"].alias("o"), F.array_sort(F.transform(F.slice("w", 2, 52), lambda x: x["y"])).alias("x")).where(F.size("x") > 0)
    n = F.size("x")
    first = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v - c("o"))) / n
    second = F.aggregate(F.transform("x", lambda v, i: (2 * (i + 1) - n - 1) * v), F.lit(0.0), lambda a, v: a + v) * 2 / (n * n)
    return s.select("entity_key", r6(first - second / 2, "crps"))


@query("weighted_quantile", f"WITH {T.SIGNALS}, r AS (SELECT entity_key, value, reliability AS w, sum(reliability) OVER (PARTITION BY entity_key ORDER BY value, signal_id ROWS UNBOUNDED PRECEDING) - 0.5 * reliability AS cw, sum(reliability) OVER (PARTITION BY entity_key) AS tw, row_number() OVER (PARTITION BY entity_key ORDER BY value, signal_id) AS k, count(*) OVER (PARTITION BY entity_key) AS n FROM (SELECT entity_key, signal_id, value, coalesce(reliability, 0.5) AS reliability FROM sg WHERE signal_name = 'beacon_signal_strength')), p AS (SELECT *, cw / tw AS q FROM r), x AS (SELECT a.entity_key, CASE WHEN b.q IS NULL THEN a.value ELSE a.value + (b.value - a.value) * (0.5 - a.q) / (b.q - a.q) END AS m FROM (SELECT entity_key, arg_max(value, k) AS value, arg_max(q, k) AS q, max(k) AS k FROM p WHERE q <= 0.5 GROUP BY 1) a LEFT JOIN p b ON b.entity_key = a.entity_key AND b.k = a.k + 1), f AS (SELECT entity_key, value AS v FROM p WHERE k = 1) SELECT f.entity_key, round(coalesce(x.m, f.v), 6) AS median FROM f LEFT JOIN x USING (entity_key)")
def weighted_quantile(spark, d):
    """Reliability-weighted median of a signal per entity. Equal values of an entity are merged first; a hot entity's distinct
    values are ordered by (entity, value) in one window partition of its own distinct values."""
    s = T.signals(spark, d).where("signal_name = 'beacon_signal_strength'").select("entity_key", "signal_id", "value", F.coalesce("reliability", F.lit(0.5)).alias("w"))
    by = W.partitionBy("entity_key").orderBy("value", "signal_id")
    total = s.groupBy("entity_key").agg(F.sum("w").alias("t"))
    r = s.withColumn("cw", F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)) - 0.5 * c("w")).withColumn("nv", F.lead("value").over(by)).withColumn("nw", F.lead("w").over(by)).join(total, "entity_key")
    q, nq = c("cw") / c("t"), (c("cw") + 0.5 * c("w") + 0.5 * c("nw")) / c("t")
    at = F.when(c("nv").isNull(), c("value")).otherwise(c("value") + (c("nv") - c("value")) * (0.5 - q) / (nq - q))
    g = r.groupBy("entity_key").agg(F.max_by(F.when(q <= 0.5, at), F.when(q <= 0.5, F.struct("cw", "value", "signal_id"))).alias("m"), F.min(F.struct("value", "signal_id")).alias("f"))
    return g.select("entity_key", r6(F.coalesce("m", c("f.value")), "median"))
