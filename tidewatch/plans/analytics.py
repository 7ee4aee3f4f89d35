"""Queries of normalisation, joins, aggregates, windows, geography, decisions, scores and serving, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions.missing import code, date_value
from tidewatch.functions.settings import ENVIRONMENT
from tidewatch.operators import decide, geo, pit, series
from tidewatch.plans.asof import AS_OF
from tidewatch.plans.registry import registry
from tidewatch.session import table
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
c = F.col


def r6(x, name):
    return F.round(x, 6).alias(name)


# --- normalisation ---------------------------------------------------------------------------------------------------


_CHAIN = ("onset_date", "suspicion_date", "confirmation_date", "notification_date", "publication_date", "resolved_date")
_RAW = f"""raw AS (SELECT DISTINCT upper(trim(event_id)) AS event_id, upper(trim(country_iso3)) AS country, disease, disease_raw, cases, deaths, {', '.join(f"CASE WHEN {x} {T._OK} THEN {x} END AS {x}" for x in (*_CHAIN, 'reference_date', 'available_from'))} FROM canonical_events WHERE trim(event_id) <> ''),
dsl AS (SELECT DISTINCT disease AS l FROM raw UNION SELECT DISTINCT disease_raw FROM raw), dsf AS (SELECT l, trim(regexp_replace(lower(strip_accents(l)), '[^a-z0-9]+', ' ', 'g')) AS f FROM dsl WHERE l IS NOT NULL),
dsm AS (SELECT l, f, list_filter([CASE WHEN (regexp_matches(f, '\\bhpai\\b') OR (f LIKE '%high pathogenicity%' AND f LIKE '%influenza%') OR (f LIKE '%highly pathogenic%' AND f LIKE '%avian influenza%') OR regexp_matches(f, '\\b(avian influenza|bird flu|h5n1|h5n8|h5nx|grippe aviaire|high path ai)\\b')) AND NOT (f LIKE '%low pathogenicity%' OR regexp_matches(f, '\\blpai\\b')) THEN 'HPAI' END,
 CASE WHEN (regexp_matches(f, '\\basf\\b') OR regexp_matches(f, 'african swine fever|swine fever african|peste porcine africaine|peste porcina africana|peste porcine afr\\b')) AND NOT (f LIKE '%classical swine fever%' OR regexp_matches(f, '\\bcsf\\b') OR f LIKE '%hog cholera%') THEN 'ASF' END,
 CASE WHEN regexp_matches(f, '\\bfmd\\b|fievre aphteuse') OR (f LIKE '%foot%' AND f LIKE '%mouth%') THEN 'FMD' END, CASE WHEN regexp_matches(f, '\\blsd\\b|lumpy skin|dermatose nodulaire') THEN 'LSD' END, CASE WHEN regexp_matches(f, '\\bppr\\b|peste des petits ruminants|small ruminant plague') THEN 'PPR' END], lambda x: x IS NOT NULL) AS m FROM dsf),
dsr AS (SELECT l, CASE WHEN upper(trim(l)) IN ('HPAI', 'ASF', 'FMD', 'LSD', 'PPR') THEN upper(trim(l)) WHEN len(m) = 1 THEN m[1] END AS category FROM dsm),
rs AS (SELECT raw.*, CASE WHEN regexp_full_match(country, '[A-Z]{{3}}') THEN country END AS iso3, coalesce(a.category, b.category) AS dis, {' OR '.join(f'coalesce({x} > {y}, FALSE)' for x, y in zip(_CHAIN, _CHAIN[1:]))} AS inconsistent FROM raw LEFT JOIN dsr a ON a.l = raw.disease LEFT JOIN dsr b ON b.l = raw.disease_raw)"""


def _resolved(spark, d):
    """Distinct event rows with resolved country and disease and the flag of a broken timeline (adjacent columns)."""
    dates = [date_value(c(x)).alias(x) for x in (*_CHAIN, "reference_date", "available_from")]
    raw = table(spark, d, "canonical_events").where(F.trim("event_id") != "").select(code(c("event_id")).alias("event_id"), code(c("country_iso3")).alias("country"), "disease", "disease_raw", "cases", "deaths", *dates).distinct()
    bad = F.lit(False)
    for x, y in zip(_CHAIN, _CHAIN[1:]):
        bad = bad | F.coalesce(c(x) > c(y), F.lit(False))
    return raw.select("*", F.when(c("country").rlike("^[A-Z]{3}$"), c("country")).alias("iso3"), F.coalesce(labels.disease_of(c("disease")), labels.disease_of(c("disease_raw"))).alias("dis"), bad.alias("inconsistent"))


@query("canonicalise_events", f"""WITH {_RAW} SELECT event_id, iso3 || '|' || dis AS entity_key, CAST(date_trunc('week', reference_date) AS DATE) AS week, CAST(date_trunc('week', available_from) AS DATE) AS available_week, inconsistent,
 CASE WHEN notification_date - onset_date BETWEEN 0 AND 365 THEN notification_date - onset_date END AS reporting_delay, CASE WHEN suspicion_date - onset_date BETWEEN 0 AND 365 THEN suspicion_date - onset_date END AS detection_delay, CASE WHEN publication_date - notification_date BETWEEN 0 AND 365 THEN publication_date - notification_date END AS publication_delay,
 CASE WHEN cases >= 0 THEN cases END AS cases, CASE WHEN deaths >= 0 THEN deaths END AS deaths FROM rs WHERE iso3 IS NOT NULL AND dis IS NOT NULL AND available_from IS NOT NULL""")
def canonicalise_events(spark, d):
    """Event rows of resolved country and disease with known availability; delays outside [0, 365] and negative counts null."""
    kept = _resolved(spark, d).where("iso3 is not null and dis is not null and available_from is not null")
    lag = lambda a, b: F.when(F.datediff(a, b).between(0, 365), F.datediff(a, b))
    week = lambda x: F.date_trunc("week", x).cast("date")
    return kept.select(
        "event_id", F.concat_ws("|", "iso3", "dis").alias("entity_key"), week("reference_date").alias("week"), week("available_from").alias("available_week"), "inconsistent",
        lag("notification_date", "onset_date").alias("reporting_delay"), lag("suspicion_date", "onset_date").alias("detection_delay"), lag("publication_date", "notification_date").alias("publication_delay"),
        F.when(c("cases") >= 0, c("cases")).alias("cases"), F.when(c("deaths") >= 0, c("deaths")).alias("deaths"),
    )


@query("canonicalise_signals", f"WITH {T.SIGNALS} SELECT signal_id, entity_key, week, value FROM sg WHERE available_from >= reference_date")
def canonicalise_signals(spark, d):
    return T.signals(spark, d).where(c("available_from") >= c("reference_date")).select("signal_id", "entity_key", "week", "value")


@query("canonicalise_covariates", f"WITH {T.COVARIATES} SELECT covariate_id, country, reference_date, value FROM cv")
def canonicalise_covariates(spark, d):
    return T.covariates(spark, d).select("covariate_id", "country", "reference_date", "value")


@query("quality_report", f"""WITH {_RAW}, q AS (SELECT count(*) AS records_in, count(*) FILTER (WHERE iso3 IS NOT NULL AND dis IS NOT NULL AND available_from IS NOT NULL) AS records_out, count(*) FILTER (WHERE iso3 IS NULL) AS unresolved_country, count(*) FILTER (WHERE dis IS NULL) AS unresolved_disease, count(*) FILTER (WHERE available_from IS NULL) AS no_availability,
 count(*) FILTER (WHERE inconsistent) AS chain_violations, count(*) FILTER (WHERE cases < 0 OR deaths < 0) AS negative_counts, count(*) FILTER (WHERE cases >= 0 AND deaths > cases) AS deaths_over_cases FROM rs)
SELECT 'events' AS stage, issue, n_records FROM (UNPIVOT q ON COLUMNS(*) INTO NAME issue VALUE n_records)""")
def quality_report(spark, d):
    r = _resolved(spark, d)
    one = r.agg(
        F.count("*").alias("records_in"), F.count_if(c("iso3").isNotNull() & c("dis").isNotNull() & c("available_from").isNotNull()).alias("records_out"), F.count_if(c("iso3").isNull()).alias("unresolved_country"), F.count_if(c("dis").isNull()).alias("unresolved_disease"),
        F.count_if(c("available_from").isNull()).alias("no_availability"), F.count_if("inconsistent").alias("chain_violations"), F.count_if((c("cases") < 0) | (c("deaths") < 0)).alias("negative_counts"), F.count_if((c("cases") >= 0) & (c("deaths") > c("cases"))).alias("deaths_over_cases"),
    )
    return one.unpivot([], one.columns, "issue", "n_records").select(F.lit("events").alias("stage"), "issue", "n_records")


@query("panel_filter", f"WITH {T.EVENTS}, {T.PLACES} SELECT event_id FROM ev WHERE country IN (SELECT country FROM pl WHERE lat IS NOT NULL) AND disease IN ('HPAI', 'ASF') AND reference_date <= DATE '2024-12-31'")
def panel_filter(spark, d):
    """Events of the panel: countries of the dimension, configured diseases, dates up to the cut-off."""
    panel = T.places(spark, d).where("lat is not null").select("country")
    return T.events(spark, d).where(c("disease").isin(*ENVIRONMENT) & (c("reference_date") <= pit.day("2024-12-31"))).join(panel, "country", "left_semi").select("event_id")


_FIRST = ("report_type", "report_number", "event_status", "country_iso3", "disease", "disease_raw", "serotype", "host_category", "country_name", "admin1", "locality", "latitude", "longitude", "onset_date", "suspicion_date", "confirmation_date", "notification_date", "resolved_date")


@query("collapse_reports", f"""WITH r AS (SELECT DISTINCT upper(trim(event_id)) AS id, species, publication_date AS pub, {', '.join(_FIRST)}, susceptible, cases, deaths, killed_disposed FROM canonical_events WHERE trim(event_id) <> '')
SELECT id AS event_id, {', '.join(f"arg_min({x}, struct_pack(a := coalesce(pub, DATE '9999-12-31'), b := coalesce(report_number, 2147483647), v := CAST({x} AS VARCHAR))) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in _FIRST)},
 coalesce(string_agg(DISTINCT lower(trim(species)), ';' ORDER BY lower(trim(species))), '') AS species, max(CAST(lower(trim(species)) LIKE 'wild%' AS INT)) AS is_wild, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in ('susceptible', 'cases', 'deaths', 'killed_disposed'))} FROM r GROUP BY 1""")
def collapse_reports(spark, d):
    """One row per outbreak of its distinct deliveries: the first non-missing value of every attribute in the order of
    publication, all species, wild or not, and summed magnitudes."""
    more = ("susceptible", "cases", "deaths", "killed_disposed")
    r = table(spark, d, "canonical_events").where(F.trim("event_id") != "").select(code(c("event_id")).alias("id"), F.lower(F.trim("species")).alias("kind"), "publication_date", *_FIRST, *more).distinct()
    late = F.coalesce("publication_date", F.lit("9999-12-31").cast("date"))
    first = lambda x: F.min_by(x, F.when(c(x).isNotNull(), F.struct(late.alias("a"), F.coalesce("report_number", F.lit(2147483647)).alias("b"), c(x).cast("string").alias("v")))).alias(x)
    return r.groupBy(c("id").alias("event_id")).agg(*(first(x) for x in _FIRST), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("species"), F.max(c("kind").startswith("wild").cast("int")).alias("is_wild"), *(F.sum(x).alias(x) for x in more))


@query("delay_reliability", f"""WITH {T.EVENTS} SELECT event_id, least(onset_date, publication_date) AS onset, CASE WHEN publication_date - least(onset_date, publication_date) BETWEEN 0 AND 60 THEN least(onset_date, publication_date) ELSE publication_date END AS modelling_onset FROM ev WHERE publication_date IS NOT NULL AND onset_date IS NOT NULL""")
def delay_reliability(spark, d):
    onset = F.least("onset_date", "publication_date")
    e = T.events(spark, d).where(c("publication_date").isNotNull() & c("onset_date").isNotNull())
    return e.select("event_id", onset.alias("onset"), F.when(F.datediff("publication_date", onset).between(0, 60), onset).otherwise(c("publication_date")).alias("modelling_onset"))


@query("string_fold", "SELECT DISTINCT disease_raw, trim(regexp_replace(lower(strip_accents(disease_raw)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM canonical_events WHERE disease_raw IS NOT NULL")
def string_fold(spark, d):
    """Distinct labels, fully decomposed; folding runs once a label."""
    return table(spark, d, "canonical_events").where(c("disease_raw").isNotNull()).select("disease_raw").distinct().select("disease_raw", labels.fold_all(c("disease_raw")).alias("folded"))


_NAMES = "nm AS (SELECT trim(regexp_replace(lower(strip_accents(country_name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k, min(upper(trim(country_iso3))) AS iso3 FROM canonical_events WHERE regexp_full_match(upper(trim(country_iso3)), '[A-Z]{3}') AND country_name IS NOT NULL GROUP BY 1 HAVING k <> '' AND count(DISTINCT upper(trim(country_iso3))) = 1), cds AS (SELECT DISTINCT upper(trim(country_iso3)) AS iso3 FROM canonical_events WHERE regexp_full_match(upper(trim(country_iso3)), '[A-Z]{3}'))"


@query("resolve_country", f"""WITH {_NAMES}, f AS (SELECT DISTINCT row_id, country, iso3 FROM faostat_livestock_annual_sample)
SELECT row_id, country, coalesce(c.iso3, x.iso3, n.iso3) AS iso3 FROM f LEFT JOIN cds c ON c.iso3 = upper(trim(f.iso3)) LEFT JOIN cds x ON x.iso3 = upper(trim(f.country)) LEFT JOIN nm n ON n.k = trim(regexp_replace(lower(strip_accents(f.country)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))""")
def resolve_country(spark, d):
    """Country codes of rows: the hint if it is a known code, else the text as a code, else an unambiguous name."""
    e = table(spark, d, "canonical_events")
    names = labels.country_names(e, "country_name", "country_iso3")
    codes = e.select(code(c("country_iso3")).alias("known")).where(c("known").rlike("^[A-Z]{3}$")).distinct()
    rows = table(spark, d, "faostat_livestock_annual_sample").select("row_id", "country", "iso3").distinct()
    as_code = lambda x, name: codes.select(c("known").alias(x), c("known").alias(name))
    keyed = rows.select("row_id", "country", code(c("iso3")).alias("h"), code(c("country")).alias("t"), labels.fold(c("country")).alias("folded"))
    found = keyed.join(as_code("h", "by_hint"), "h", "left").join(as_code("t", "by_text"), "t", "left").join(names.withColumnRenamed("iso3", "by_name"), "folded", "left")
    return found.select("row_id", "country", F.coalesce("by_hint", "by_text", "by_name").alias("iso3"))


@query("resolve_category", f"WITH {_RAW} SELECT DISTINCT disease_raw, category FROM raw LEFT JOIN dsr ON l = disease_raw WHERE disease_raw IS NOT NULL")
def resolve_category(spark, d):
    """Disease codes of labels: exact code, else the only disease whose keyword groups match and whose negatives don't."""
    return table(spark, d, "canonical_events").where(c("disease_raw").isNotNull() & (F.trim("event_id") != "")).select("disease_raw").distinct().select("disease_raw", labels.disease_of(c("disease_raw")).alias("category"))


@query("unresolved_report", f"WITH {_RAW} SELECT 'country' AS kind, country AS label, count(*) AS n FROM rs WHERE iso3 IS NULL GROUP BY 2 UNION ALL SELECT 'disease', coalesce(disease, disease_raw), count(*) FROM rs WHERE dis IS NULL GROUP BY 2 UNION ALL SELECT 'species', lower(trim(species)), count(*) FROM canonical_events WHERE species IS NOT NULL AND lower(trim(species)) NOT IN (SELECT DISTINCT lower(trim(item)) FROM faostat_livestock_annual_sample WHERE item IS NOT NULL) GROUP BY 2")
def unresolved_report(spark, d):
    """How often each label of a country, disease or species couldn't be resolved."""
    r = _resolved(spark, d)
    count = lambda f, kind, label: f.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    known = table(spark, d, "faostat_livestock_annual_sample").select(F.lower(F.trim("item")).alias("k")).where(c("k").isNotNull()).distinct()
    species = table(spark, d, "canonical_events").where(c("species").isNotNull()).select(F.lower(F.trim("species")).alias("k")).join(known, "k", "left_anti")
    return count(r.where("iso3 is null"), "country", c("country")).unionByName(count(r.where("dis is null"), "disease", F.coalesce("disease", "disease_raw"))).unionByName(count(species, "species", c("k")))


@query("constraint_violations", "SELECT count(*) FILTER (WHERE abs(latitude) > 90 OR abs(longitude) > 180) AS bad_place, count(*) FILTER (WHERE cases < 0) AS negative_cases, count(*) FILTER (WHERE available_from < publication_date) AS early, count(*) FILTER (WHERE deaths > cases AND cases >= 0) AS more_deaths FROM canonical_events")
def constraint_violations(spark, d):
    return table(spark, d, "canonical_events").agg(F.count_if((F.abs("latitude") > 90) | (F.abs("longitude") > 180)).alias("bad_place"), F.count_if(c("cases") < 0).alias("negative_cases"), F.count_if(c("available_from") < c("publication_date")).alias("early"), F.count_if((c("deaths") > c("cases")) & (c("cases") >= 0)).alias("more_deaths"))


@query("regex_extract_pivot", f"WITH {T.COVARIATES} SELECT country, month(reference_date) AS month, round(avg(value) FILTER (WHERE variable = 't2m_mean_c'), 6) AS t2m_mean_c, round(avg(value) FILTER (WHERE variable = 'total_precipitation_mm'), 6) AS total_precipitation_mm FROM cv WHERE variable IN ('t2m_mean_c', 'total_precipitation_mm') GROUP BY 1, 2")
def regex_extract_pivot(spark, d):
    """Normals whose variable name holds quantity and month (worldclim_<quantity>_m<month>), taken apart and pivoted."""
    named = T.covariates(spark, d).select("country", F.format_string("worldclim_%s_m%02d", "variable", F.month("reference_date")).alias("name"), "value")
    parts = named.select("country", F.regexp_extract("name", "^worldclim_([a-z0-9_]+)_m(\\d{2})$", 1).alias("quantity"), F.regexp_extract("name", "^worldclim_([a-z0-9_]+)_m(\\d{2})$", 2).cast("int").alias("month"), "value")
    wide = parts.where(c("quantity").isin("t2m_mean_c", "total_precipitation_mm")).groupBy("country", "month").pivot("quantity", ["t2m_mean_c", "total_precipitation_mm"]).agg(F.round(F.avg("value"), 6))
    return wide


# --- joins -----------------------------------------------------------------------------------------------------------

_NORMALS = f"WITH {T.COVARIATES}, n AS (SELECT country, month(reference_date) AS m, avg(value) AS normal FROM cv WHERE variable = 't2m_mean_c' GROUP BY 1, 2)"


@query("join_climatology", _NORMALS + " SELECT covariate_id, round(value - normal, 6) AS anomaly FROM cv JOIN n ON n.country = cv.country AND n.m = month(reference_date) WHERE variable = 't2m_mean_c'")
def join_climatology(spark, d):
    """Anomalies against the month's normal: aggregated, then joined back, so that no month is one task."""
    cv = T.covariates(spark, d).where(c("variable") == "t2m_mean_c").withColumn("m", F.month("reference_date"))
    normal = cv.groupBy("country", "m").agg(F.avg("value").alias("normal"))
    return cv.join(normal, ["country", "m"]).select("covariate_id", r6(c("value") - c("normal"), "anomaly"))


@query("join_semi", f"WITH {T.EVENTS}, {T.SIGNALS} SELECT DISTINCT entity_key FROM ev WHERE EXISTS (SELECT 1 FROM sg WHERE sg.entity_key = ev.entity_key)")
def join_semi(spark, d):
    return T.events(spark, d).select("entity_key").distinct().join(T.signals(spark, d).select("entity_key").distinct(), "entity_key", "left_semi")


@query("join_anti", "WITH ids AS (SELECT DISTINCT upper(trim(event_id)) AS id FROM canonical_events WHERE event_id IS NOT NULL), l AS (SELECT DISTINCT regexp_replace(upper(trim(a)), '^.*::\\s*', '') AS id FROM linkage_decisions UNION SELECT DISTINCT regexp_replace(upper(trim(b)), '^.*::\\s*', '') FROM linkage_decisions) SELECT id FROM l WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM ids)")
def join_anti(spark, d):
    """Ids of linkage decisions that no event bears."""
    bare = lambda x: F.regexp_replace(code(c(x)), "^.*::\\s*", "").alias("id")
    l = table(spark, d, "linkage_decisions")
    return l.select(bare("a")).unionByName(l.select(bare("b"))).where(c("id").isNotNull()).distinct().join(table(spark, d, "canonical_events").select(code(c("event_id")).alias("id")), "id", "left_anti")


@query("join_left_assemble", f"WITH {T.EVENTS}, {T.SIGNALS}, a AS (SELECT entity_key, CAST(sum(outbreaks) AS BIGINT) AS outbreaks FROM ev GROUP BY 1), b AS (SELECT entity_key, count(*) AS n_signals FROM sg GROUP BY 1) SELECT entity_key, outbreaks, coalesce(n_signals, 0) AS n_signals FROM a LEFT JOIN b USING (entity_key)")
def join_left_assemble(spark, d):
    a = T.events(spark, d).groupBy("entity_key").agg(F.sum("outbreaks").alias("outbreaks"))
    b = T.signals(spark, d).groupBy("entity_key").agg(F.count("*").alias("n_signals"))
    return a.join(b, "entity_key", "left").select("entity_key", "outbreaks", F.coalesce("n_signals", F.lit(0)).alias("n_signals"))


_PAIRS = f"""WITH {T.EVENTS}, p AS (SELECT a.event_id AS i, b.event_id AS j, abs(a.reference_date - b.reference_date) AS days,
 CASE WHEN a.lat IS NOT NULL AND a.lon IS NOT NULL AND b.lat IS NOT NULL AND b.lon IS NOT NULL THEN 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)))) END AS km, a.admin1 AS ra, b.admin1 AS rb
 FROM ev a JOIN ev b ON a.entity_key = b.entity_key AND a.source_name <> b.source_name AND abs(a.reference_date - b.reference_date) <= 3 AND (b.reference_date < a.reference_date OR (b.reference_date = a.reference_date AND b.event_id < a.event_id))),
 s AS (SELECT i, j, days, km, round(0.5 * (1 - days / 3.0) + 0.5 * coalesce(1 - km / 10, 0.5), 6) AS score FROM p WHERE km <= 10 OR (km IS NULL AND lower(ra) = lower(rb)))"""


@query("er_candidates", _PAIRS + " SELECT i, j, days, round(km, 4) AS km, score FROM s")
def er_candidates(spark, d):
    return geo.interval_candidates(T.events(spark, d)).select("i", "j", "days", F.round("km", 4).alias("km"), "score")


@query("er_best_match", _PAIRS + " SELECT i, j, score FROM s WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j) = 1")
def er_best_match(spark, d):
    p = geo.interval_candidates(T.events(spark, d)).where(c("score") >= 0.55)
    best = p.groupBy("i").agg(F.min(F.struct((-c("score")).alias("s"), "j")).alias("b"))
    return best.select("i", c("b.j").alias("j"), (-c("b.s")).alias("score"))


@query("join_unambiguous", """WITH s AS (SELECT DISTINCT upper(trim(event_id)) AS event_id, upper(trim(source_event_id)) AS cited FROM canonical_events WHERE length(trim(source_event_id)) > 5), u AS (SELECT cited FROM s GROUP BY 1 HAVING count(DISTINCT event_id) = 1)
SELECT s.event_id, s.cited FROM s JOIN u USING (cited)""")
def join_unambiguous(spark, d):
    s = table(spark, d, "canonical_events").where(F.length(F.trim("source_event_id")) > 5).select(code(c("event_id")).alias("event_id"), code(c("source_event_id")).alias("cited")).distinct()
    once = s.groupBy("cited").agg(F.min("event_id").alias("event_id"), F.max("event_id").alias("other"))
    return once.where("event_id = other").select("event_id", "cited")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("weekly_rollup", f"WITH {T.SIGNALS} SELECT entity_key, signal_name, week, round(sum(value), 6) AS total, count(*) AS n, round(max(value), 6) AS top, count(DISTINCT source_name) AS n_sources FROM sg GROUP BY 1, 2, 3")
def weekly_rollup(spark, d):
    return T.signals(spark, d).groupBy("entity_key", "signal_name", "week").agg(r6(F.sum("value"), "total"), F.count("*").alias("n"), r6(F.max("value"), "top"), F.size(F.collect_set("source_name")).cast("long").alias("n_sources"))


@query("dedup_official", f"WITH {T.EVENTS} SELECT entity_key, week, event_id, source_name, count(*) OVER w AS n_records, CAST(sum(CASE WHEN is_official THEN outbreaks ELSE 0 END) OVER w AS BIGINT) AS burden FROM ev WINDOW w AS (PARTITION BY entity_key, week) QUALIFY row_number() OVER (PARTITION BY entity_key, week ORDER BY CASE WHEN is_official THEN 0 ELSE 1 END, available_from, event_id) = 1")
def dedup_official(spark, d):
    first = F.min(F.struct(F.when(c("is_official"), 0).otherwise(1).alias("o"), "available_from", "event_id", "source_name")).alias("f")
    g = T.events(spark, d).groupBy("entity_key", "week").agg(first, F.count("*").alias("n_records"), F.sum(F.when(c("is_official"), c("outbreaks")).otherwise(0)).alias("burden"))
    return g.select("entity_key", "week", "f.event_id", "f.source_name", "n_records", "burden")


@query("evidence_sets", f"WITH {T.EVENTS} SELECT entity_key, week, min(available_from) AS first_seen, string_agg(DISTINCT source_name, ';' ORDER BY source_name) AS sources, count(*) AS n FROM ev GROUP BY 1, 2")
def evidence_sets(spark, d):
    return T.events(spark, d).groupBy("entity_key", "week").agg(F.min("available_from").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("source_name")), ";").alias("sources"), F.count("*").alias("n"))


@query("count_distinct", f"WITH {T.EVENTS} SELECT count(DISTINCT entity_key) AS entities, count(DISTINCT country) AS countries, count(DISTINCT disease) AS diseases FROM ev")
def count_distinct(spark, d):
    return T.events(spark, d).agg(F.count_distinct("entity_key").alias("entities"), F.count_distinct("country").alias("countries"), F.count_distinct("disease").alias("diseases"))


@query("lead_quantiles", f"WITH {T.EVENTS} SELECT disease, median(available_from - reference_date) AS p50, round(quantile_cont(available_from - reference_date, 0.9), 6) AS p90, round(quantile_cont(available_from - reference_date, 0.25), 6) AS p25 FROM ev GROUP BY 1")
def lead_quantiles(spark, d):
    """Exact quantiles of whole-day lags: counted per lag first, so that a disease is a few hundred rows."""
    lags = T.events(spark, d).groupBy("disease", F.datediff("available_from", "reference_date").alias("lag")).agg(F.count("*").alias("n"))
    at = lambda q: F.percentile("lag", F.lit(q), c("n"))
    return lags.groupBy("disease").agg(at(0.5).alias("p50"), r6(at(0.9), "p90"), r6(at(0.25), "p25"))


@query("pivot_covariates", f"WITH {T.COVARIATES} SELECT country, reference_date, arg_max(value, struct_pack(a := available_from, i := covariate_id)) FILTER (WHERE variable = 't2m_mean_c') AS t2m_mean_c, arg_max(value, struct_pack(a := available_from, i := covariate_id)) FILTER (WHERE variable = 'snow_depth_m') AS snow_depth_m FROM cv GROUP BY 1, 2")
def pivot_covariates(spark, d):
    pick = F.max_by("value", F.struct("available_from", "covariate_id"))
    return T.covariates(spark, d).groupBy("country", "reference_date").pivot("variable", ["t2m_mean_c", "snow_depth_m"]).agg(pick)


@query("unpivot_features", f"WITH {T.EVENTS} SELECT event_id, feature, value FROM (UNPIVOT (SELECT event_id, CAST(cases AS DOUBLE) AS cases, CAST(deaths AS DOUBLE) AS deaths FROM ev) ON cases, deaths INTO NAME feature VALUE value)")
def unpivot_features(spark, d):
    e = T.events(spark, d).select("event_id", c("cases").cast("double").alias("cases"), c("deaths").cast("double").alias("deaths"))
    return e.unpivot(["event_id"], ["cases", "deaths"], "feature", "value").where("value is not null")


@query("value_counts_topk", f"WITH {T.EVENTS} SELECT source_name, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, source_name LIMIT 6")
def value_counts_topk(spark, d):
    return T.events(spark, d).groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(6)


@query("emit_weekly_signals", f"WITH {T.SIGNALS} SELECT signal_name || ':' || country || ':' || disease || ':' || CAST(week AS VARCHAR) AS id, week + 6 AS published, week + 7 AS available_from, round(sum(value), 6) AS value FROM sg GROUP BY signal_name, country, disease, week HAVING week + 7 <= DATE '2024-12-15'")
def emit_weekly_signals(spark, d):
    g = T.signals(spark, d).groupBy("signal_name", "country", "disease", "week").agg(r6(F.sum("value"), "value"))
    out = g.select(F.concat_ws(":", "signal_name", "country", "disease", c("week").cast("string")).alias("id"), F.date_add("week", 6).alias("published"), F.date_add("week", 7).alias("available_from"), "value")
    return out.where(c("available_from") <= pit.day("2024-12-15"))


@query("prediction_summary", f"WITH {T.EVENTS} SELECT count(*) AS n, min(reference_date) AS first_date, max(reference_date) AS last_date, round(avg(cases), 6) AS mean_cases, median(cases) AS median_cases FROM ev")
def prediction_summary(spark, d):
    by = T.events(spark, d).groupBy("cases").agg(F.count("*").alias("n"), F.min("reference_date").alias("a"), F.max("reference_date").alias("b"))
    some = F.when(c("cases").isNotNull(), c("n"))
    return by.agg(F.sum("n").alias("n"), F.min("a").alias("first_date"), F.max("b").alias("last_date"), r6(F.sum(c("cases") * c("n")) / F.sum(some), "mean_cases"), F.percentile("cases", F.lit(0.5), c("n")).alias("median_cases"))


# --- windows and recurrences -----------------------------------------------------------------------------------------

_STEP = T.SERIES + ", n AS (SELECT entity_key, week, y, row_number() OVER (PARTITION BY entity_key ORDER BY week) AS k FROM ser)"


@query("weeks_since_last", f"WITH {T.SERIES} SELECT entity_key, week, CAST((week - max(CASE WHEN y > 0 THEN week END) OVER (PARTITION BY entity_key ORDER BY week ROWS UNBOUNDED PRECEDING)) / 7 AS INT) AS weeks_since FROM ser")
def weeks_since_last(spark, d):
    last = F.max(F.when(c("y") > 0, c("week"))).over(W.partitionBy("entity_key").orderBy("week").rowsBetween(W.unboundedPreceding, 0))
    return T.series(spark, d).select("entity_key", "week", (F.datediff("week", last) / 7).cast("int").alias("weeks_since"))


@query("log_growth", f"WITH {T.SERIES} SELECT entity_key, week, round(ln(1 + sum(y) OVER (PARTITION BY entity_key ORDER BY week ROWS 3 PRECEDING)) - ln(1 + coalesce(sum(y) OVER (PARTITION BY entity_key ORDER BY week ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING), 0)), 6) AS growth FROM ser")
def log_growth(spark, d):
    w = W.partitionBy("entity_key").orderBy("week")
    before = F.coalesce(F.sum("y").over(w.rowsBetween(-7, -4)), F.lit(0.0))
    return T.series(spark, d).select("entity_key", "week", r6(F.log1p(F.sum("y").over(w.rowsBetween(-3, 0))) - F.log1p(before), "growth"))


@query("ewma", f"WITH RECURSIVE {_STEP}, r AS (SELECT entity_key, k, y AS level FROM n WHERE k = 1 UNION ALL SELECT n.entity_key, n.k, 0.3 * n.y + 0.7 * r.level FROM r JOIN n ON n.entity_key = r.entity_key AND n.k = r.k + 1) SELECT entity_key, round(arg_max(level, k), 6) AS level FROM r GROUP BY 1")
def ewma(spark, d):
    return series.ordered(T.series(spark, d)).select("entity_key", r6(series.ewma(c("s.v"), 0.3), "level"))


_EWMAZ = f"""WITH RECURSIVE {_STEP}, h AS (SELECT entity_key, greatest(var_pop(ln(1 + y)), 0.25) AS v0 FROM n WHERE k <= 8 GROUP BY 1),
r AS (SELECT n.entity_key, n.k, n.week, ln(1 + y) * 0.3 + 0.7 * ln(1 + y) AS level, 0.7 * v0 AS var, 0.0::DOUBLE AS z FROM n JOIN h USING (entity_key) WHERE k = 1
 UNION ALL SELECT n.entity_key, n.k, n.week, 0.3 * ln(1 + n.y) + 0.7 * r.level, 0.7 * r.var + 0.3 * (ln(1 + n.y) - r.level) ** 2, (ln(1 + n.y) - r.level) / greatest(sqrt(r.var), 0.5) FROM r JOIN n ON n.entity_key = r.entity_key AND n.k = r.k + 1)"""


def _ewma_z(spark, d):
    s = series.ordered(T.series(spark, d).withColumn("y", F.log1p("y")))
    z = series.ewma_scores(c("s.v"))
    return s.select("entity_key", F.inline(F.arrays_zip(c("s.o").alias("week"), z.alias("z"))))


@query("ewma_z", _EWMAZ + " SELECT entity_key, week, round(z, 6) AS z FROM r")
def ewma_z(spark, d):
    return _ewma_z(spark, d).select("entity_key", "week", r6(c("z"), "z"))


@query("ewma_alarm", _EWMAZ + " SELECT entity_key, count(*) AS n_alarms, min(week) AS first_alarm FROM r WHERE z >= 2 GROUP BY 1")
def ewma_alarm(spark, d):
    return _ewma_z(spark, d).where("z >= 2").groupBy("entity_key").agg(F.count("*").alias("n_alarms"), F.min("week").alias("first_alarm"))


_RZ = f"WITH {T.SERIES}, a AS (SELECT *, median(ln(1 + y)) OVER (PARTITION BY entity_key) AS m FROM ser), b AS (SELECT *, median(abs(ln(1 + y) - m)) OVER (PARTITION BY entity_key) AS mad FROM a), rz AS (SELECT entity_key, week, y, (ln(1 + y) - m) / greatest(1.4826 * mad, 0.5) AS z FROM b)"


def _rz(spark, d):
    return series.with_robust_z(T.series(spark, d).withColumn("l", F.log1p("y")), "l", "entity_key")


@query("robust_z", _RZ + " SELECT entity_key, week, round(z, 6) AS z FROM rz")
def robust_z(spark, d):
    return _rz(spark, d).select("entity_key", "week", r6(c("z"), "z"))


_CUSUM = _RZ + ", cc AS (SELECT *, sum(z - 0.5) OVER (PARTITION BY entity_key ORDER BY week ROWS UNBOUNDED PRECEDING) AS c FROM rz), cs AS (SELECT entity_key, week, c - least(0, min(c) OVER (PARTITION BY entity_key ORDER BY week ROWS UNBOUNDED PRECEDING)) AS s FROM cc)"


@query("cusum", _CUSUM + " SELECT entity_key, week, round(s, 4) AS s FROM cs")
def cusum(spark, d):
    return series.cusum(_rz(spark, d), "z", "entity_key", "week").select("entity_key", "week", F.round("s", 4).alias("s"))


@query("seasonal_expanding", f"WITH {T.SERIES} SELECT entity_key, week, round(coalesce(avg(y) OVER (PARTITION BY entity_key, extract(week FROM week) ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(y) OVER (PARTITION BY entity_key ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS base FROM ser")
def seasonal_expanding(spark, d):
    same = W.partitionBy("entity_key", F.weekofyear("week")).orderBy("week").rowsBetween(W.unboundedPreceding, -1)
    all_before = W.partitionBy("entity_key").orderBy("week").rowsBetween(W.unboundedPreceding, -1)
    return T.series(spark, d).select("entity_key", "week", r6(F.coalesce(F.avg("y").over(same), F.avg("y").over(all_before), F.lit(0.0)), "base"))


@query("rolling_mean_diff", f"WITH {T.SERIES} SELECT entity_key, week, round(avg(y) OVER (PARTITION BY entity_key ORDER BY week ROWS 3 PRECEDING), 6) AS mean_4, coalesce(y - lag(y, 4) OVER (PARTITION BY entity_key ORDER BY week), 0) AS diff_4 FROM ser")
def rolling_mean_diff(spark, d):
    w = W.partitionBy("entity_key").orderBy("week")
    return T.series(spark, d).select("entity_key", "week", r6(F.avg("y").over(w.rowsBetween(-3, 0)), "mean_4"), F.coalesce(c("y") - F.lag("y", 4).over(w), F.lit(0.0)).alias("diff_4"))


_STOCK = f"WITH s AS (SELECT upper(trim(iso3)) AS country, lower(trim(item)) AS item, year, max(row_id) AS row_id, max(value) AS value FROM faostat_livestock_annual_sample WHERE value > 0 AND NOT isnan(value) AND lower(element) LIKE '%stock%' GROUP BY 1, 2, 3), v AS (SELECT lower(trim(item)) AS item, CASE WHEN release_date {T._OK} THEN release_date END AS release, row_id, max(value) AS value FROM faostat_livestock_annual_sample WHERE value > 0 AND NOT isnan(value) AND lower(element) LIKE '%stock%' GROUP BY 1, 2, 3)"


def _stock_rows(spark, d):
    return table(spark, d, "faostat_livestock_annual_sample").where((c("value") > 0) & ~F.isnan("value") & F.lower("element").contains("stock"))


@query("stock_trend", _STOCK + " SELECT country, item, year, round(coalesce(ln(value) - lag(ln(value)) OVER (PARTITION BY country, item ORDER BY year), 0), 6) AS trend FROM s")
def stock_trend(spark, d):
    s = _stock_rows(spark, d).groupBy(code(c("iso3")).alias("country"), F.lower(F.trim("item")).alias("item"), "year").agg(F.max("value").alias("value"))
    return s.select("country", "item", "year", r6(F.coalesce(F.log("value") - F.lag(F.log("value")).over(W.partitionBy("country", "item").orderBy("year")), F.lit(0.0)), "trend"))


@query("pct_rank_avg", _STOCK + " SELECT row_id, release, round((rank() OVER (PARTITION BY item, release ORDER BY value) + (count(*) OVER (PARTITION BY item, release, value) - 1) / 2.0) / count(*) OVER (PARTITION BY item, release), 6) AS pct FROM v WHERE release IS NOT NULL")
def pct_rank_avg(spark, d):
    """Average rank share within a release of an item; ranks are made over the distinct values of a release."""
    v = _stock_rows(spark, d).groupBy(F.lower(F.trim("item")).alias("item"), date_value(c("release_date")).alias("release"), "row_id").agg(F.max("value").alias("value")).where("release is not null")
    return v.join(series.rank_shares(v, ["item", "release"], "value", "pct"), ["item", "release", "value"]).select("row_id", "release", r6(c("pct"), "pct"))


@query("episodes", f"WITH {T.EVENTS}, n AS (SELECT DISTINCT entity_key, reference_date AS rd FROM ev), w AS (SELECT *, CASE WHEN rd - lag(rd) OVER (PARTITION BY entity_key ORDER BY rd) < 56 THEN 0 ELSE 1 END AS new FROM n) SELECT entity_key, rd, CAST(sum(new) OVER (PARTITION BY entity_key ORDER BY rd) AS BIGINT) AS episode FROM w")
def episodes(spark, d):
    n = T.events(spark, d).select("entity_key", c("reference_date").alias("rd")).distinct()
    return series.episodes(n, "entity_key", "rd")


@query("dedup_suffix", "SELECT upper(trim(event_id)) || '#' || CAST(row_number() OVER (PARTITION BY upper(trim(event_id)) ORDER BY publication_date NULLS FIRST, cases NULLS FIRST) - 1 AS VARCHAR) AS key, publication_date, cases FROM (SELECT DISTINCT upper(trim(event_id)) AS event_id, publication_date, cases FROM canonical_events WHERE event_id IS NOT NULL)")
def dedup_suffix(spark, d):
    """Unique keys of all distinct deliveries of a record, numbered by publication and cases (missing ones first)."""
    e = table(spark, d, "canonical_events").where(c("event_id").isNotNull()).select(code(c("event_id")).alias("k"), "publication_date", "cases").distinct()
    n = F.row_number().over(W.partitionBy("k").orderBy(c("publication_date").asc_nulls_first(), c("cases").asc_nulls_first())) - 1
    return e.select(F.concat_ws("#", "k", n.cast("string")).alias("key"), "publication_date", "cases")


# --- geography -------------------------------------------------------------------------------------------------------

@query("grid_cross", f"WITH {T.EVENTS} SELECT country, disease FROM (SELECT DISTINCT country FROM ev), (SELECT DISTINCT disease FROM ev)")
def grid_cross(spark, d):
    ev = T.events(spark, d)
    return ev.select("country").distinct().crossJoin(F.broadcast(ev.select("disease").distinct()))  # both are dimensions


# --- scalars, decisions, scores --------------------------------------------------------------------------------------


@query("math_transforms", f"WITH {T.EVENTS} SELECT event_id, round(ln(greatest(cases + 1, 1e-9)), 6) AS safe_log, round(1 / (1 + exp(-cases / 100.0)), 6) AS expit, round(ln(q / (1 - q)), 6) AS logit, round(exp(least(cases, 20) / 10.0) - 1, 6) AS expm1, round(sqrt(cases), 6) AS root FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, cases / 1000.0)) AS q FROM ev WHERE cases IS NOT NULL)")
def math_transforms(spark, d):
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c("cases") / 1000.0))
    return T.events(spark, d).where("cases is not null").select("event_id", r6(F.log(F.greatest(c("cases") + 1.0, F.lit(1e-9))), "safe_log"), r6(1 / (1 + F.exp(-c("cases") / 100.0)), "expit"), r6(F.log(q / (1 - q)), "logit"), r6(F.expm1(F.least(c("cases"), F.lit(20)) / 10.0), "expm1"), r6(F.sqrt("cases"), "root"))


@query("minmax_scale", f"WITH {T.EVENTS} SELECT event_id, round(CASE WHEN max(cases) OVER w = min(cases) OVER w THEN 0 ELSE (cases - min(cases) OVER w) / (max(cases) OVER w - min(cases) OVER w)::DOUBLE END, 6) AS scaled FROM ev WHERE cases IS NOT NULL WINDOW w AS (PARTITION BY disease)")
def minmax_scale(spark, d):
    """Scaled to [0, 1] by disease; a constant group is 0. Bounds are aggregated and joined back."""
    e = T.events(spark, d).where("cases is not null")
    bounds = e.groupBy("disease").agg(F.min("cases").alias("low"), F.max("cases").alias("high"))
    return e.join(bounds, "disease").select("event_id", r6(F.when(c("high") == c("low"), 0.0).otherwise((c("cases") - c("low")) / (c("high") - c("low"))), "scaled"))


@query("fingerprint", "SELECT DISTINCT substring(sha1(source_name || '|' || record_id || '|' || coalesce(CAST(published_at AS VARCHAR), 'None')), 1, 12) AS fp, record_id FROM source_provenance WHERE source_name IS NOT NULL AND record_id IS NOT NULL")
def fingerprint(spark, d):
    p = table(spark, d, "source_provenance").where(c("source_name").isNotNull() & c("record_id").isNotNull())
    return p.select(F.substring(F.sha1(F.concat_ws("|", "source_name", "record_id", F.coalesce(c("published_at").cast("string"), F.lit("None")))), 1, 12).alias("fp"), "record_id").distinct()


@query("temporal_split", f"WITH {T.EVENTS} SELECT CASE WHEN reference_date <= DATE '2021-12-31' THEN 'train' WHEN reference_date <= DATE '2022-12-31' THEN 'calibration' ELSE 'test' END AS split, count(*) AS n FROM ev GROUP BY 1")
def temporal_split(spark, d):
    split = F.when(c("reference_date") <= pit.day("2021-12-31"), "train").when(c("reference_date") <= pit.day("2022-12-31"), "calibration").otherwise("test")
    return T.events(spark, d).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


# --- order, sets, serving --------------------------------------------------------------------------------------------


@query("sort_multi", f"WITH {T.EVENTS} SELECT event_id, row_number() OVER (ORDER BY entity_key, available_from, event_id) - 1 AS place FROM ev")
def sort_multi(spark, d):
    """Total order by several keys: range partitions with offsets, so that neither one entity nor all rows are one task."""
    rows = T.events(spark, d).select("entity_key", "available_from", "event_id").withColumn("_1", F.lit(1))
    return decide.prefix_sum(rows, ["entity_key", "available_from", "event_id"], "_1", "place").select("event_id", c("place").cast("long").alias("place"))


@query("best_per_group", f"WITH {T.EVENTS} SELECT country, event_id, cases FROM ev WHERE cases IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country ORDER BY cases DESC, event_id) = 1")
def best_per_group(spark, d):
    best = F.min(F.struct((-c("cases")).alias("n"), "event_id", "cases")).alias("b")
    return T.events(spark, d).where("cases is not null").groupBy("country").agg(best).select("country", "b.event_id", "b.cases")


@query("limit_topn", f"WITH {T.EVENTS} SELECT event_id, cases FROM ev WHERE cases IS NOT NULL ORDER BY cases DESC, event_id LIMIT 50")
def limit_topn(spark, d):
    return T.events(spark, d).where("cases is not null").orderBy(F.desc("cases"), "event_id").limit(50).select("event_id", "cases")


@query("union_all", f"WITH {T.EVENTS}, {T.SIGNALS} SELECT entity_key, 'event' AS kind, reference_date FROM ev UNION ALL SELECT entity_key, 'signal', reference_date FROM sg")
def union_all(spark, d):
    part = lambda f, k: f.select("entity_key", F.lit(k).alias("kind"), "reference_date")
    return part(T.events(spark, d), "event").unionByName(part(T.signals(spark, d), "signal"))


@query("set_overlap", f"WITH {T.EVENTS} SELECT entity_key, week, list_has_any(list(DISTINCT source_name), ['WAHIS', 'EMPRES-i']) AS official FROM ev GROUP BY 1, 2")
def set_overlap(spark, d):
    return T.events(spark, d).groupBy("entity_key", "week").agg(F.arrays_overlap(F.collect_set("source_name"), F.array(F.lit("WAHIS"), F.lit("EMPRES-i"))).alias("official"))


@query("distinct_first", "SELECT DISTINCT ON (upper(trim(event_id))) upper(trim(event_id)) AS event_id, publication_date FROM canonical_events WHERE publication_date IS NOT NULL ORDER BY upper(trim(event_id)), publication_date")
def distinct_first(spark, d):
    return table(spark, d, "canonical_events").where("publication_date is not null").groupBy(code(c("event_id")).alias("event_id")).agg(F.min("publication_date").alias("publication_date"))


@query("replay_roles", f"WITH {T.EVENTS} SELECT event_id, CASE WHEN available_from <= DATE '{AS_OF}' THEN 'knowable_then' ELSE 'after_as_of_outcome' END AS role FROM ev")
def replay_roles(spark, d):
    return T.events(spark, d).select("event_id", F.when(c("available_from") <= pit.day(AS_OF), "knowable_then").otherwise("after_as_of_outcome").alias("role"))


@query("coverage_topn", f"WITH {T.EVENTS} SELECT disease, country, count(*) AS n FROM ev GROUP BY 1, 2 ORDER BY n DESC, disease, country LIMIT 20")
def coverage_topn(spark, d):
    return T.events(spark, d).groupBy("disease", "country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "disease", "country").limit(20)
