"""Queries of sources and sinks, nested documents, adapters and settings, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions import settings as S
from tidewatch.functions.missing import code, date_value
from tidewatch.operators.decide import LEVELS
from tidewatch.plans.registry import registry
from tidewatch.session import shared_folder, table
from tidewatch.sources import adapters, files, nested
from tidewatch.sources import tables as T

QUERIES, ORACLE, query = registry()
c = F.col

_PLAIN = "SELECT event_id, trim(country_name) AS country_name, reference_date, latitude, cases FROM canonical_events WHERE event_id IS NOT NULL"


def _plain(spark, d):
    return table(spark, d, "canonical_events").where("event_id is not null").select("event_id", F.nullif(F.trim("country_name"), F.lit("")).alias("country_name"), "reference_date", "latitude", "cases")


@query("scan_csv", _PLAIN.replace("trim(country_name)", "nullif(trim(country_name), '')").replace("event_id, ", "trim(event_id) AS event_id, ", 1))
def scan_csv(spark, d):
    """Events through a CSV file: written, then read with a schema and typed dates."""
    path = shared_folder(spark, "events-csv")
    files.write_csv(_plain(spark, d).withColumn("event_id", F.trim("event_id")), path)
    return files.read_csv(spark, path, "event_id string, country_name string, reference_date string, latitude double, cases long", dates=["reference_date"])


@query("json_roundtrip", "SELECT signal_id, signal_name, CASE WHEN NOT isnan(value) THEN value END AS value, reference_date FROM signal_records")
def json_roundtrip(spark, d):
    """Signals through JSON: NaN becomes null, dates are ISO text."""
    path = shared_folder(spark, "signals-json")
    files.write_json(table(spark, d, "signal_records").select("signal_id", "signal_name", "value", "reference_date"), path)
    return files.read_json(spark, path, "signal_id string, signal_name string, value double, reference_date date")


@query("sink_parquet", _PLAIN.replace("trim(country_name)", "nullif(trim(country_name), '')"))
def sink_parquet(spark, d):
    """Events through a Parquet table written as a whole and read by column."""
    path = shared_folder(spark, "events-parquet")
    files.write_parquet(_plain(spark, d), path)
    return files.read_parquet(spark, path, ["event_id", "country_name", "reference_date", "latitude", "cases"])


# --- nested documents ------------------------------------------------------------------------------------------------

_DISEASE_SQL = "CASE WHEN upper(trim(disease)) IN ('HPAI', 'ASF', 'FMD', 'LSD', 'PPR') THEN upper(trim(disease)) END"
_ALERT = f"al AS (SELECT *, CASE WHEN regexp_full_match(upper(trim(country_iso3)), '[A-Z]{{3}}') THEN upper(trim(country_iso3)) END AS iso3, {_DISEASE_SQL} AS dis FROM (SELECT DISTINCT event_id, source_name, country_iso3, disease, cases, confirmation_status, species, summary, reference_date, publication_date FROM alert_events))"


def _alerts(spark, d):
    rows = table(spark, d, "alert_events").select("event_id", "source_name", "country_iso3", "disease", "cases", "confirmation_status", "species", "summary", "reference_date", "publication_date").distinct()
    plain = code(c("disease"))
    return rows.withColumn("code", F.when(plain.isin(*labels.DISEASE_PATTERNS), plain))


def _countries(spark, d):
    """Labels of countries: their codes."""
    codes = table(spark, d, "alert_events").select(code(c("country_iso3")).alias("iso3")).where(c("iso3").rlike("^[A-Z]{3}$")).distinct()
    return codes.select(labels.fold(c("iso3")).alias("label"), "iso3")


@query("json_flatten", f"""WITH {_ALERT} SELECT 'BEACON-' || event_id AS signal_id, coalesce(reference_date, publication_date) AS detected, coalesce(publication_date, reference_date) AS screened, iso3, dis AS disease, round(CASE WHEN cases IS NULL THEN 0.65 ELSE greatest(0.05, least(1.0, CASE WHEN cases > 1 THEN cases / 10.0 ELSE cases END)) END, 6) AS strength,
 CASE WHEN confirmation_status = 'laboratory_confirmed' THEN 'verified' ELSE 'unverified' END AS verification, CASE WHEN source_name = 'BEACON' THEN 'media;official' ELSE 'media' END AS underlying FROM al WHERE iso3 IS NOT NULL AND dis IS NOT NULL""")
def json_flatten(spark, d):
    """Alerts as nested report documents in JSON text, parsed and flattened."""
    a = _alerts(spark, d)
    version = F.struct(
        F.lit("Report").alias("title"), c("reference_date").cast("string").alias("eventDate"), c("cases").cast("string").alias("severityScore"), F.when(c("source_name") == "BEACON", F.array(F.lit("Ministry of Agriculture"))).alias("sources"),
        F.struct(F.array("code").alias("processed")).alias("diseaseList"),
        F.struct(F.array(F.struct(F.lit("??").alias("shortCode"), F.trim("country_iso3").alias("label"))).alias("borders"), F.array(F.struct((c("confirmation_status") == "laboratory_confirmed").alias("isVerified"))).alias("pins")).alias("map"),
    )
    text = a.select(F.to_json(F.struct(c("event_id").alias("id"), c("publication_date").cast("string").alias("publishedAt"), version.alias("latestVersion"))).alias("j"))
    parsed = text.select(F.from_json("j", nested.REPORT).alias("r")).select("r.*")
    return nested.reports(parsed, _countries(spark, d)).select("signal_id", "detected", "screened", "iso3", "disease", F.round("strength", 6).alias("strength"), "verification", "underlying")


@query("label_relevance", f"""WITH {_ALERT} SELECT 'PADI-' || event_id AS article_id, coalesce(publication_date, reference_date) AS published, iso3, dis AS disease, CASE WHEN species IS NOT NULL THEN 0.85 WHEN confirmation_status = 'rumour' THEN 0.15 ELSE 0.50 END::DOUBLE AS relevance, species IS NOT NULL OR coalesce(confirmation_status = 'laboratory_confirmed', FALSE) AS is_event, 'en' AS language FROM al WHERE iso3 IS NOT NULL AND dis IS NOT NULL""")
def label_relevance(spark, d):
    """Alerts as classified articles in JSON text: relevance and event flag from their labels."""
    a = _alerts(spark, d)
    name = lambda x: F.struct(x.alias("name"))
    marks = F.array(name(F.when(c("species").isNotNull(), F.lit(" Relevant"))), name(F.when(c("confirmation_status") == "rumour", F.lit("irrelevant"))), name(F.when(c("confirmation_status") == "laboratory_confirmed", F.lit("Outbreak declaration"))))
    text = a.select(F.to_json(F.struct(c("event_id").alias("id"), F.trim("country_iso3").alias("country"), c("publication_date").cast("string").alias("published_at"), c("reference_date").cast("string").alias("created_at"), F.struct(c("code").alias("source_category")).alias("rssfeed"), marks.alias("machine_classification_labels"))).alias("j"))
    parsed = text.select(F.from_json("j", nested.ARTICLE).alias("r")).select("r.*")
    return nested.articles(parsed, _countries(spark, d)).select("article_id", "published", "iso3", "disease", "relevance", "is_event", "language")


@query("camel_split", f"""WITH {_ALERT} SELECT 'EIOS-NM-' || event_id AS item_id, publication_date AS first_seen, iso3, dis AS disease, round(CASE WHEN cases > 0 THEN greatest(0.55, least(1.0, cases / 500.0)) ELSE 0.55 END, 6) AS relevance FROM al WHERE iso3 IS NOT NULL AND dis IN ('HPAI', 'ASF')""")
def camel_split(spark, d):
    """Alerts as news-map items in JSON text: camel-cased category ids, scores reduced to the largest."""
    a = _alerts(spark, d)
    topic = F.when(c("code") == "HPAI", F.lit("BirdFluH5N1")).when(c("code") == "ASF", F.lit("AfricanSwineFever"))
    ids = F.array(F.lit("EIOS.Animal"), topic, F.concat(F.initcap(F.lower(F.trim("country_iso3")))))
    text = a.where(topic.isNotNull()).select(F.to_json(F.struct(c("event_id").alias("guid"), c("publication_date").cast("string").alias("pubDate"), ids.alias("categoryIds"), F.struct(F.array(F.struct(F.lit("score").alias("id"), c("cases").cast("double").alias("score"))).alias("categories")).alias("detail"))).alias("j"))
    parsed = text.select(F.from_json("j", nested.ITEM).alias("r")).select("r.*")
    return nested.items(parsed, _countries(spark, d)).select("item_id", "first_seen", "iso3", "disease", F.round("relevance", 6).alias("relevance"))


# --- adapters and settings -------------------------------------------------------------------------------------------


def registry_of(d: str) -> adapters.Registry:
    """The published sources over the input tables: events and alerts by their source name, signals, covariates."""
    reg = adapters.Registry()
    by = lambda name, t: lambda spark: table(spark, d, t).where(F.regexp_replace(F.lower("source_name"), "[^a-z0-9]", "") == "".join(ch for ch in name.lower() if ch.isalnum()))
    ids = lambda raw: raw.select(code(c("event_id")).alias("event_id"), code(c("country_iso3")).alias("country"), code(c("disease")).alias("disease"), date_value(c("reference_date")).alias("reference_date"), date_value(c("available_from")).alias("available_from")).distinct()
    for name, kind, tier, cluster, reliability, lag, downstream in adapters.SOURCES:
        where = {"official": "canonical_events", "official_derived": "canonical_events"}.get(kind) or ("canonical_events" if name in ("PADIWeb", "ProMED") else "alert_events" if kind in ("media", "aggregator") else "covariate_records")
        shape = (lambda raw: {"events": ids(raw)}) if where != "covariate_records" else (lambda raw: {"covariates": raw.select("covariate_id", code(c("country_iso3")).alias("country"), "variable", "value", date_value(c("available_from")).alias("available_from")).distinct()})
        reg.add(adapters.Adapter(name, kind, tier, cluster, reliability, lag, by(name, where), shape, downstream))
    return reg


@query("source_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', '{t}', '{cl}', {r}::DOUBLE, {lag}, {str(down).upper()}, TRUE)" for n, k, t, cl, r, lag, down in adapters.SOURCES) + ") AS v(source_name, source_type, source_tier, evidence_cluster, reliability, lag_days, downstream_of_official, enabled)")
def source_catalogue(spark, d):
    return registry_of(d).catalogue(spark)


@query("collect_sources", f"""WITH r AS (SELECT event_id, country_iso3, disease, reference_date, available_from, source_name FROM canonical_events UNION ALL SELECT event_id, country_iso3, disease, reference_date, available_from, source_name FROM alert_events WHERE trim(source_name) IN ('HealthMap', 'BEACON', 'EIOS')),
x AS (SELECT DISTINCT upper(trim(event_id)) AS event_id, upper(trim(country_iso3)) AS country, upper(trim(disease)) AS disease, CASE WHEN reference_date {T._OK} THEN reference_date END AS reference_date, CASE WHEN available_from {T._OK} THEN available_from END AS available_from, source_name FROM r WHERE available_from {T._OK} AND available_from <= DATE '2024-12-31')
SELECT event_id, country, disease, reference_date, available_from, CASE WHEN source_name = 'PADI-web' THEN 'PADIWeb' ELSE source_name END AS source_name, CASE source_name WHEN 'WAHIS' THEN 0.95 WHEN 'EMPRES-i' THEN 0.80 WHEN 'BEACON' THEN 0.70 WHEN 'PADI-web' THEN 0.58 WHEN 'EIOS' THEN 0.55 WHEN 'HealthMap' THEN 0.44 ELSE 0.66 END::DOUBLE AS reliability, source_name = 'EMPRES-i' AS is_downstream_of_official FROM x""")
def collect_sources(spark, d):
    """The event tables of all registered sources up to the cut-off, united by column name."""
    found, _ = registry_of(d).run(spark, cutoff="2024-12-31")
    return found["events"].select("event_id", "country", "disease", "reference_date", "available_from", "source_name", "reliability", "is_downstream_of_official")


@query("config_dims", "SELECT * FROM (VALUES ('level', 'NONE', NULL), ('level', 'INFO', 0.08), ('level', 'WATCH', 0.20), ('level', 'ALERT', 0.40), ('level', 'CRITICAL', 0.65), ('priority', 'low', NULL), ('priority', 'moderate', 0.30), ('priority', 'high', 0.52), ('priority', 'very_high', 0.72), ('gate', 'ALERT', 1.35), ('gate', 'CRITICAL', 2.10)) AS v(kind, name, low)")
def config_dims(spark, d):
    """Thresholds as a dimension."""
    rows = [("level", n, low) for n, low in LEVELS] + [("priority", n, low) for n, low in S.PRIORITY_BANDS] + [("gate", n, low) for n, low in S.GATES.items()]
    return spark.createDataFrame(rows, "kind string, name string, low double")
