"""Queries of the llm problems, with the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.missing import FILLERS_SQL, code, coordinates, count_value, date_value, group_value, id_value, text_value
from tidewatch.llm import components, encode, leaks, linkage, pii, survivor
from tidewatch.session import table

# --- problem 2 -------------------------------------------------------------------------------------------------------


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs with the confidence that soft logic gives them."""
    pairs = linkage.match(table(spark, d, "alert_events"), table(spark, d, "canonical_events"))
    return pairs.select("a_id", "e_id", F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = linkage.match(table(spark, d, "alert_events"), table(spark, d, "canonical_events"))
    pairs = pairs.where(F.col("confidence") >= linkage.THRESHOLD)
    return pairs.select(F.least("a_id", "e_id").alias("key_lo"), F.greatest("a_id", "e_id").alias("key_hi")).distinct()


# --- problem 3 -------------------------------------------------------------------------------------------------------


def _bare(column):
    """An event id without the spellings of a citation: source prefix and version suffix."""
    return F.regexp_replace(F.regexp_replace(id_value(column), "^.*::\\s*", ""), "/V[0-9]+$", "")


def event_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges (u, v): events and the hub of their canonical id, events and the event they cite, accepted matches."""
    events = table(spark, d, "canonical_events").select(
        id_value(F.col("event_id")).alias("id"), group_value(F.col("canonical_event_id")).alias("ce"), _bare(F.col("source_event_id")).alias("cited")
    ).where(F.col("id").isNotNull())
    known = events.select("id").distinct()
    # hubs sort after every id, so the smallest vertex of a group is always an event
    hubs = events.where(F.col("ce").isNotNull()).select(F.col("id").alias("u"), F.concat(F.lit("\uffff"), F.col("ce")).alias("v"))
    cites = events.where(F.col("cited") != F.col("id")).select(F.col("id").alias("u"), F.col("cited").alias("v")).distinct()
    matches = table(spark, d, "linkage_decisions").select(_bare(F.col("a")).alias("u"), _bare(F.col("b")).alias("v")).distinct()
    matches = matches.join(known.withColumnRenamed("id", "u"), "u", "left_semi")
    pairs = cites.unionByName(matches).join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
    return hubs.unionByName(pairs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of events tied directly or indirectly; see ``components``."""
    found = components.connected_components(event_links(spark, d), "u", "v").where(~F.col("vertex").startswith("\uffff"))
    return _groups_of_two(found)


def _groups_of_two(found: DataFrame) -> DataFrame:
    # whoever isn't the representative is in a group of two; only representatives are looked up, one row a group
    others = found.where(F.col("vertex") != F.col("component"))
    reps = found.where(F.col("vertex") == F.col("component")).join(others.select("component").distinct(), "component", "left_semi")
    return others.select("vertex", "component").unionByName(reps.select("vertex", "component")).select(F.col("vertex").alias("event_id"), F.col("component").alias("group_id"))


# --- problem 5 -------------------------------------------------------------------------------------------------------

# Source tiers of the ledger, the best first.
TIERS = ("primary_official", "secondary_official", "intelligence", "covariate", "none")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Event deliveries with the ledger's standing entry (the latest retrieved one) of their provenance."""
    tier = F.regexp_replace(F.lower(F.trim("source_tier")), "[\\s_-]+", "_")
    rank = F.coalesce(*(F.when(tier == t, F.lit(i)) for i, t in enumerate(TIERS)), F.lit(len(TIERS) - 1))
    ledger = (
        table(spark, d, "source_provenance")
        .select(id_value(F.col("provenance_id")).alias("entry"), "retrieved_at", date_value(F.col("published_at")).alias("published_at"), rank.alias("tier"))
        .where(F.col("entry").isNotNull())
        .groupBy("entry")
        .agg(F.max(F.struct("retrieved_at", "published_at", "tier")).alias("l"))
        .select("entry", "l.published_at", "l.tier")
    )
    lat, lon = coordinates(F.col("latitude"), F.col("longitude"))
    events = table(spark, d, "canonical_events").select(
        group_value(F.col("canonical_event_id")).alias("canonical_event_id"),
        F.trim("event_id").alias("event_id"),
        # events without an entry get a key of their own, or all of them would meet in one task
        F.coalesce(id_value(F.col("provenance_id")), F.concat(F.lit("\uffff"), "event_id")).alias("entry"),
        code(F.col("source_name")).alias("source"),
        text_value(F.col("admin1")).alias("admin1"),
        text_value(F.col("locality")).alias("locality"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        date_value(F.col("onset_date")).alias("onset_date"),
        count_value(F.col("cases")).alias("cases"),
    )
    return (
        events.where(F.col("canonical_event_id").isNotNull() & (F.col("event_id") != ""))
        .join(ledger, "entry", "left")
        .withColumn("tier", F.coalesce("tier", F.lit(len(TIERS) - 1)))
    )


FIELDS = ("admin1", "locality", "latitude", "onset_date", "cases")


def _order() -> list:
    return [F.col("tier"), F.coalesce(-F.unix_date("published_at"), F.lit(1 << 30)).alias("age")]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """What each record says of each field, in a form in which other spellings of a value are equal."""
    plain = lambda c: F.regexp_replace(F.lower(F.translate(c, "áéíóúöüäñ", "aeiououan")), "\\s+", " ")
    values = {
        "admin1": plain(F.col("admin1")), "locality": plain(F.col("locality")),
        "latitude": F.when(F.col("latitude").isNotNull(), F.concat_ws(",", F.round("latitude", 2), F.round("longitude", 2))),
        "onset_date": F.col("onset_date"), "cases": F.col("cases"),
    }
    return survivor.claims(_records(spark, d), "canonical_event_id", "source", {f: values[f] for f in FIELDS}, "event_id", F.struct(*_order()))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every field: the prescribed order of trust alone decides (tier, then date, then id), so no
    votes are counted and no reliabilities learned here; ``p5_truth`` is the operator in which they decide."""
    present = {f: F.col(f).isNotNull() for f in FIELDS}
    return survivor.by_precedence(_records(spark, d), "canonical_event_id", "event_id", present, _order())


def p5_truth(spark: SparkSession, d: str) -> DataFrame:
    """The surviving values by truth discovery without a prior: sources weigh by what the votes teach."""
    truths, _ = survivor.truth_discovery(_claims(spark, d))
    return truths.select(F.col("grp").alias("canonical_event_id"), "field", "value", "support")


# --- problem 8 -------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", encode.token_ids(F.col("text")).alias("ids"))


# --- problem 9 -------------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents with leaked spans, the spans cut out."""
    return leaks.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


# --- problem 10 ------------------------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its personal information replaced by typed placeholders."""
    return pii.redact(table(spark, d, "documents"))


QUERIES = {
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_truth": p5_truth,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
}

_FILLERS = FILLERS_SQL


def _id(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[0-9]') AND NOT regexp_matches(trim({c}), '^0+$') AND lower(trim({c})) NOT IN {_FILLERS} THEN upper(trim({c})) END"


def _group(c: str) -> str:
    """A stand-in for a group id may have a prefix before its zeros."""
    return f"CASE WHEN NOT regexp_full_match(trim({c}), '[^0-9]*0+') THEN {_id(c)} END"


def _text(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {_FILLERS} THEN trim({c}) END"


ORACLE = {
    "p3_found": f"""
WITH RECURSIVE ev AS (SELECT DISTINCT upper(trim(event_id)) AS id, {_group('canonical_event_id')} AS ce,
    regexp_replace(regexp_replace({_id('source_event_id')}, '^.*::\\s*', ''), '/V[0-9]+$', '') AS cited FROM canonical_events),
ids AS (SELECT DISTINCT id FROM ev),
edges AS (
  SELECT e.id AS a, m.id AS b FROM ev e JOIN (SELECT ce, min(id) AS id FROM ev GROUP BY ce) m ON m.ce = e.ce
  UNION SELECT e.id, i.id FROM ev e JOIN ids i ON i.id = e.cited
  UNION SELECT x.id, y.id FROM linkage_decisions l JOIN ids x ON x.id = regexp_replace(upper(trim(l.a)), '^.*::\\s*', '') JOIN ids y ON y.id = regexp_replace(upper(trim(l.b)), '^.*::\\s*', '')),
twice AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS s, a AS t FROM twice UNION SELECT r.s, e.b FROM reach r JOIN twice e ON e.a = r.t)
SELECT s AS event_id, min(t) AS group_id FROM reach GROUP BY s""",
    "p5_found": f"""
WITH led AS (
  SELECT upper(trim(provenance_id)) AS p, arg_max(struct_pack(t := regexp_replace(lower(trim(source_tier)), '[\\s_-]+', '_', 'g'), d := published_at), retrieved_at) AS l FROM source_provenance GROUP BY 1),
r AS (
  SELECT {_group('canonical_event_id')} AS canonical_event_id, trim(event_id) AS event_id,
    CASE l.t WHEN 'primary_official' THEN 0 WHEN 'secondary_official' THEN 1 WHEN 'intelligence' THEN 2 WHEN 'covariate' THEN 3 ELSE 4 END AS tier,
    CASE WHEN l.d BETWEEN DATE '1970-01-02' AND DATE '2099-12-30' THEN l.d END AS pub,
    {_text('admin1')} IS NOT NULL AS admin1, {_text('locality')} IS NOT NULL AS locality,
    latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0) AS latitude,
    coalesce(onset_date BETWEEN DATE '1970-01-02' AND DATE '2099-12-30', FALSE) AS onset_date, coalesce(cases >= 0, FALSE) AS cases
  FROM canonical_events LEFT JOIN led ON p = upper(trim(provenance_id))),
g AS (SELECT canonical_event_id FROM r WHERE canonical_event_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_id) > 1),
u AS (SELECT canonical_event_id, event_id, tier, pub, field FROM (UNPIVOT r ON admin1, locality, latitude, onset_date, cases INTO NAME field VALUE there) WHERE there)
SELECT canonical_event_id, field, event_id FROM u WHERE canonical_event_id IN (SELECT canonical_event_id FROM g)
QUALIFY row_number() OVER (PARTITION BY canonical_event_id, field ORDER BY tier, pub DESC NULLS LAST, event_id) = 1""",
}
