"""Queries of the general training-data problems: late events, units, attributes at event time, rolling totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.missing import FILLERS_SQL, NO_SCORE, code, count_value, date_value, id_value, score_value, text_value
from tidewatch.operators import late, rolling, units, versions
from tidewatch.session import checkpointed, shared_folder, table


def entity_of(country: str = "country_iso3", disease: str = "disease"):
    return F.when(code(F.col(country)).isNotNull() & code(F.col(disease)).isNotNull(), F.concat_ws("|", code(F.col(country)), code(F.col(disease))))


# --- problem 1 -------------------------------------------------------------------------------------------------------


def _classified(spark: SparkSession, d: str) -> DataFrame:
    events = late.first_deliveries(table(spark, d, "canonical_events"), "canonical_events", "event_id", entity_of(), "onset_date", "publication_date")
    signals = late.first_deliveries(table(spark, d, "signal_records"), "signal_records", "signal_id", entity_of(), "reference_date", "available_from")
    return late.classify(events.unionByName(signals))


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(classified deliveries, partials read from the store after all loads). A load is a month of arrivals; all loads of the
    history are appended in one pass."""
    classified = checkpointed(_classified(spark, d))
    store = late.Store(spark, shared_folder(spark, "p1-partials"))
    store.append(classified, F.date_format("arrival_batch", "yyyy-MM"))
    return classified, store.read()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that the store of partials refused because their period had closed; see ``operators.late``."""
    classified, store = _stored(spark, d)
    return late.refused_records(classified, store).select("source_table", "record_id")


def p1_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly counts per entity by event date, combined on read from the stored partials of all arrival batches."""
    return late.combine(_stored(spark, d)[1]).select(
        "source_table", "entity_key", "period", "n", "delay_sum", "first_arrival", "last_arrival", "n_batches"
    )


# --- problem 4 -------------------------------------------------------------------------------------------------------

_UNIT_RESULT = T.StructType([T.StructField("common_unit", T.StringType()), T.StructField("common_value", T.LongType())])


def with_common_units(rows: DataFrame) -> DataFrame:
    """Adds common_unit and common_value; an Arrow-batched UDF, so a scan stays a scan (no shuffle)."""
    udf = F.pandas_udf(units.to_common, _UNIT_RESULT)
    return rows.withColumn("common", udf("unit", "element", "note", F.col("value").cast("double"))).select(
        *rows.columns, "common.common_unit", "common.common_value"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "faostat_livestock_annual_sample").select("row_id", "unit", "element", "note", "value")
    return with_common_units(rows).where(F.col("common_value").isNotNull()).select("row_id", "common_unit", "common_value").distinct()


# --- problem 6 -------------------------------------------------------------------------------------------------------

WEATHER = ("t2m_mean_c", "total_precipitation_mm")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Weather and livestock records of each event's country as known on its reference date."""
    events = (
        table(spark, d, "canonical_events")
        .select(
            F.trim("event_id").alias("event_id"),
            code(F.col("country_iso3")).alias("country"),
            F.lower(F.trim("species")).alias("item"),
            date_value(F.col("reference_date")).alias("on_day"),
        )
        .where((F.col("event_id") != "") & F.col("on_day").isNotNull())
        .distinct()
    )
    wanted = events.select("event_id", "country", "on_day", F.explode(F.array(*map(F.lit, WEATHER))).alias("variable"))
    covariates = table(spark, d, "covariate_records").select(
        "covariate_id", code(F.col("country_iso3")).alias("country"), F.lower(F.trim("variable")).alias("variable"),
        "reference_date", "available_from",
    ).where(F.col("variable").isin(*WEATHER))
    weather = versions.as_known(
        wanted,
        F.concat_ws("|", "country", "variable"),
        F.col("on_day"),
        covariates,
        F.concat_ws("|", "country", "variable"),
        [date_value(F.col("reference_date")), date_value(F.col("available_from"))],
        [F.col("reference_date"), F.col("available_from"), F.col("covariate_id")],
        F.col("covariate_id"),
    ).select("event_id", "variable", F.col("chosen").alias("record_key"))
    stocks = table(spark, d, "faostat_livestock_annual_sample").select(
        "row_id", code(F.col("iso3")).alias("country"), F.lower(F.trim("item")).alias("item"), "year", "release_date", "element"
    ).where(F.lower("element").contains("stock"))
    livestock = versions.as_known(
        events,
        F.concat_ws("|", "country", "item"),
        F.col("on_day"),
        stocks,
        F.concat_ws("|", "country", "item"),
        [date_value(F.col("release_date"))],
        [F.coalesce("year", F.lit(-1)), F.col("release_date"), F.col("row_id")],
        F.col("row_id").cast("string"),
    ).select("event_id", F.lit("livestock_stocks").alias("variable"), F.col("chosen").alias("record_key"))
    return weather.unionByName(livestock).distinct()


# --- problem 7 -------------------------------------------------------------------------------------------------------


def signal_deliveries(spark: SparkSession, d: str, signal: str | None = None) -> DataFrame:
    """First and latest delivery of every record of one signal, or, without one, of all signals (the entity then ends with
    the signal's name). Signals that aren't counts may be negative."""
    name = F.lower(text_value(F.col("signal_name")))
    kept = F.when(name.endswith("_count"), count_value(F.col("value"))).otherwise(score_value(F.col("value")))
    entity = entity_of()
    if signal is None:
        entity = F.when(entity.isNotNull() & name.isNotNull(), F.concat_ws("|", entity, name))
    rows = (
        table(spark, d, "signal_records")
        .where(F.lit(True) if signal is None else name == signal)
        .select(
            id_value(F.col("signal_id")).alias("signal_key"),
            date_value(F.col("available_from")).alias("available_from"),
            F.nanvl(kept, F.lit(None).cast("double")).alias("value"),
            entity.alias("entity"),
            date_value(F.col("reference_date")).alias("day"),
        )
        .where(F.col("signal_key").isNotNull())
    )
    return rolling.deliveries(rows, "signal_key", "available_from", "value", "entity", "day")


def corrected_state(spark: SparkSession, d: str, signal: str | None = None) -> DataFrame:
    """The rolling state of the first deliveries (version 1), corrected by what was delivered again (version 2)."""
    pairs = checkpointed(signal_deliveries(spark, d, signal))
    daily = rolling.daily_amounts(pairs.select("first.*"), "entity", "day", "value")
    state = checkpointed(rolling.rolling_state(daily, run_out=True))
    corrected = rolling.correct_state(state, rolling.changes_of(pairs, "entity", "day", "value"))
    return rolling.counted_days(rolling.read_state(state, corrected))


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trailing totals and averages of every signal; entity_key is country|disease|signal_name."""
    state = corrected_state(spark, d)
    return state.select(
        "entity_key",
        "day",
        F.col("total_7").cast("double").alias("total_7"),
        F.col("total_30").cast("double").alias("total_30"),
        F.round(F.col("total_7").cast("double") / 7, 6).alias("mean_7"),
        F.round(F.col("total_30").cast("double") / 30, 6).alias("mean_30"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Days on which twice the 7-day total of news_article_count exceeds its 30-day total."""
    state = corrected_state(spark, d, "news_article_count")
    return state.where(F.col("total_7") * 2 > F.col("total_30")).select("entity_key", F.date_format("day", "yyyy-MM-dd").alias("day"))


QUERIES = {
    "p1_found": p1_found,
    "p1_weekly": p1_weekly,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_rolling": p7_rolling,
}

_VALID_DATE = "{0} BETWEEN DATE '1970-01-02' AND DATE '2099-12-30'"


def _d(column: str) -> str:
    return f"CASE WHEN {_VALID_DATE.format(column)} THEN {column} END"


_LATE = f"""
WITH raw AS (
  SELECT 'canonical_events' AS source_table, trim(event_id) AS record_id, upper(trim(country_iso3)) || '|' || upper(trim(disease)) AS entity_key,
         {_d('onset_date')} AS event_date, {_d('publication_date')} AS arrival_date FROM canonical_events
  UNION ALL
  SELECT 'signal_records', trim(signal_id), upper(trim(country_iso3)) || '|' || upper(trim(disease)), {_d('reference_date')}, {_d('available_from')} FROM signal_records),
rec AS (
  SELECT source_table, min(record_id) AS record_id, min(entity_key) AS entity_key, min(event_date) AS event_date, min(arrival_date) AS arrival_date
  FROM raw WHERE record_id <> '' GROUP BY source_table, upper(record_id)),
cls AS (
  SELECT *, CAST(date_trunc('week', event_date) AS DATE) AS period, CAST(date_trunc('week', arrival_date) AS DATE) AS batch,
         arrival_date > CAST(date_trunc('week', event_date) AS DATE) + 48 AS refused
  FROM rec WHERE event_date IS NOT NULL AND arrival_date IS NOT NULL)
"""

_ROLL = f"""
WITH best AS (
  SELECT upper(trim(signal_id)) AS sid, arg_max(struct_pack(v := value, e := upper(trim(country_iso3)) || '|' || upper(trim(disease)), d := {_d('reference_date')}),
         struct_pack(a := coalesce({_d('available_from')}, DATE '0001-01-01'), v := coalesce(CASE WHEN isnan(value) OR value < 0 THEN NULL ELSE value END, -1))) AS s
  FROM signal_records WHERE lower(trim(signal_name)) = 'news_article_count' AND trim(signal_id) <> '' GROUP BY 1),
daily AS (
  SELECT s.e AS entity_key, s.d AS day, sum(s.v) AS amount FROM best
  WHERE s.v IS NOT NULL AND NOT isnan(s.v) AND s.v >= 0 AND s.e IS NOT NULL AND s.d IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT entity_key, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY 1),
full_days AS (SELECT c.entity_key, c.day, coalesce(amount, 0) AS amount FROM cal c LEFT JOIN daily USING (entity_key, day)),
roll AS (
  SELECT entity_key, day, sum(amount) OVER (PARTITION BY entity_key ORDER BY day ROWS 6 PRECEDING) AS total_7,
         sum(amount) OVER (PARTITION BY entity_key ORDER BY day ROWS 29 PRECEDING) AS total_30 FROM full_days)
"""

_ROLL_ALL = f"""
WITH raw AS (
  SELECT upper(trim(signal_id)) AS sid, {_d('available_from')} AS a, upper(trim(country_iso3)) || '|' || upper(trim(disease)) || '|' || lower(trim(signal_name)) AS e, {_d('reference_date')} AS d,
    CASE WHEN isnan(value) THEN NULL WHEN lower(trim(signal_name)) LIKE '%_count' THEN CASE WHEN value >= 0 THEN value END WHEN value IN {NO_SCORE} THEN NULL ELSE value END AS v
  FROM signal_records WHERE trim(signal_id) <> '' AND lower(trim(signal_name)) NOT IN {FILLERS_SQL}),
best AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY sid ORDER BY a DESC NULLS LAST, v DESC NULLS LAST) = 1),
daily AS (SELECT e AS entity_key, d AS day, sum(v::DECIMAL(28, 6)) AS amount FROM best WHERE v IS NOT NULL AND e IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT entity_key, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY 1),
full_days AS (SELECT c.entity_key, c.day, coalesce(amount, 0) AS amount FROM cal c LEFT JOIN daily USING (entity_key, day)),
roll AS (
  SELECT entity_key, day, sum(amount) OVER (PARTITION BY entity_key ORDER BY day ROWS 6 PRECEDING) AS total_7,
         sum(amount) OVER (PARTITION BY entity_key ORDER BY day ROWS 29 PRECEDING) AS total_30 FROM full_days)
"""

ORACLE = {
    "p1_found": _LATE + "SELECT source_table, record_id FROM cls WHERE refused",
    "p1_weekly": _LATE
    + """SELECT source_table, entity_key, period, count(*) AS n, CAST(sum(arrival_date - event_date) AS BIGINT) AS delay_sum,
       min(arrival_date) AS first_arrival, max(arrival_date) AS last_arrival, count(DISTINCT batch) AS n_batches
FROM cls WHERE NOT refused GROUP BY 1, 2, 3""",
    "p6_found": f"""
WITH ev AS (SELECT DISTINCT trim(event_id) AS event_id, upper(trim(country_iso3)) AS c, lower(trim(species)) AS sp, {_d('reference_date')} AS d FROM canonical_events),
w AS (
  SELECT e.event_id, lower(trim(v.variable)) AS variable, arg_max(v.covariate_id, struct_pack(r := v.reference_date, a := v.available_from, i := v.covariate_id)) AS record_key
  FROM ev e JOIN covariate_records v ON upper(trim(v.country_iso3)) = e.c AND v.reference_date <= e.d AND v.available_from <= e.d
  WHERE lower(trim(v.variable)) IN ('t2m_mean_c', 'total_precipitation_mm') GROUP BY 1, 2),
s AS (
  SELECT e.event_id, 'livestock_stocks' AS variable, CAST(arg_max(f.row_id, struct_pack(y := f.year, r := f.release_date, i := f.row_id)) AS VARCHAR) AS record_key
  FROM ev e JOIN faostat_livestock_annual_sample f ON upper(trim(f.iso3)) = e.c AND lower(trim(f.item)) = e.sp AND f.release_date <= e.d
  WHERE lower(f.element) LIKE '%stock%' GROUP BY 1)
SELECT * FROM w UNION ALL SELECT * FROM s""",
    "p7_found": _ROLL + "SELECT entity_key, strftime(day, '%Y-%m-%d') AS day FROM roll WHERE 2 * total_7 > total_30",
    "p7_rolling": _ROLL_ALL
    + """SELECT entity_key, day, CAST(total_7 AS DOUBLE) AS total_7, CAST(total_30 AS DOUBLE) AS total_30,
       round(CAST(total_7 AS DOUBLE) / 7, 6) AS mean_7, round(CAST(total_30 AS DOUBLE) / 30, 6) AS mean_30 FROM roll""",
}
