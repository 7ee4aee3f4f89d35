"""Late and out-of-order events: mergeable partial aggregates per period and arrival batch.

A period is a Monday week of event time. Every arrival batch (a Monday week of arrival time) contributes one partial
row per (source, entity, period). Partials only hold sums, minima and maxima, so they merge in any order: combining on
read gives the count known at any moment, and a later batch corrects a period without touching the raw rows again. A
period closes ``cutoff_days`` after its last day; an arrival after that is refused and tallied, never silently lost.

The partials are a written table (``Store``), one folder per load, so that loading again after a failure replaces what the
load had written. Reads combine the partials of all loads; ``refused_records`` asks the store which cells hold refusals.

Defined cases: a record without event date or arrival belongs to no period and is left out; of the deliveries of one
record the first non-missing arrival decides; repeated rows count once; an empty input gives empty partials.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.missing import code, date_value

CUTOFF_DAYS = 42


def week_of(column):
    return F.date_trunc("week", column).cast("date")


def first_deliveries(frame: DataFrame, source: str, record: str, entity, event_date: str, arrival: str) -> DataFrame:
    """One row per record: its event date and first non-missing arrival (a map-side combined aggregate, so many
    deliveries of one record cost one row per map task)."""
    return (
        frame.select(
            F.trim(F.col(record)).alias("record_id"),
            code(F.col(record)).alias("record_key"),
            entity.alias("entity_key"),
            date_value(F.col(event_date)).alias("event_date"),
            date_value(F.col(arrival)).alias("arrival_date"),
        )
        .where(F.col("record_id") != "")
        .groupBy("record_key")
        .agg(
            F.min("record_id").alias("record_id"),
            F.min("entity_key").alias("entity_key"),
            F.min("event_date").alias("event_date"),
            F.min("arrival_date").alias("arrival_date"),
        )
        .where(F.col("event_date").isNotNull() & F.col("arrival_date").isNotNull())
        .select(F.lit(source).alias("source_table"), "record_id", "entity_key", "event_date", "arrival_date")
    )


def classify(deliveries: DataFrame, cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """Adds the period, the arrival batch, the day the period closes and whether the arrival is refused."""
    period = week_of(F.col("event_date"))
    closes = F.date_add(period, 6 + cutoff_days)
    return deliveries.select(
        "*",
        period.alias("period"),
        week_of(F.col("arrival_date")).alias("arrival_batch"),
        closes.alias("closes_on"),
        (F.col("arrival_date") > closes).alias("refused"),
    )


def partials(classified: DataFrame) -> DataFrame:
    """Partial aggregates per (source, entity, period, arrival batch): the accepted records, and how many were refused."""
    taken = ~F.col("refused")
    when = lambda x: F.when(taken, x)
    return classified.groupBy("source_table", "entity_key", "period", "arrival_batch").agg(
        F.count_if(taken).alias("n"),
        F.coalesce(F.sum(when(F.datediff("arrival_date", "event_date").cast("long"))), F.lit(0)).alias("delay_sum"),
        F.min(when(F.col("arrival_date"))).alias("first_arrival"),
        F.max(when(F.col("arrival_date"))).alias("last_arrival"),
        F.count_if(F.col("refused")).alias("n_refused"),
    )


def merge_partials(*stores: DataFrame) -> DataFrame:
    """Incremental merge of stores of partials; associative and commutative."""
    merged = stores[0]
    for store in stores[1:]:
        merged = merged.unionByName(store)
    return merged.groupBy("source_table", "entity_key", "period", "arrival_batch").agg(
        F.sum("n").alias("n"),
        F.sum("delay_sum").alias("delay_sum"),
        F.min("first_arrival").alias("first_arrival"),
        F.max("last_arrival").alias("last_arrival"),
        F.sum("n_refused").alias("n_refused"),
    )


@dataclass(frozen=True)
class Store:
    """Partials of all loads under one folder of shared storage."""

    spark: SparkSession
    folder: str

    def append(self, classified: DataFrame, load: Column) -> None:
        """Writes the partials of each load of the batch; a load that is written again replaces its earlier self."""
        made = partials_of_loads(classified.withColumn("load", load))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(self.folder)

    def read(self) -> DataFrame:
        """The partials merged over loads: one row per (source, entity, period, arrival batch)."""
        return merge_partials(self.spark.read.parquet(self.folder).drop("load"))


def partials_of_loads(classified: DataFrame) -> DataFrame:
    per = classified.withColumn("source_table", F.struct("source_table", "load"))
    return partials(per).select("source_table.source_table", "source_table.load", "entity_key", "period", "arrival_batch", "n", "delay_sum", "first_arrival", "last_arrival", "n_refused")


def combine(store: DataFrame, known_on: str | None = None) -> DataFrame:
    """Counts per period on read; with ``known_on`` only the batches that had begun by then."""
    if known_on is not None:
        store = store.where(F.col("arrival_batch") <= F.lit(known_on).cast("date"))
    return store.where(F.col("n") > 0).groupBy("source_table", "entity_key", "period").agg(
        F.sum("n").alias("n"),
        F.sum("delay_sum").alias("delay_sum"),
        F.min("first_arrival").alias("first_arrival"),
        F.max("last_arrival").alias("last_arrival"),
        F.count("*").alias("n_batches"),
    )


def refused_records(classified: DataFrame, store: DataFrame) -> DataFrame:
    """The records that the store refused: those of its cells with refusals that arrived after their period had closed."""
    cells = store.where(F.col("n_refused") > 0).select("source_table", F.coalesce("entity_key", F.lit("")).alias("_e"), "period", "arrival_batch")
    keyed = classified.where(F.col("refused")).withColumn("_e", F.coalesce("entity_key", F.lit("")))
    return keyed.join(cells, ["source_table", "_e", "period", "arrival_batch"], "left_semi").drop("_e")


def refused(classified: DataFrame) -> DataFrame:
    """The records that arrived after their period had closed, without a store."""
    return classified.where(F.col("refused"))
