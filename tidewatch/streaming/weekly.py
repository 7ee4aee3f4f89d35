"""Structured Streaming twins of the weekly roll-up and of quiet-gap sessions.

The same DataFrame code runs on a stream and on a table. Windows and sessions are written once, when the watermark has
passed them (append mode): the state store drops them then, and rows that come later still are refused. Results go to a
file sink and the query's state to a checkpoint, both in the shared folder, so that a lost executor or a restart goes on
where it was and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.missing import code, date_value
from tidewatch.session import shared_folder


def weekly_counts(stream: DataFrame, time: str = "ts", lateness: str = "42 days") -> DataFrame:
    """Counts per event type and Monday week (the epoch was a Thursday: windows start four days later)."""
    w = F.window(time, "7 days", "7 days", "4 days")
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, lateness).groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").cast("date").alias("week"), "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str, lateness: str = "42 days") -> DataFrame:
    """Sessions per key, closed by a quiet gap. Whole-day data that must split at a gap of g days takes g - 1 days: a record
    exactly at the end of a session still joins it."""
    w = F.session_window(time, gap)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, lateness).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").cast("date").alias("start"), "n")


def notifications(events: DataFrame) -> DataFrame:
    """(entity_key, nd) of event records with a notification date."""
    rows = events.select(F.concat_ws("|", code(F.col("country_iso3")), code(F.col("disease"))).alias("entity_key"), date_value(F.col("notification_date")).alias("nd"))
    return rows.where(F.col("nd").isNotNull())


def run_available(spark: SparkSession, path: str, prepare: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], time: str, folder: str | None = None) -> DataFrame:
    """Runs a streaming query over everything available now and returns what it wrote.

    At the end of the input one heartbeat far ahead moves the watermark past the last window, which would otherwise wait for
    later data. Its own window never closes, so it isn't part of the result."""
    table = spark.read.parquet(path)
    parent, _, name = path.rpartition("/")
    reader = spark.readStream.schema(table.schema)
    # a table is a folder of files or one file, and a stream reads folders
    one_file = not any(f"/{name}/" in f for f in table.inputFiles()[:1])
    source = prepare(reader.option("pathGlobFilter", name).parquet(parent) if one_file else reader.parquet(path))
    folder = folder or shared_folder(spark, "stream")
    beat = spark.range(1).select(*(F.lit("2200-01-01" if f.name == time else None).cast(f.dataType).alias(f.name) for f in source.schema))
    beat.write.mode("overwrite").parquet(f"{folder}/heartbeat")
    heartbeats = spark.readStream.schema(source.schema).parquet(f"{folder}/heartbeat")
    result = build(source.unionByName(heartbeats))  # the watermark is taken behind the union, so one suffices
    result.writeStream.format("parquet").option("path", f"{folder}/result").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/result")

