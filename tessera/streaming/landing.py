"""Continuous ingest and event windows (extensions: the batch operators on streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators.ingest import split_rejects


def ingest_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Append new texts of a landing folder to ``target``; repeats within ``delay`` of each other are dropped.

    ``schema`` has text and arrived_at (timestamp). State holds one key per distinct text and delay.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    good, _ = split_rejects(rows)
    keyed = good.withColumn("entry_id", t.entry_id(F.col("text"))).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["entry_id"])
    return keyed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, window: Column, watermark: str | None = None) -> DataFrame:
    """Count and sum of values per window and event type; with a watermark on a stream."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "event_type", "n", "total")


def tumbling(events: DataFrame, size: str = "1 day", watermark: str | None = None) -> DataFrame:
    return windowed(events, F.window("ts", size), watermark)


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", watermark: str | None = None) -> DataFrame:
    return windowed(events, F.window("ts", size, step), watermark)


def sessions(events: DataFrame, gap: str = "2 hours", watermark: str | None = None) -> DataFrame:
    """Count, first and last event of each user's sessions."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("user_id", "n", "first_ts", "last_ts")
