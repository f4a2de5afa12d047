"""Streams of events and encounters, with the same transforms as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 day", late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event_type in tumbling windows, or sliding ones; later rows are dropped from streams."""
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = df.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions by user: rows less than gap apart."""
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = df.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> None:
    """Runs a stream over what is there into a memory table, and stops it."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
