"""Windowed counts over event streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that are and come in a folder or match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    # Windows need an instant; event times are kept without a zone and mean UTC.
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of each window and type."""
    w = F.window("ts", width)
    found = _timed(events, lateness).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, slide)
    found = _timed(events, lateness).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n of each run of a user's events without a longer gap."""
    w = F.session_window("ts", gap)
    found = _timed(events, lateness).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"))
    start, end = (F.col(f"session_window.{x}").cast("timestamp_ntz").alias(f"session_{x}") for x in ("start", "end"))
    return found.select("user_id", start, end, "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that the stream has now as Parquet and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
