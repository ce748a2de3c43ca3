"""Windows over request telemetry and conversations; the same functions take batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's watermark needs a zoned timestamp; batches stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def request_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and mean value by window and type; on a stream, rows more than `late` behind are dropped."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean_value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no pause longer than the gap."""
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
