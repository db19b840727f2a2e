"""Windowed aggregates over event streams; the same plan serves batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``event_type, window_start, events, total`` in tumbling hours; on a stream, rows later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, started, ended, events``: runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
