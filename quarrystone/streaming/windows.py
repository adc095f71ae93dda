"""Windowed counts; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stamped(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with ts as an instant; on a stream with the watermark ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def counts(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows: window_start, event_type, n, total."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user that end after a ``gap`` without events: user_id, session_start, n."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
