"""Windows of events in time: an extension; the same plan runs on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window; with ``late``, a stream's events may come so late."""
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n) of runs of a user's events without a gap."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
