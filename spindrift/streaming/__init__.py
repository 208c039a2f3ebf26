"""Streams of events as minute bars.

The formula operators look back by rows, which streams don't offer; what a stream can do
is build the panel's bars as events come in, late ones up to a watermark included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, codes: int = 10, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of each code and time window from a stream of (ts, user_id, event_type, value)."""
    code = F.concat(F.lit("U"), (F.col("user_id") % codes).cast("string")).alias("code")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), code)
    return grouped.agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.avg("value").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("value").alias("amount"),
        F.max((F.col("event_type") == "purchase").cast("double")).alias("event_flag"),
    ).select("code", F.col("window.start").alias("trade_time"), "open", "high", "low", "close", "volume", "amount", "event_flag")
