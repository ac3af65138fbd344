"""Sessions of an unbounded message stream whose times are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Sessions per key: start, end, number of events.

    A session is complete once the watermark has passed its end by the gap; events that
    are later than ``late`` are left out.  State is one entry per open session.
    """
    grouped = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, f"{gap_seconds} seconds").alias("w"))
    counted = grouped.agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"))
    return counted.drop("w")


def stream_counts(events: DataFrame, keys: list[str], ts: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per key and window of time, tumbling unless a slide is given."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
