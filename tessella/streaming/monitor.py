"""An extension: a monitor of service events as a stream. The batch engine has no streaming counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latencies(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and event type: count, mean, 95th percentile. On a stream, state older than ``late`` is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.percentile_approx("value", 0.95).alias("p95"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "p95")
