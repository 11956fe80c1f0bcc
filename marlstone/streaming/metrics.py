"""Metrics over a stream of requests, by event time. An extension: windows and watermarks have no batch counterpart here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counters(requests: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, kind, n, total of each window of event time; rows later than `late` are dropped, as the watermark says."""
    timed = requests.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window).alias("_w"), F.col("event_type").alias("kind"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("_w.start").alias("start"), "kind", "n", "total")
