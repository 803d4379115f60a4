"""Per-user counters over a stream of clicks: an extension of the batch features to windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counters(clicks: DataFrame, window: str = "1 day", lateness: str = "1 hour", ts: str = "datetime") -> DataFrame:
    """(window_start, user_id, clicks, total_time, avg_time); a watermark bounds the state, and later rows are dropped."""
    rows = clicks.where((F.col("duration") >= 0) & ~F.isnan("duration")).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (
        rows.groupBy(F.window(ts, window), "user_id")
        .agg(F.count("*").alias("clicks"), F.sum("duration").alias("total_time"), F.avg("duration").alias("avg_time"))
        .select(F.col("window.start").alias("window_start"), "user_id", "clicks", "total_time", "avg_time")
    )
