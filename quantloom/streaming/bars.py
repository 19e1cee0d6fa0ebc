"""Streaming bars: closed hours only, late events dropped behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars of a stream of (event_id, ts, event_type, value), appended once their hour is closed."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("hour"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("n"))
        .select("symbol", F.col("hour.start").alias("hour"), "open", "high", "low", "close", "n")
    )
