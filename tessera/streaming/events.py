"""Event-time windows over an element change stream: an extension, as the tiling itself has no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by type and window; rows later than ``late`` are left out. Works on batch and streaming input."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    per = stamped.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def live_density(nodes: DataFrame, shift: int, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Nodes per cell and window of a stream of (ts, mlat, mlon)."""
    cell = [F.shiftright(c, shift).alias(n) for c, n in (("mlon", "x"), ("mlat", "y"))]
    return nodes.withWatermark("ts", late).groupBy(F.window("ts", size), *cell).agg(F.count("*").alias("n"))
