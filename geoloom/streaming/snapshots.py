"""Streams over events, and tile summaries kept current as cell snapshots arrive (beyond parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream needs instants for its watermark; a batch keeps the type it has."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each type in fixed windows; rows later than the watermark are dropped by the stream."""
    return _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tile_counts(cells: DataFrame, tile: int) -> DataFrame:
    """(tile_r, tile_c, class_id, px) that grows with every micro-batch of cells."""
    return cells.where("valid").groupBy(F.floor(F.col("r") / tile).alias("tile_r"), F.floor(F.col("c") / tile).alias("tile_c"), "class_id").agg(F.count("*").alias("px"))
