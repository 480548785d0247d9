"""Streaming extensions: running chromatograms and features closed by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_intensity(points: DataFrame, time: str, every: str, late: str, keys: list[str]) -> DataFrame:
    """Intensity by tumbling window; points later than the watermark are left out."""
    return points.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "intensity", "n")


def sessions(points: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Features: runs of points of a key that pause no longer than ``gap``; sent once they are closed."""
    return points.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.sum("intensity").alias("intensity"), F.max("intensity").alias("apex"), F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("final"), *keys, "intensity", "apex", "n")
