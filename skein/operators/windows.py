"""Event-time windows, for batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAIVE = "timestamp_ntz"


def _measured(df: DataFrame, window, keys: list[str]) -> DataFrame:
    grouped = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast(NAIVE).alias("start"), *keys, "n", "total")


def tumbling(df: DataFrame, time: str, width: str, keys: list[str]) -> DataFrame:
    """Rows and the sum of `value` for each window and key."""
    return _measured(df, F.window(time, width), keys)


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: list[str]) -> DataFrame:
    return _measured(df, F.window(time, width, slide), keys)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    """First and last time and rows of each session; a row within the gap of
    the row before it belongs to its session."""
    grouped = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n"))
    return grouped.select(*keys, F.col("start").cast(NAIVE).alias("start"), F.col("stop").cast(NAIVE).alias("stop"), "n")
