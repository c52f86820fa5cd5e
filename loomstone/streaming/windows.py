"""Event-time windows; the same functions serve batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str, by: list[str], aggs: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by window and keys; ``late`` is the watermark's delay, ``slide`` makes windows overlap."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates by sessions that end after a gap."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    out = df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def deduplicated(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; a stream forgets keys behind the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
