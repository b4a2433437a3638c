"""Windowed summaries; the same functions on batch and streaming frames.

watermark bounds the state of a stream; it never touches the decision path, where late events are
flagged and still decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, window: Column, by: tuple[str, ...], watermark: str | None) -> DataFrame:
    if watermark:
        df = df.withWatermark("timestamp", watermark)
    out = df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def tumbling_counts(df: DataFrame, size: str, *by: str, watermark: str | None = None) -> DataFrame:
    return _counted(df, F.window("timestamp", size), by, watermark)


def sliding_counts(df: DataFrame, size: str, slide: str, *by: str, watermark: str | None = None) -> DataFrame:
    return _counted(df, F.window("timestamp", size, slide), by, watermark)


def session_counts(df: DataFrame, gap: str, *by: str, watermark: str | None = None) -> DataFrame:
    return _counted(df, F.session_window("timestamp", gap), by, watermark)
