"""Windowed aggregates over event time; on a stream, rows later than the watermark are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, at: str, delay: str | None) -> DataFrame:
    return df.withWatermark(at, delay) if delay and df.isStreaming else df


def _windowed(df: DataFrame, window: Column, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return df.groupBy(window.alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def tumbling(df: DataFrame, at: str, size: str, aggregates: Sequence[Column], by: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    return _windowed(_late(df, at, delay), F.window(at, size), by, aggregates)


def sliding(df: DataFrame, at: str, size: str, slide: str, aggregates: Sequence[Column], by: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    return _windowed(_late(df, at, delay), F.window(at, size, slide), by, aggregates)


def session_windows(df: DataFrame, at: str, gap: str, aggregates: Sequence[Column], by: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """Windows that close when nothing came for `gap`."""
    return _windowed(_late(df, at, delay), F.session_window(at, gap), by, aggregates)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet; the rows that it has put out so far."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
