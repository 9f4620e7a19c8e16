"""Additive statistics over a stream of scans. Beyond what the batch engine needs; the same function serves both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplemark.operators.aggregates import co_moment


def moments(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, n, sx, sy and the sums of products about the means xx, xy, yy, which merge over parts of the data without cancellation, batch or stream."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), co_moment(x, x).alias("xx"), co_moment(x, y).alias("xy"), co_moment(y, y).alias("yy"))


def windowed_moments(rows: DataFrame, time: str, length: str, late: str, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """moments in windows of event time; rows later than ``late`` are left out, and their windows' state is dropped."""
    return moments(rows.withWatermark(time, late).withColumn("window", F.window(time, length)), ["window", *keys], x, y)


def effects(m: DataFrame) -> DataFrame:
    """Slope of y on x and an intercept, from moments; null where x is constant."""
    return m.withColumn("effect", F.when(F.col("xx") > 0, F.try_divide(F.col("xy"), F.col("xx"))))


def start(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet, exactly once."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
