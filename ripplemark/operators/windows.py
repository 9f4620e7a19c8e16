"""Sequence operators over scans: lags, whitening, prefix sums, autocorrelation, orders and shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_moments(df: DataFrame, keys: Sequence[str], order: str = "scan", value: str = "y") -> DataFrame:
    """keys, m1 = sum of e_t e_(t-1), m0 = sum of e_(t-1)^2, ratio m1 / m0."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.select(*keys, F.col(value).alias("e"), F.lag(value).over(w).alias("before"))
    out = pairs.groupBy(*keys).agg(F.sum(F.col("e") * F.col("before")).alias("m1"), F.sum(F.col("before") * F.col("before")).alias("m0"))
    return out.withColumn("ratio", F.try_divide("m1", "m0"))


def whiten(df: DataFrame, keys: Sequence[str], rho: Column, order: str = "scan", value: str = "y") -> DataFrame:
    """Adds white: the first value as it is, then (v_t - rho v_(t-1)) / sqrt(1 - rho^2), which keeps the variance."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    return df.withColumn("white", F.when(before.isNull(), F.col(value)).otherwise((F.col(value) - rho * before) / F.sqrt(1 - rho * rho)))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "prefix") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def boxcar_peaks(kernel: DataFrame, counts: Sequence[int]) -> DataFrame:
    """count, peak: highest response of a kernel (sample, value) to a box of so many samples, from differences of prefix sums."""
    p = prefix_sums(kernel, [], "sample", "value") if not kernel.columns[2:] else prefix_sums(kernel, kernel.columns[2:], "sample", "value")
    size = kernel.agg((F.max("sample") + 1).alias("size"), F.max("sample").alias("last"))
    ends = p.select((F.col("sample") + 1).alias("place"), "prefix").unionByName(p.limit(1).select(F.lit(0).alias("place"), F.lit(0.0).alias("prefix")))
    wanted = kernel.sparkSession.createDataFrame([(int(c),) for c in counts], "count int")
    grid = wanted.join(F.broadcast(size)).select("count", "size", F.explode(F.expr("sequence(0, size + count - 1)")).alias("j"))
    hi = ends.select(F.col("place").alias("hp"), F.col("prefix").alias("h"))
    lo = ends.select(F.col("place").alias("lp"), F.col("prefix").alias("l"))
    at = grid.join(hi, F.least(F.col("j") + 1, F.col("size")) == F.col("hp")).join(lo, F.greatest(F.lit(0), F.col("j") - F.col("count") + 1) == F.col("lp"))
    return at.groupBy("count").agg(F.max(F.col("h") - F.col("l")).alias("peak"))


def autocorrelation(df: DataFrame, keys: Sequence[str], lags: int = 10, order: str = "scan", value: str = "y") -> DataFrame:
    """keys, lag, r: autocorrelation of centred values for lags 1 to ``lags``."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    e = df.select(*keys, order, (F.col(value) - F.avg(value).over(whole)).alias("e"))
    shifted = e.select(*keys, "e", *(F.lag("e", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    sums = shifted.groupBy(*keys).agg(F.sum(F.col("e") ** 2).alias("s0"), *(F.sum(F.col("e") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(f"s{k}", "s0").alias("r")) for k in range(1, lags + 1)))
    return sums.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.lag", "p.r")


def presentation_order(df: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """Adds repetition: how often an item was shown before."""
    return df.withColumn("repetition", F.row_number().over(Window.partitionBy(item).orderBy(*order)) - 1)


def circular_shift(onset: Column, by: Column | float, duration: float) -> Column:
    """Onsets moved on a circle of the run's duration."""
    return F.pmod(onset + (by if isinstance(by, Column) else F.lit(by)), F.lit(duration))


def lagged_pattern_correlation(df: DataFrame, run: str, order: str, feature: str, value: str, most: int = 15) -> DataFrame:
    """run, lag, r, pairs: mean over pairs of trials so many places apart of the correlation of their patterns over features."""
    w = Window.partitionBy(run, order)
    c = df.select(run, order, feature, (F.col(value) - F.avg(value).over(w)).alias("v"))
    unit = c.withColumn("v", F.try_divide(F.col("v"), F.sqrt(F.sum(F.col("v") ** 2).over(w))))
    lags = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")
    later = unit.select(run, (F.col(order)).alias("o"), feature, F.col("v").alias("u"), lags).withColumn("o", F.col("o") + F.col("lag"))
    joined = later.withColumnRenamed("o", order).join(unit, [run, order, feature])
    per_pair = joined.groupBy(run, "lag", order).agg(F.sum(F.col("u") * F.col("v")).alias("r"))
    return per_pair.groupBy(run, "lag").agg(F.avg("r").alias("r"), F.count("*").alias("pairs"))


def smallest_step(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Sampling interval: the least time between neighbouring scans."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.select(*keys, (F.col(t) - F.lag(t).over(w)).alias("d")).groupBy(*keys).agg(F.min("d").alias("step"))


def half_width(df: DataFrame, keys: Sequence[str], order: str, value: str, level: float = 0.5) -> DataFrame:
    """Samples of the island at or above a share of the maximum that holds the first maximum."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    top = F.max(value).over(whole)
    rows = df.withColumn("_in", F.col(value) >= F.lit(level) * top).withColumn("_top", F.col(value) == top)
    rows = rows.withColumn("_island", F.sum(F.when(~F.col("_in"), 1).otherwise(0)).over(w))
    inside = rows.where("_in").groupBy(*keys, "_island").agg(F.count("*").alias("width"), F.min(F.when(F.col("_top"), F.col(order))).alias("at"))
    first = Window.partitionBy(*keys).orderBy("at")
    return inside.where("at is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*keys, "width", F.col("at").alias("peak_at"))
