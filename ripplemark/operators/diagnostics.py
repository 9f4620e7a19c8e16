"""Diagnostics of coefficients and kernels: tests, reliability, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.special import t_p
from ripplemark.operators.aggregates import centred, correlation, finite


def one_sample_t(df: DataFrame, feature: str, value: str, with_p: bool = True) -> DataFrame:
    """feature, n, mean, t, df and two-sided p over all runs' finite coefficients; t is null without variance or below 2 values."""
    v = finite(F.col(value))
    s = df.groupBy(feature).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))
    t = F.when((F.col("n") > 1) & (F.col("variance") > 0), F.try_divide(F.col("mean"), F.sqrt(F.col("variance") / F.col("n"))))
    out = s.select(feature, "n", "mean", t.alias("t"), (F.col("n") - 1).alias("df"))
    return out.withColumn("p", t_p(F.col("t"), F.col("df"), 2)) if with_p else out


def even_run_points(df: DataFrame, feature: str, run: str, x: str, y: str) -> DataFrame:
    """feature, run, x, y of even runs, centred within runs, where x is finite and y is finite and above 0."""
    rows = df.where(F.col(run) % 2 == 0).select(feature, run, finite(F.col(x)).alias(x), finite(F.col(y)).alias(y)).where(F.col(x).isNotNull() & (F.col(y) > 0))
    return centred(rows, [feature, run], [x, y])


def kernel_ids(df: DataFrame, kernel: str, size: int) -> DataFrame:
    """The kernel as a whole number within the library, null otherwise."""
    k = F.col(kernel).cast("double")
    ok = (k == F.floor(k)) & (k >= 0) & (k < size)
    return df.withColumn(kernel, F.when(ok, k.cast("int")))


def curve_table(library: DataFrame) -> DataFrame:
    """hrf_id, sample, value with unit norm after centring, from a library's curves; constant curves are left out."""
    long = library.select("hrf_id", F.posexplode("curve").alias("sample", "value"))
    w = Window.partitionBy("hrf_id")
    c = long.withColumn("value", F.col("value") - F.avg("value").over(w))
    n = c.withColumn("norm", F.sqrt(F.sum(F.col("value") ** 2).over(w)))
    return n.where("norm > 0").select("hrf_id", "sample", (F.col("value") / F.col("norm")).alias("value"))


def curve_correlations(library: DataFrame) -> DataFrame:
    """a, b, r of all candidates' curves (a library is a small dimension)."""
    c = curve_table(library)
    a, b = c.select(F.col("hrf_id").alias("a"), "sample", F.col("value").alias("u")), c.select(F.col("hrf_id").alias("b"), "sample", F.col("value").alias("v"))
    return a.join(b, "sample").groupBy("a", "b").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("u") * F.col("v")))).alias("r"))


def session_reliability(picks: DataFrame, curves: DataFrame, session: str, feature: str, kernel: str) -> DataFrame:
    """feature, pairs, r, canonical_r, delta: mean curve correlation over pairs of sessions, and of the picks with the canonical kernel."""
    p = picks.where(F.col(kernel).isNotNull()).select(session, feature, F.col(kernel).alias("k"))
    a, b = p.select(F.col(session).alias("s1"), feature, F.col("k").alias("a")), p.select(F.col(session).alias("s2"), feature, F.col("k").alias("b"))
    c = F.broadcast(curves)
    pairs = a.join(b, feature).where("s1 < s2").join(c, ["a", "b"])
    between = pairs.groupBy(feature).agg(F.count("*").alias("pairs"), F.avg("r").alias("r"))
    base = p.join(F.broadcast(curves.where("b = 0").select(F.col("a").alias("k"), F.col("r").alias("r0"))), "k").groupBy(feature).agg(F.avg("r0").alias("canonical_r"))
    return between.join(base, feature).withColumn("delta", F.col("r") - F.col("canonical_r"))


def split_half(df: DataFrame, keys: Sequence[str], item: str, half: str, value: str) -> DataFrame:
    """Correlation over items of the means of two halves (half: 0 or 1)."""
    means = df.groupBy(*keys, item).agg(F.avg(F.when(F.col(half) == 0, F.col(value))).alias("one"), F.avg(F.when(F.col(half) == 1, F.col(value))).alias("two"))
    return correlation(means, keys, "one", "two")


def threshold_curve(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, n, mean of the values at or above it."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    rows = df.where(F.col(value).isNotNull()).select(value, t).where(F.col(value) >= F.col("threshold"))
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def pattern_distances(means: DataFrame, item: str, feature: str, value: str) -> DataFrame:
    """a, b, distance: 1 - r of the patterns over features of two items (items are few: conditions, not trials)."""
    w = Window.partitionBy(item)
    c = means.select(item, feature, (F.col(value) - F.avg(value).over(w)).alias("v"))
    u = c.select(item, feature, F.try_divide(F.col("v"), F.sqrt(F.sum(F.col("v") ** 2).over(w))).alias("v"))
    a, b = u.select(F.col(item).alias("a"), feature, F.col("v").alias("u")), u.select(F.col(item).alias("b"), feature, F.col("v").alias("w"))
    return a.join(b, feature).where("a < b").groupBy("a", "b").agg((1 - F.sum(F.col("u") * F.col("w"))).alias("distance"))


def paired_equivalence(df: DataFrame, keys: Sequence[str], difference: str, margin: float, alpha: float = 0.05) -> DataFrame:
    """Two one-sided t tests of a paired difference against a margin: mean, p_lower, p_upper, equivalent."""
    s = df.groupBy(*keys).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    lower, upper = F.try_divide(F.col("mean") + margin, se), F.try_divide(margin - F.col("mean"), se)
    out = s.select(*keys, "n", "mean", t_p(lower, F.col("n") - 1).alias("p_lower"), t_p(upper, F.col("n") - 1).alias("p_upper"))
    return out.withColumn("equivalent", F.greatest("p_lower", "p_upper") < alpha)


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, t_critical: float = 1.96) -> DataFrame:
    """keys, n, mean, low, high: mean with an interval of so many standard errors."""
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.lit(t_critical) * F.col("sd") / F.sqrt("n")
    return s.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
