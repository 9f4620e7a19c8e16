"""Aggregations: sums of squares, sufficient statistics, pooling over runs, summaries.

Undefined results are null. Ratios are pooled as sums over sums, never as means of ratios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def co_moment(p: str, q: str) -> Column:
    """Sum of products about the means, as an aggregate: summed in part on the map side, merged without cancellation, exactly 0 for a constant."""
    both = F.col(p).isNotNull() & F.col(q).isNotNull()
    return (F.var_pop(p) if p == q else F.covar_pop(p, q)) * F.count(F.when(both, 1))


def exact_mean(x: Column) -> Column:
    """The mean as an aggregate that no order of rows and partitions changes: doubles are summed as the decimals that they are written as (to 18 places).

    Equal means are equal doubles, so ties and bounds hold. With a NaN, an infinity or a value from 1e20 on it is Spark's own mean.
    """
    d = x.try_cast("decimal(38,18)")
    return F.when(F.count(d) == F.count(x), F.try_divide(F.try_sum(d), F.count(d)).cast("double")).otherwise(F.avg(x))


def sums_of_squares(df: DataFrame, keys: Sequence[str], observed: str = "y", predicted: str = "fitted") -> DataFrame:
    """keys, sse, sst, n: sst about the mean of the keys' rows, exactly 0 where the observed values are constant."""
    rows = df.select(*keys, (F.col(observed) - F.col(predicted)).alias("e"), F.col(observed).alias("o"))
    sst = F.when(F.max("o") == F.min("o"), 0.0).otherwise(co_moment("o", "o"))
    return rows.groupBy(*keys).agg(F.sum(F.col("e") * F.col("e")).alias("sse"), sst.alias("sst"), F.count("*").alias("n"))


def r_squared(sse: Column, sst: Column) -> Column:
    """1 - sse / sst, null where sst is 0."""
    return F.when(sst > 0, 1 - F.try_divide(sse, sst))


def pooled_r2(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R2 of summed sums of squares."""
    return sums.groupBy(*keys).agg(F.sum("sse").alias("sse"), F.sum("sst").alias("sst")).withColumn("r2", r_squared(F.col("sse"), F.col("sst")))


def centred(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns less their mean within the keys; constants become exactly 0. Rows whose keys are null are left out.

    The means are a row for each key, joined back: what is shuffled for them is that row, and the rows themselves only where
    the means are too many to be broadcast.
    """
    means = df.groupBy(*keys).agg(*(F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(f"__mean_{c}") for c in columns))
    out = df.join(means, list(keys))
    return out.select(*((F.col(c) - F.col(f"__mean_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def sufficient_statistics(df: DataFrame, keys: Sequence[str], regressors: Sequence[str], y: str = "y") -> DataFrame:
    """keys and the sums of products of regressors and signal: a_i_j, b_i, c, n. Additive, so summed in part on the map side."""
    sums = [F.sum(F.col(p) * F.col(q)).alias(f"a_{i}_{j}") for i, p in enumerate(regressors) for j, q in enumerate(regressors) if j >= i]
    sums += [F.sum(F.col(p) * F.col(y)).alias(f"b_{i}") for i, p in enumerate(regressors)]
    return df.groupBy(*keys).agg(*sums, F.sum(F.col(y) * F.col(y)).alias("c"), F.count("*").alias("n"))


def fixed_effects(per_run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean effect over runs, its variance sum(var) / n^2, summed dof, t; null where a run's effect is undefined."""
    undefined = F.count("*") != F.count("effect")
    out = per_run.groupBy(*keys).agg(
        F.when(~undefined, F.avg("effect")).alias("effect"),
        F.when(~undefined, F.sum("variance") / (F.count("*") * F.count("*"))).alias("variance"),
        F.sum("dof").alias("dof"),
        F.count("*").alias("runs"),
    )
    return out.withColumn("t", F.when(F.col("variance") > 0, F.try_divide(F.col("effect"), F.sqrt("variance"))))


def finite_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample variance and median of the finite values."""
    v = finite(F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.median(v).alias("median"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Linear percentiles of the finite values, one column p<share in hundredths> each."""
    v = finite(F.col(value))
    return df.groupBy(*keys).agg(*(F.percentile(v, p).alias(f"p{round(100 * p):02d}") for p in shares))


def top_counts(df: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The most frequent values with their share: a report of so many rows. Ties go to the smaller value."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "count", (F.col("count") / F.col("total")).alias("share")).orderBy(F.desc("count"), F.asc(key)).limit(most)


def flag_share(df: DataFrame, keys: Sequence[str], flag: str, mask: str | None = None) -> DataFrame:
    """Share of flagged rows, of those in the mask if there is one; null if none is."""
    rows = df.where(F.col(mask)) if mask else df
    return rows.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("share"), F.count("*").alias("n"))


def pooled_share(shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of blocks pooled by their sizes."""
    return shares.groupBy(*keys).agg(F.try_divide(F.sum(F.col("share") * F.col("n")), F.sum("n")).alias("share"), F.sum("n").alias("n"))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Pearson's r of jointly finite rows, clipped to [-1, 1]; null below ``least`` rows or without variance."""
    a, b = finite(F.col(x)), finite(F.col(y))
    rows = df.select(*keys, a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null")
    out = rows.groupBy(*keys).agg(co_moment("_a", "_b").alias("ab"), co_moment("_a", "_a").alias("aa"), co_moment("_b", "_b").alias("bb"), F.count("*").alias("n"))
    r = F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))
    return out.select(*keys, F.when((F.col("n") >= least) & (F.col("aa") > 0) & (F.col("bb") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"), "n")


def within_run_correlation(df: DataFrame, feature: str, run: str, x: str, y: str) -> DataFrame:
    """feature, scope, r, n: correlation of values centred within runs, for each run, all, odd and even runs.

    A pair counts if both are finite and y is above 0. Needs 3 pairs and variance; pooled scopes also a sum over runs of
    (pairs - 1) of 2 at least.
    """
    ok = df.select(feature, run, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y")).where("_x is not null and _y > 0")
    moments = ok.groupBy(feature, run).agg(co_moment("_x", "_y").alias("xy"), co_moment("_x", "_x").alias("xx"), co_moment("_y", "_y").alias("yy"), F.count("*").alias("n"))
    scopes = F.array(F.concat(F.lit("run-"), F.lpad(F.col(run).cast("string"), 2, "0")), F.lit("all"), F.when(F.col(run) % 2 == 0, "even").otherwise("odd"))
    pooled = moments.withColumn("scope", F.explode(scopes)).groupBy(feature, "scope").agg(*(F.sum(k).alias(k) for k in ("xy", "xx", "yy", "n")), F.count("*").alias("runs"))
    r = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    single = F.col("scope").startswith("run-")
    allowed = (F.col("n") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0) & (single | (F.col("n") - F.col("runs") >= 2))
    return pooled.select(feature, "scope", F.when(allowed, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"), "n")


def standard_errors(df: DataFrame, keys: Sequence[str], value: str, hit: str) -> DataFrame:
    """Mean with its Monte-Carlo error sd / sqrt(n), and rate with sqrt(p (1 - p) / n)."""
    n, rate = F.count(value), F.avg(F.col(hit).cast("double"))
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("mean_error"), rate.alias("rate"), F.sqrt(rate * (1 - rate) / n).alias("rate_error"))


def level_counts(df: DataFrame, keys: Sequence[str], level: str, levels: Sequence[str]) -> DataFrame:
    """A count column for each level."""
    counts = df.groupBy(*keys).pivot(level, list(levels)).count()
    return counts.select(*keys, *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in levels))
