"""Least squares of at most two regressors as aggregations: sums of products, then closed forms in columns.

Signals may be of any length and number; nothing is gathered. For more regressors see ``dense``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.operators.aggregates import co_moment, r_squared


def centred_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, n, s_<p>_<q>: sums of products of columns centred within the keys (an intercept projected out)."""
    products = [co_moment(p, q).alias(f"s_{p}_{q}") for i, p in enumerate(columns) for q in columns[i:]]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *products)


def ols_one(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, effect, variance, t, dof, sse, sst, r2 of y on x and an intercept; null where x or y is constant."""
    s = centred_sums(df, keys, [x, y])
    xx, xy, yy = F.col(f"s_{x}_{x}"), F.col(f"s_{x}_{y}"), F.col(f"s_{y}_{y}")
    effect = F.when((xx > 0) & (yy > 0), F.try_divide(xy, xx))
    sse = F.greatest(F.lit(0.0), yy - F.coalesce(F.try_divide(xy * xy, xx), F.lit(0.0)))
    dof = F.col("n") - 2
    variance = F.when(dof > 0, F.try_divide(F.try_divide(sse, dof), xx))
    out = s.select(*keys, effect.alias("effect"), F.when(effect.isNotNull(), variance).alias("variance"), dof.alias("dof"), sse.alias("sse"), yy.alias("sst"))
    return out.withColumn("t", F.when(F.col("variance") > 0, F.try_divide(F.col("effect"), F.sqrt("variance")))).withColumn("r2", r_squared(F.col("sse"), F.col("sst")))


def _fitted_two(s: DataFrame, x: str, z: str, y: str) -> tuple[Column, Column, Column]:
    """Coefficients of x and z by Cramer's rule (null if singular), and the fitted sum of squares."""
    xx, xz, zz = F.col(f"s_{x}_{x}"), F.col(f"s_{x}_{z}"), F.col(f"s_{z}_{z}")
    xy, zy = F.col(f"s_{x}_{y}"), F.col(f"s_{z}_{y}")
    det = xx * zz - xz * xz
    ok = det > 1e-12 * xx * zz
    bx = F.when(ok, F.try_divide(xy * zz - zy * xz, det))
    bz = F.when(ok, F.try_divide(zy * xx - xy * xz, det))
    return bx, bz, bx * xy + bz * zy


def ols_two(df: DataFrame, keys: Sequence[str], x: str = "x", z: str = "z", y: str = "y") -> DataFrame:
    """keys, effect_x, effect_z, variance_x, variance_z, dof, sse, sst of y on x, z and an intercept."""
    s = centred_sums(df, keys, [x, z, y])
    bx, bz, fitted = _fitted_two(s, x, z, y)
    xx, xz, zz = F.col(f"s_{x}_{x}"), F.col(f"s_{x}_{z}"), F.col(f"s_{z}_{z}")
    yy = F.col(f"s_{y}_{y}")
    sse = F.greatest(F.lit(0.0), yy - fitted)
    dof = F.col("n") - 3
    scale = F.try_divide(sse, dof)
    det = xx * zz - xz * xz
    return s.select(
        *keys, bx.alias("effect_x"), bz.alias("effect_z"), F.when(dof > 0, F.try_divide(scale * zz, det)).alias("variance_x"),
        F.when(dof > 0, F.try_divide(scale * xx, det)).alias("variance_z"), dof.alias("dof"), sse.alias("sse"), yy.alias("sst"),
    )


def delta_r2(df: DataFrame, feature: str, run: str, x: str, nuisance: str, y: str) -> DataFrame:
    """feature, full_r2, nuisance_r2, delta_r2: pooled over runs; the gain of x beyond the nuisance and an intercept, not below 0."""
    s = centred_sums(df, [feature, run], [x, nuisance, y])
    _, _, fitted = _fitted_two(s, x, nuisance, y)
    zz, zy, yy = F.col(f"s_{nuisance}_{nuisance}"), F.col(f"s_{nuisance}_{y}"), F.col(f"s_{y}_{y}")
    by_run = s.select(feature, F.greatest(F.lit(0.0), yy - F.try_divide(zy * zy, zz)).alias("null"), F.greatest(F.lit(0.0), yy - fitted).alias("full"), yy.alias("sst"))
    sums = by_run.groupBy(feature).agg(F.sum("full").alias("full"), F.sum("null").alias("null"), F.sum("sst").alias("sst"))
    out = sums.select(feature, r_squared(F.col("full"), F.col("sst")).alias("full_r2"), r_squared(F.col("null"), F.col("sst")).alias("nuisance_r2"))
    return out.withColumn("delta_r2", F.greatest(F.lit(0.0), F.col("full_r2") - F.col("nuisance_r2")))


def candidate_statistics(signal: DataFrame, regressors: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """run, candidate, feature, a, b, c: sums of products with an intercept projected out.

    signal: run, scan, feature, y, with all scans of a run; regressors: run, scan, candidate, x. The regressors are a design, which does not grow with the features.
    """
    a = regressors.groupBy("run", "candidate").agg(co_moment(x, x).alias("a"))
    c = signal.groupBy("run", "feature").agg(co_moment(y, y).alias("c"))
    rows = signal.select("run", "scan", "feature", y).join(regressors.select("run", "scan", "candidate", x), ["run", "scan"])
    b = rows.groupBy("run", "candidate", "feature").agg(co_moment(x, y).alias("b"))
    return b.join(a, ["run", "candidate"]).join(c, ["run", "feature"]).select("run", "candidate", "feature", "a", "b", "c")


def leave_one_run_out(stats: DataFrame) -> DataFrame:
    """candidate, feature, score: 1 - sum(loss) / sum(energy), the amplitude of each run from the sums of the others.

    Sums over the other runs are made from them (never a total less one run, which cancels). A candidate that is flat in a run or in the
    others of one is not eligible: its score is null.
    """
    other = stats.select(F.col("run").alias("other"), "candidate", "feature", F.col("a").alias("oa"), F.col("b").alias("ob"))
    sums = stats.join(other, ["candidate", "feature"]).where(F.col("other") != F.col("run"))
    sums = sums.groupBy("candidate", "feature", "run").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"), F.sum("oa").alias("oa"), F.sum("ob").alias("ob"))
    beta = F.try_divide("ob", "oa")
    loss = F.greatest(F.lit(0.0), F.col("c") - 2 * beta * F.col("b") + beta * beta * F.col("a"))
    flat = F.max(F.when((F.col("a") <= 0) | (F.col("oa") <= 0), 1).otherwise(0))
    out = sums.withColumn("loss", loss).groupBy("candidate", "feature").agg(F.sum("loss").alias("loss"), F.sum("c").alias("energy"), flat.alias("flat"))
    return out.select("candidate", "feature", F.when((F.col("flat") == 0) & (F.col("energy") > 0), 1 - F.try_divide("loss", "energy")).alias("score"))


def split_scores(stats: DataFrame, train: Column, test: Column) -> DataFrame:
    """candidate, feature, score on test runs with the amplitude of the training runs."""
    fitted = stats.where(train).groupBy("candidate", "feature").agg(F.try_divide(F.sum("b"), F.sum("a")).alias("beta"))
    rows = stats.where(test).join(fitted, ["candidate", "feature"])
    loss = F.greatest(F.lit(0.0), F.col("c") - 2 * F.col("beta") * F.col("b") + F.col("beta") * F.col("beta") * F.col("a"))
    out = rows.groupBy("candidate", "feature").agg(F.sum(loss).alias("loss"), F.sum("c").alias("energy"))
    return out.select("candidate", "feature", F.when(F.col("energy") > 0, 1 - F.try_divide("loss", "energy")).alias("score"))
