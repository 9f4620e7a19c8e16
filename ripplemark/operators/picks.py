"""Choices of the best candidate; every rule has its own way with ties.

Scores that are null do not compete. Ids break ties as each rule says.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = sys.float_info.epsilon


def best_candidate(scores: DataFrame, keys: Sequence[str], candidate: str, score: str) -> DataFrame:
    """keys, candidate, score: the highest score; those within 64 eps * max(1, |best|) of it tie, the lowest id wins."""
    w = Window.partitionBy(*keys)
    rows = scores.where(F.col(score).isNotNull()).withColumn("_best", F.max(score).over(w))
    close = rows.where(F.col(score) >= F.col("_best") - 64 * EPS * F.greatest(F.lit(1.0), F.abs("_best")))
    return close.groupBy(*keys).agg(F.min(F.struct(candidate, score)).alias("_p")).select(*keys, f"_p.{candidate}", f"_p.{score}")


def best_fraction(scores: DataFrame, keys: Sequence[str], fraction: str, score: str, tolerance: float = 1e-12) -> DataFrame:
    """keys, fraction, score: the highest score; ties within the tolerance go to the largest fraction."""
    w = Window.partitionBy(*keys)
    rows = scores.where(F.col(score).isNotNull()).withColumn("_best", F.max(score).over(w))
    close = rows.where(F.col(score) >= F.col("_best") - tolerance)
    return close.groupBy(*keys).agg(F.max(F.struct(fraction, score)).alias("_p")).select(*keys, f"_p.{fraction}", f"_p.{score}")


def scored_everywhere(scores: DataFrame, feature: str, score: str) -> DataFrame:
    """Features whose score is finite for all candidates."""
    return scores.groupBy(feature).agg(F.count("*").alias("all"), F.count(F.col(score)).alias("known")).where(F.col("all") == F.col("known")).select(feature)


def best_penalty(scores: DataFrame, feature: str, penalty: str, score: str, share: float = 0.9, tolerance: float = 1e-12) -> DataFrame:
    """penalty, objective, at_boundary: the penalty with the highest percentile of scores over all features scored everywhere; ties go to the smallest."""
    usable = scores.join(scored_everywhere(scores, feature, score), feature, "left_semi")
    curve = usable.groupBy(penalty).agg(F.percentile(score, share).alias("objective"))
    ends = curve.agg(F.max("objective").alias("top"), F.min(penalty).alias("lo"), F.max(penalty).alias("hi"))
    close = curve.join(F.broadcast(ends)).where(F.col("objective") >= F.col("top") - tolerance)
    best = close.groupBy("lo", "hi").agg(F.min(F.struct(penalty, "objective")).alias("_p"))
    at = F.col(f"_p.{penalty}")
    return best.select(at.alias(penalty), F.col("_p.objective").alias("objective"), ((F.col("lo") < F.col("hi")) & ((at == F.col("lo")) | (at == F.col("hi")))).alias("at_boundary"))


def two_best(scores: DataFrame, keys: Sequence[str], candidate: str, criterion: str) -> DataFrame:
    """keys, candidate, criterion, runner_up, gap: least criterion, exact ties to the lowest id; gap to the next one (null if none)."""
    w = Window.partitionBy(*keys).orderBy(criterion, candidate)
    rows = scores.where(F.col(criterion).isNotNull()).select(*keys, candidate, criterion, F.row_number().over(w).alias("_k"), F.lead(criterion).over(w).alias("_next"), F.lead(candidate).over(w).alias("runner_up"))
    return rows.where("_k = 1").select(*keys, candidate, criterion, "runner_up", (F.col("_next") - F.col(criterion)).alias("gap"))


def first_good_enough(curve: DataFrame, keys: Sequence[str], count: str, score: str, factor: float = 1.05) -> DataFrame:
    """keys, count: walks the counts upwards with gains over count 0, and stops where the best gain so far times the factor
    reaches the highest one (less 64 eps); the count that holds the best gain by then is chosen, 0 if no gain is above 0.

    Null scores are skipped. A group without a score at count 0 gives no row.
    """
    base = curve.where((F.col(count) == 0) & F.col(score).isNotNull()).select(*keys, F.col(score).alias("_base"))
    rows = curve.where(F.col(score).isNotNull()).join(base, list(keys)).withColumn("_gain", F.col(score) - F.col("_base"))
    walk, whole = Window.partitionBy(*keys).orderBy(count), Window.partitionBy(*keys)
    rows = rows.withColumn("_best", F.max("_gain").over(walk)).withColumn("_top", F.max("_gain").over(whole))
    enough = F.col("_best") * factor >= F.col("_top") - 64 * EPS * F.greatest(F.lit(1.0), F.abs("_top"))
    rows = rows.withColumn("_stop", F.min(F.when(enough, F.col(count))).over(whole))
    rows = rows.withColumn("_held", F.max(F.when(F.col(count) == F.col("_stop"), F.col("_best"))).over(whole))
    chosen = F.min(F.when(F.col("_gain") == F.col("_held"), F.col(count)))
    return rows.groupBy(*keys).agg(F.when(F.max("_top") <= 0, F.lit(0)).otherwise(chosen).alias(count))


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each group at even steps of its ranked list, both ends included."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    rows = df.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    step = F.when(F.col("_n") <= most, F.lit(1.0)).otherwise((F.col("_n") - 1) / F.lit(float(max(1, most - 1))))
    slot = F.floor(F.col("_k") / step + 0.5)
    return rows.where(F.col("_k") == F.floor(slot * step + 0.5)).drop("_k", "_n")


def strongest(df: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """keys, item, value: the largest absolute value; ties to the smallest item."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), item)
    return df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*keys, item, value)
