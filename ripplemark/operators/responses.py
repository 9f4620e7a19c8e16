"""Event responses as joins: index arithmetic on a kernel's running sums, for event tables of any size.

A box of samples [a, b) convolved with a kernel is a difference of running sums at two samples. A scan lies between two samples, so an event needs
four lookups for each scan that its response reaches, and only those scans are made.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.plans.design import box_peak
from ripplemark.plans.kernels import CANONICAL, sampled


def running_sums(parameters=CANONICAL, step: float = 0.02) -> list[float]:
    """0 and the running sums of a peak-one kernel: a constant of the plan."""
    return [0.0, *np.cumsum(sampled(parameters, step)).tolist()]


def response_rows(events: DataFrame, dt: float, scans: int, parameters=CANONICAL, oversampling: int = 50, weight: Column | None = None) -> DataFrame:
    """run, scan, trial_type, x: summed unit-peak responses of events (run, onset, duration, trial_type) on the regular grid scan * dt.

    The grid's samples are dt / oversampling apart, sample 0 at time 0. An event takes samples [ceil(onset), ceil(onset + duration)), one at least.
    """
    step = dt / oversampling
    prefix = running_sums(parameters, step)
    size = len(prefix) - 1
    sums = F.array(*(F.lit(v) for v in prefix))
    spark = events.sparkSession
    table = F.broadcast(spark.range(1).select(sums.alias("p")))
    start = F.ceil(F.col("onset") / step - 1e-9).cast("int")
    stop = F.greatest(F.ceil((F.col("onset") + F.col("duration")) / step - 1e-9).cast("int"), start + 1)
    boxes = events.select("run", "trial_type", start.alias("a"), stop.alias("b"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    # events with the same box of the same kind add up before anything is joined
    boxes = boxes.groupBy("run", "trial_type", "a", "b").agg(F.sum("w").alias("w"))
    peaks = _peaks(spark, prefix, boxes)
    boxes = boxes.join(F.broadcast(peaks), F.col("b") - F.col("a") == F.col("count")).withColumn("w", F.col("w") / F.col("peak"))
    lo = F.greatest(F.lit(0), F.ceil(F.col("a") / oversampling)).cast("int")
    hi = F.least(F.lit(scans - 1), F.floor((F.col("b") + size) / oversampling)).cast("int")
    rows = boxes.where(lo <= hi).select("run", "trial_type", "a", "b", "w", F.explode(F.sequence(lo, hi)).alias("scan"))

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(size), x))

    at = F.col("scan") * oversampling
    rows = rows.join(table)
    value = F.col("p")[clip(at - F.col("a") + 1)] - F.col("p")[clip(at - F.col("b") + 1)]
    return rows.groupBy("run", "scan", "trial_type").agg(F.sum(F.col("w") * value).alias("x"))


def _peaks(spark: SparkSession, prefix: list[float], boxes: DataFrame) -> DataFrame:
    """count, peak for each length of a box; lengths beyond the kernel's share its last peak, so there are few."""
    size = len(prefix) - 1
    lengths = boxes.select(F.least(F.col("b") - F.col("a"), F.lit(size)).alias("c")).distinct().collect()  # at most the kernel's samples
    p = np.array(prefix)
    known = spark.createDataFrame([(int(r["c"]), box_peak(p, int(r["c"]))) for r in lengths] or [(1, box_peak(p, 1))], "c int, peak double")
    return boxes.select((F.col("b") - F.col("a")).alias("count")).distinct().join(F.broadcast(known), F.least("count", F.lit(size)) == F.col("c")).select("count", "peak")


def cosine_drift(grid: DataFrame, runs_scans: int, count: int) -> DataFrame:
    """run, scan, k, x: slow cosines of unit norm."""
    k = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k")
    rows = grid.select("run", "scan", k)
    return rows.withColumn("x", F.lit(math.sqrt(2 / runs_scans)) * F.cos(F.lit(math.pi) * (F.col("scan") + 0.5) * F.col("k") / runs_scans))
