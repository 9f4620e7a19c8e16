"""Canonical tables from parquet: signals in long form and packed, events, trial coefficients.

A signal is (run, scan, feature, y) in long form for SQL operators, or (run, feature, y array by scan) packed for
dense kernels. Times are seconds as double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs into which users or suppliers are dealt, hours of the event history, and its start.
RUNS, HOURS, START = 6, 720, "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since START of a timestamp."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(START).cast("timestamp"))) / F.lit(1_000_000)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, scan, feature, y, x: sum and count of event values by user group, hour and type (present cells only)."""
    e = table(spark, sf_dir, "events")
    cells = e.select(
        (F.col("user_id") % RUNS).cast("int").alias("run"),
        F.floor(seconds(F.col("ts")) / 3600).cast("int").alias("scan"),
        F.col("event_type").alias("feature"),
        "value",
    )
    return cells.groupBy("run", "scan", "feature").agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("x"))


def scan_grid(spark: SparkSession, runs: int = RUNS, scans: int = HOURS) -> DataFrame:
    """run, scan, t: the regular grid; its size is fixed by its arguments."""
    runs_, scans_ = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))), F.explode(F.sequence(F.lit(0), F.lit(scans - 1)))
    return spark.range(1).select(runs_.alias("run")).select("run", scans_.alias("scan")).withColumn("t", F.col("scan") * 3600.0)


def densify(cells: DataFrame, grid: DataFrame, features: DataFrame, fill: float = 0.0) -> DataFrame:
    """Cells on the whole grid, absent ones filled. grid and features are small dimensions (their sizes do not depend on the signal's)."""
    whole = grid.select("run", "scan").join(features.select("feature").distinct(), how="cross")
    return whole.join(cells, ["run", "scan", "feature"], "left").fillna(fill, ["y", "x"])


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, scan, feature, y, x on the dense hour grid."""
    return densify(event_cells(spark, sf_dir), scan_grid(spark), table(spark, sf_dir, "events").select(F.col("event_type").alias("feature")))


def vector_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, scan, feature, y: embeddings as a matrix for each label; a scan is a vector's rank within its label."""
    e = table(spark, sf_dir, "embeddings")
    ranked = e.select(F.col("label").cast("int").alias("run"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("scan"), "embedding")
    return ranked.select("run", "scan", F.posexplode("embedding").alias("feature", "y")).withColumn("y", F.col("y").cast("double"))


def order_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, scan, feature, y, x: weekly turnover and quantity of order lines by supplier group and flags."""
    li = table(spark, sf_dir, "lineitem")
    weeks = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7).cast("int")
    rows = li.select((F.col("l_suppkey") % RUNS).cast("int").alias("run"), weeks.alias("scan"), F.concat("l_returnflag", "l_linestatus").alias("feature"), "l_extendedprice", "l_quantity")
    return rows.groupBy("run", "scan", "feature").agg(F.sum("l_extendedprice").alias("y"), F.sum("l_quantity").alias("x"))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, event_index, onset, duration, trial_type, response_time: events as stimuli, in order of time within a run."""
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % RUNS).cast("int").alias("run"), "event_id", seconds(F.col("ts")).alias("onset"), F.col("event_type").alias("trial_type"), F.col("value").alias("response_time"))
    order = Window.partitionBy("run").orderBy(F.col("onset").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return rows.select("run", (F.row_number().over(order) - 1).alias("event_index"), "event_id", "onset", F.lit(0.0).alias("duration"), "trial_type", "response_time")


def packed(signal: DataFrame, value: str = "y") -> DataFrame:
    """run, feature, y array ordered by scan."""
    pairs = F.array_sort(F.collect_list(F.struct("scan", value)))
    return signal.groupBy("run", "feature").agg(F.transform(pairs, lambda p: p[value]).alias("y"))


def feature_blocks(signal: DataFrame, block_size: int = 4096, most: int | None = None) -> DataFrame:
    """feature, block: features that vary in some run, numbered in order and cut to blocks; most: keep so many (a caller's limit)."""
    varying = signal.groupBy("feature").agg(F.max("y").alias("hi"), F.min("y").alias("lo")).where("hi <> lo").select("feature")
    numbered = varying.withColumn("place", F.row_number().over(Window.orderBy("feature")) - 1)
    if most is not None:
        numbered = numbered.where(F.col("place") < most)
    return numbered.select("feature", F.floor(F.col("place") / block_size).cast("int").alias("block"))
