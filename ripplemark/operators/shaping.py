"""Filters, lookups and reshapes of event and signal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modelled_events(events: DataFrame, starts: DataFrame, min_onset: float) -> DataFrame:
    """Events from min_onset before their run's first scan on. starts: run, t0."""
    return events.join(F.broadcast(starts), "run").where(F.col("onset") >= F.col("t0") + min_onset).drop("t0")


def modelled_counts(events: DataFrame, starts: DataFrame, min_onset: float) -> DataFrame:
    """run, cutoff, kept, excluded."""
    late = F.col("onset") >= F.col("t0") + min_onset
    rows = events.join(F.broadcast(starts), "run")
    return rows.groupBy("run").agg(F.first(F.col("t0") + min_onset).alias("cutoff"), F.count_if(late).alias("kept"), F.count_if(~late).alias("excluded"))


def onset_faults(events: DataFrame, spans: DataFrame, min_onset: float = -24.0) -> DataFrame:
    """run, early, late, bad_duration: counts of events without support. spans: run, t0, t1."""
    rows = events.join(F.broadcast(spans), "run")
    finite = F.col("onset").isNotNull() & ~F.isnan("onset")
    return rows.groupBy("run").agg(
        F.count_if(~finite | (F.col("onset") < F.col("t0") + min_onset)).alias("early"),
        F.count_if(finite & (F.col("onset") >= F.col("t1"))).alias("late"),
        F.count_if(F.col("duration").isNull() | F.isnan("duration") | (F.col("duration") < 0)).alias("bad_duration"),
    )


def numeric_or_null(column: Column) -> Column:
    """A number from text; null if it is none or not finite."""
    x = column.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def best_ranked(df: DataFrame, keys: Sequence[str], value: str, name: str, most: int) -> DataFrame:
    """The rows with the highest values of each group, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), name)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def leading_flags(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Adds leading: whether a scan is in the run of flagged scans at the start of its keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("leading", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w) == 0)


def pool_masks(stat: DataFrame, feature: str, value: str, pool_at_most: float, scoring_above: float, fallback: int = 100) -> DataFrame:
    """feature, pool, scoring: low values make the pool; high ones are scored, or the best ``fallback`` if fewer are high."""
    high = stat.agg(F.count_if(F.col(value) > scoring_above).alias("n"))
    best = stat.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), feature).limit(fallback).select(feature, F.lit(True).alias("best"))
    rows = stat.join(F.broadcast(high)).join(F.broadcast(best), feature, "left")
    scoring = F.when(F.col("n") >= fallback, F.coalesce(F.col(value) > scoring_above, F.lit(False))).otherwise(F.coalesce("best", F.lit(False)))
    return rows.select(feature, F.coalesce(F.col(value) <= pool_at_most, F.lit(False)).alias("pool"), scoring.alias("scoring"))


def box_cover(events: DataFrame, step: float, samples: int) -> DataFrame:
    """run, sample, n: events whose [onset, onset + duration) holds the sample at sample * step; an event of no length holds its next one.

    Sample ranges come from index arithmetic, so no range join is made.
    """
    first = F.ceil(F.col("onset") / step)
    last = F.greatest(F.ceil((F.col("onset") + F.col("duration")) / step) - 1, first)
    rows = events.select("run", F.greatest(first, F.lit(0)).alias("a"), F.least(last, F.lit(samples - 1)).alias("b")).where("a <= b")
    return rows.select("run", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("sample")).groupBy("run", "sample").agg(F.count("*").alias("n"))


def interpolate(points: DataFrame, keys: Sequence[str], grid: DataFrame, step: float, t: str = "t", sample: str = "sample", value: str = "value") -> DataFrame:
    """points with the grid's value at their time, linear between samples; null outside. grid: keys, sample, value."""
    at = points.withColumn("_lo", F.floor(F.col(t) / step).cast("int")).withColumn("_f", F.col(t) / step - F.col("_lo"))
    lo = grid.select(*keys, F.col(sample).alias("_lo"), F.col(value).alias("_a"))
    hi = grid.select(*keys, (F.col(sample) - 1).alias("_lo"), F.col(value).alias("_b"))
    joined = at.join(lo, [*keys, "_lo"], "left").join(hi, [*keys, "_lo"], "left")
    mixed = F.when(F.col("_f") == 0, F.col("_a")).otherwise((1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b"))
    return joined.withColumn(value, mixed).drop("_lo", "_f", "_a", "_b")


def scatter(values: DataFrame, axis: DataFrame, feature: str) -> DataFrame:
    """Values on a whole axis; absent ones are null."""
    return axis.select(feature).join(values, feature, "left")


def session_pairs(df: DataFrame, session: str) -> DataFrame:
    """a, b: unordered pairs of sessions (a dimension, not the data)."""
    s = df.select(session).distinct()
    a, b = s.select(F.col(session).alias("a")), s.select(F.col(session).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def paired_summary(one: DataFrame, two: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean_one, mean_two, mean_difference over keys that are finite in both."""
    a = one.select(*keys, F.col(value).alias("_a"))
    b = two.select(*keys, F.col(value).alias("_b"))
    rows = a.join(b, list(keys)).where("_a is not null and _b is not null and not isnan(_a) and not isnan(_b)")
    return rows.agg(F.count("*").alias("n"), F.avg("_a").alias("mean_one"), F.avg("_b").alias("mean_two"), F.avg(F.col("_b") - F.col("_a")).alias("mean_difference"))


def absent_levels(df: DataFrame, run: str, level: str) -> DataFrame:
    """run, level: levels that a run lacks."""
    have = df.select(run, level).distinct()
    return have.select(run).distinct().join(have.select(level).distinct(), how="cross").join(have, [run, level], "left_anti")


def valid_in_all(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Items with a value in every group."""
    groups = df.select(group).distinct().agg(F.count("*").alias("all"))
    ok = df.where(F.col(value).isNotNull()).groupBy(item).agg(F.count_distinct(group).alias("n"))
    return ok.join(F.broadcast(groups)).where(F.col("n") == F.col("all")).select(item)


def expand_regressors(events: DataFrame, amplitudes: Sequence[tuple[str, Column]]) -> DataFrame:
    """run, event_index, onset, duration, regressor, place, modulation: a row for each regressor in model order."""
    parts = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("regressor"), a.cast("double").alias("modulation")) for i, (n, a) in enumerate(amplitudes)))
    return events.select("run", "event_index", "onset", "duration", F.explode(parts).alias("p")).select("run", "event_index", "onset", "duration", "p.regressor", "p.place", "p.modulation")


def trial_ids(events: DataFrame) -> DataFrame:
    """Adds trial_index over all runs (a null run goes last) and trial_id like run-01_trial-0007; longer numbers stay whole."""

    def digits(x: Column, least: int) -> Column:
        text = x.cast("string")
        return F.lpad(text, F.greatest(F.length(text), F.lit(least)), F.lit("0"))

    counts = events.groupBy(F.col("run").alias("_run")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("_run").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("first", F.sum("n").over(order)).select("_run", F.coalesce("first", F.lit(0)).alias("first"))
    named = F.concat(F.lit("run-"), digits(F.col("run") + 1, 2), F.lit("_trial-"), digits(F.col("event_index"), 4))
    rows = events.join(F.broadcast(before), F.col("run").eqNullSafe(F.col("_run")))
    return rows.withColumn("trial_index", F.col("first") + F.col("event_index")).withColumn("trial_id", named).drop("first", "_run")


def repetitions(df: DataFrame, item: str, order: Sequence[str], least: int) -> DataFrame:
    """Rows of items that occur ``least`` times at least, their first so many, with repetition."""
    w = Window.partitionBy(item).orderBy(*order)
    rows = df.withColumn("repetition", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(item)))
    return rows.where((F.col("_n") >= least) & (F.col("repetition") < least)).drop("_n")


def is_subset(one: Column, two: Column) -> Column:
    return F.size(F.array_except(one, two)) == 0


def event_classes(events: DataFrame) -> DataFrame:
    """Adds class: missing (no response time), incorrect (refund) or valid."""
    x = F.col("response_time")
    return events.withColumn("class", F.when(x.isNull() | F.isnan(x) | (x <= 0), "missing").when(F.col("trial_type") == "refund", "incorrect").otherwise("valid"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: counts in even bins; 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def identical_features(signal: DataFrame) -> DataFrame:
    """run, missing: features of any run that a run lacks; a signal is sound if all are 0."""
    have = signal.select("run", "feature").distinct()
    total = have.agg(F.count_distinct("feature").alias("all"))
    return have.groupBy("run").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("run", (F.col("all") - F.col("n")).alias("missing"))
