"""Designs, kernels and libraries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ripplemark.operators import diagnostics as D
from ripplemark.operators import responses as R
from ripplemark.operators import windows as W
from ripplemark.plans.kernels import CANONICAL, Library, expanded_library
from ripplemark.queries.base import TRIALS, query, rounded
from ripplemark.sources import tables as T

#: Time is counted in hours here: scans are an hour apart, the kernel lasts 32 of them. 4 samples an hour.
_OVER, _SIZE = 4, 128
_KERNEL = f"""kt AS (SELECT i::INTEGER AS i, i / {_OVER}.0::DOUBLE AS t FROM range({_SIZE}) r(i)),
kv AS (SELECT i, CASE WHEN t > 0 THEN exp(5 * ln(t) - t - lgamma(6)) - exp(15 * ln(t) - t - lgamma(16)) / 6 ELSE 0 END AS v FROM kt),
kp AS (SELECT i, v / max(v) OVER () AS v FROM kv), pre AS (SELECT 0 AS place, 0.0::DOUBLE AS p UNION ALL SELECT i + 1, sum(v) OVER (ORDER BY i) FROM kp)"""


@query("trial_regressors", f"""WITH {TRIALS}, {_KERNEL}, box AS (SELECT run, trial_type, ceil(onset / 3600 * {_OVER} - 1e-9)::INTEGER AS a FROM et),
bx AS (SELECT run, trial_type, a, a + 1 AS b, count(*)::DOUBLE AS w FROM box GROUP BY ALL),
rows AS (SELECT run, trial_type, a, b, w, unnest(range(ceil(a / {_OVER}.0)::INTEGER, least(719, floor((b + {_SIZE}) / {_OVER}.0))::INTEGER + 1))::INTEGER AS scan FROM bx)
SELECT rows.run, rows.scan, rows.trial_type, round(sum(w * (h.p - l.p)), 6) + 0.0 AS x FROM rows
JOIN pre h ON h.place = greatest(0, least({_SIZE}, rows.scan * {_OVER} - a + 1)) JOIN pre l ON l.place = greatest(0, least({_SIZE}, rows.scan * {_OVER} - b + 1)) GROUP BY ALL""")  # fmt: skip
def trial_regressors(spark, d):
    e = T.event_table(spark, d).withColumn("onset", F.col("onset") / 3600)
    return rounded(R.response_rows(e, 1.0, T.HOURS, oversampling=_OVER))


@query("condition_columns", f"""WITH {TRIALS}, {_KERNEL}, box AS (SELECT run, trial_type, ceil(onset / 3600 * {_OVER} - 1e-9)::INTEGER AS a, sum(response_time) AS w FROM et GROUP BY ALL),
rows AS (SELECT run, trial_type, a, w, unnest(range(ceil(a / {_OVER}.0)::INTEGER, least(719, floor((a + 8 + {_SIZE}) / {_OVER}.0))::INTEGER + 1))::INTEGER AS scan FROM box),
j AS (SELECT unnest(range({_SIZE} + 7))::INTEGER AS j), pk AS (SELECT max(h.p - l.p) AS peak FROM j JOIN pre h ON h.place = least(j + 1, {_SIZE}) JOIN pre l ON l.place = greatest(0, j - 7))
SELECT rows.run, rows.scan, rows.trial_type, round(sum(w / peak * (h.p - l.p)), 4) + 0.0 AS x FROM rows, pk
JOIN pre h ON h.place = greatest(0, least({_SIZE}, rows.scan * {_OVER} - a + 1)) JOIN pre l ON l.place = greatest(0, least({_SIZE}, rows.scan * {_OVER} - a - 7)) GROUP BY ALL
HAVING rows.scan <= 719""")  # fmt: skip
def condition_columns(spark, d):
    e = T.event_table(spark, d).withColumn("onset", F.col("onset") / 3600).withColumn("duration", F.lit(2.0 - 1e-7))
    return rounded(R.response_rows(e, 1.0, T.HOURS, oversampling=_OVER, weight=F.col("response_time")).where("true"), 4)


@query("boxcar_peaks", f"""WITH {_KERNEL}, c AS (SELECT unnest([1, 2, 4, 8, 40])::INTEGER AS count), j AS (SELECT count, unnest(range({_SIZE} + count - 1))::INTEGER AS j FROM c)
SELECT j.count, round(max(h.p - l.p), 8) AS peak FROM j JOIN pre h ON h.place = least(j + 1, {_SIZE}) JOIN pre l ON l.place = greatest(0, j - j.count + 1) GROUP BY j.count""")  # fmt: skip
def boxcar_peaks(spark, d):
    from ripplemark.plans.kernels import sampled

    rows = [(i, float(v)) for i, v in enumerate(sampled(CANONICAL, 1.0 / _OVER))]
    return rounded(W.boxcar_peaks(spark.createDataFrame(rows, "sample int, value double"), [1, 2, 4, 8, 40]), 8)


@query("cosine_drift", "SELECT r.run::INTEGER AS run, s.scan::INTEGER AS scan, k::INTEGER AS k, round(sqrt(2.0 / 720) * cos(pi() * (s.scan + 0.5) * k / 720), 8) + 0.0 AS x FROM range(6) r(run), range(720) s(scan), range(1, 6) t(k)")
def cosine_drift(spark, d):
    return rounded(R.cosine_drift(T.scan_grid(spark), T.HOURS, 5), 8)


@query("library_grid", """SELECT a.a::DOUBLE AS response_delay, b.b::DOUBLE AS undershoot_delay, c.c::DOUBLE AS response_dispersion, e.e::DOUBLE AS undershoot_dispersion, r.r::DOUBLE AS ratio, o.o::DOUBLE AS onset, 36.0::DOUBLE AS duration
FROM (SELECT unnest([3, 4.5, 6]) a) a, (SELECT unnest([10, 16]) b) b, (SELECT unnest([0.5, 1, 1.5]) c) c, (SELECT unnest([0.5, 1.5, 2.5]) e) e, (SELECT unnest([2, 4, 6, 8]) r) r, (SELECT unnest([0, 1, 2]) o) o
UNION ALL SELECT 6, 16, 1, 1, 6, 0, 32""")  # fmt: skip
def library_grid(spark, d):
    return expanded_library().frame(spark).select("response_delay", "undershoot_delay", "response_dispersion", "undershoot_dispersion", "ratio", "onset", "duration")


@query("library_bounds", "SELECT 6::BIGINT AS n_delay, 3.0::DOUBLE AS low, 6.0::DOUBLE AS high, 649::BIGINT AS n WHERE false UNION ALL SELECT 3, 3.0, 6.0, 649")
def library_bounds(spark, d):
    f = expanded_library().frame(spark)
    return f.agg(F.count_distinct("response_delay").alias("n_delay"), F.min("response_delay").alias("low"), F.max("response_delay").alias("high"), F.count("*").alias("n"))


def small_library() -> Library:
    """Canonical and four kernels that peak at other times."""
    return Library.of([(a, 16.0, c, 1.0, 6.0, 0.0, 32.0) for a in (4.5, 7.5) for c in (0.8, 1.2)])


_CURVES = """lib AS (SELECT * FROM (VALUES (0, 6.0, 1.0), (1, 4.5, 0.8), (2, 4.5, 1.2), (3, 7.5, 0.8), (4, 7.5, 1.2)) v(id, a, c)), tt AS (SELECT i::INTEGER AS sample, i * 0.1::DOUBLE AS t FROM range(320) r(i)),
raw AS (SELECT id, sample, CASE WHEN t > 0 THEN exp((a / c - 1) * ln(t) - t / c - lgamma(a / c) - a / c * ln(c)) - exp(15 * ln(t) - t - lgamma(16)) / 6 ELSE 0 END AS v FROM lib, tt)"""


@query("curve_corr", f"WITH {_CURVES} SELECT a.id::INTEGER AS a, b.id::INTEGER AS b, round(corr(a.v, b.v), 8) AS r FROM raw a JOIN raw b USING (sample) GROUP BY ALL")
def curve_corr(spark, d):
    return rounded(D.curve_correlations(small_library().frame(spark)), 8)


@query("kernel_lookup", """SELECT vec_id, CASE WHEN label < 5 THEN label END AS kernel, CASE label WHEN 0 THEN 6.0 WHEN 1 THEN 4.5 WHEN 2 THEN 4.5 WHEN 3 THEN 7.5 WHEN 4 THEN 7.5 END::DOUBLE AS response_delay FROM embeddings""")
def kernel_lookup(spark, d):
    picks = T.table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, F.col("label")).alias("kernel"))
    lib = F.broadcast(small_library().frame(spark).select(F.col("hrf_id").alias("kernel"), "response_delay"))
    return picks.join(lib, "kernel", "left").select("vec_id", "kernel", "response_delay")


@query("bound_flags", "SELECT vec_id, coalesce(label IN (1, 2, 3, 4), false) AS at_bound FROM embeddings")
def bound_flags(spark, d):
    flags = small_library().bound_flags()
    rows = F.broadcast(spark.createDataFrame([(i, bool(f.any())) for i, f in enumerate(flags)], "kernel int, at_bound boolean"))
    picks = T.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("kernel"))
    return picks.join(rows, "kernel", "left").select("vec_id", F.coalesce("at_bound", F.lit(False)).alias("at_bound"))


@query("session_reliability", f"""WITH {_CURVES}, cc AS (SELECT a.id AS a, b.id AS b, corr(a.v, b.v) AS r FROM raw a JOIN raw b USING (sample) GROUP BY ALL),
pk AS (SELECT l_suppkey AS feature, l_linenumber AS session, (l_suppkey * 7 + l_linenumber * 3) % 5 AS k FROM lineitem GROUP BY ALL),
bt AS (SELECT x.feature, count(*) AS pairs, avg(r) AS r FROM pk x JOIN pk y ON x.feature = y.feature AND x.session < y.session JOIN cc ON cc.a = x.k AND cc.b = y.k GROUP BY x.feature),
bs AS (SELECT feature, avg(r) AS r0 FROM pk JOIN cc ON cc.a = k AND cc.b = 0 GROUP BY feature) SELECT feature, pairs, round(r, 8) AS r, round(r0, 8) AS canonical_r, round(r - r0, 8) + 0.0 AS delta FROM bt JOIN bs USING (feature)""")  # fmt: skip
def session_reliability(spark, d):
    li = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("feature"), F.col("l_linenumber").alias("session")).distinct()
    picks = li.withColumn("kernel", ((F.col("feature") * 7 + F.col("session") * 3) % 5).cast("int"))
    return rounded(D.session_reliability(picks, D.curve_correlations(small_library().frame(spark)), "session", "feature", "kernel"), 8)


@query("detected_levels", f"WITH {TRIALS}, l AS (SELECT DISTINCT trial_type AS level FROM et) SELECT level, row_number() OVER (ORDER BY level) = 1 AS reference FROM l")
def detected_levels(spark, d):
    from ripplemark.plans.model import Modulator

    levels = [r["level"] for r in T.event_table(spark, d).select(F.col("trial_type").alias("level")).distinct().collect()]  # levels of a category
    m = Modulator("trial_type", kind="categorical").with_levels(levels)
    return spark.createDataFrame([(x, x == m.reference) for x in m.levels or ()], "level string, reference boolean")


@query("motion_squares", f"WITH {TRIALS}, c AS (SELECT run, event_index, response_time AS v, coalesce(response_time - lag(response_time) OVER (PARTITION BY run ORDER BY event_index), 0) AS d FROM et) SELECT run, event_index, round(v, 6) AS v, round(d, 6) + 0.0 AS d, round(v * v, 4) AS v2, round(d * d, 4) AS d2 FROM c")
def motion_squares(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("event_index")
    e = T.event_table(spark, d).select("run", "event_index", F.col("response_time").alias("v"), F.coalesce(F.col("response_time") - F.lag("response_time").over(w), F.lit(0.0)).alias("d"))
    return rounded(rounded(e.withColumn("v2", F.col("v") * F.col("v")).withColumn("d2", F.col("d") * F.col("d")), 6, "v", "d"), 4, "v2", "d2")


