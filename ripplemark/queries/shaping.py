"""Filters, lookups, reshapes, scalar functions and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.functions import scalars as C
from ripplemark.operators import aggregates as A
from ripplemark.operators import diagnostics as D
from ripplemark.operators import shaping as S
from ripplemark.queries.base import CELLS, ORDERS, SIGNAL, TRIALS, VECTORS, query, rounded
from ripplemark.sources import tables as T

# -- filters and checks --

_STARTS = "st AS (SELECT run, (172800.0 + 3600.0 * run)::DOUBLE AS t0 FROM (SELECT DISTINCT run FROM et))"


def _starts(e):
    return e.select("run").distinct().select("run", (172800.0 + 3600.0 * F.col("run")).alias("t0"))


@query("event_filter", f"WITH {TRIALS}, {_STARTS} SELECT et.event_id, et.run, round(et.onset, 6) AS onset FROM et JOIN st USING (run) WHERE onset >= t0 - 24")
def event_filter(spark, d):
    e = T.event_table(spark, d)
    return rounded(S.modelled_events(e, _starts(e), -24.0).select("event_id", "run", "onset"), 6)


@query("event_filter_counts", f"WITH {TRIALS}, {_STARTS} SELECT run, any_value(t0) - 24 AS cutoff, count(*) FILTER (onset >= t0 - 24) AS kept, count(*) FILTER (onset < t0 - 24) AS excluded FROM et JOIN st USING (run) GROUP BY run")
def event_filter_counts(spark, d):
    e = T.event_table(spark, d)
    return S.modelled_counts(e, _starts(e), -24.0)


@query("onset_support", f"WITH {TRIALS}, {_STARTS} SELECT run, count(*) FILTER (onset < t0 - 24) AS early, count(*) FILTER (onset >= 2400000.0) AS late, count(*) FILTER (duration < 0) AS bad_duration FROM et JOIN st USING (run) GROUP BY run")
def onset_support(spark, d):
    e = T.event_table(spark, d)
    return S.onset_faults(e, _starts(e).withColumn("t1", F.lit(2400000.0)))


@query("confound_select", "SELECT event_type, count(k) AS n, round(avg(k), 6) AS mean FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type")
def confound_select(spark, d):
    e = T.table(spark, d, "events").select("event_type", S.numeric_or_null(F.get_json_object("props", "$.k")).alias("k"))
    return rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.avg("k").alias("mean")))


@query("acompcor_top6", "SELECT brand, name, place::INTEGER AS place FROM (SELECT p_brand AS brand, p_name AS name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 6")
def acompcor_top6(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_retailprice", "p_partkey", F.col("p_name").alias("name"))
    return S.best_ranked(p, ["brand"], "p_retailprice", "p_partkey", 6).select("brand", "name", "place")


@query("nss_trim", f"WITH {SIGNAL}, f AS (SELECT run, feature, scan, sum((y > 0)::INTEGER) OVER (PARTITION BY run, feature ORDER BY scan) = 0 AS lead FROM signal) SELECT run, feature, count(*) FILTER (lead) AS dropped, count(*) FILTER (NOT lead) AS kept FROM f GROUP BY ALL")
def nss_trim(spark, d):
    s = T.event_signal(spark, d).withColumn("flag", F.col("y") <= 0)
    out = S.leading_flags(s, ["run", "feature"], "scan", "flag")
    return out.groupBy("run", "feature").agg(F.count_if("leading").alias("dropped"), F.count_if(~F.col("leading")).alias("kept"))


@query("rt_censor", f"WITH {TRIALS}, c AS (SELECT run, CASE WHEN response_time - 100 > 0 THEN response_time - 100 END AS rt FROM et) SELECT run, count(rt) AS n, count(*) - count(rt) AS missing, round(avg(rt), 6) AS mean FROM c GROUP BY run")
def rt_censor(spark, d):
    c = T.event_table(spark, d).select("run", C.positive_or_null(F.col("response_time") - 100).alias("rt"))
    return rounded(c.groupBy("run").agg(F.count("rt").alias("n"), (F.count("*") - F.count("rt")).alias("missing"), F.avg("rt").alias("mean")))


@query("run_subset", f"WITH {SIGNAL} SELECT run, feature, round(sum(y), 4) AS total FROM signal WHERE run IN (1, 3) GROUP BY ALL")
def run_subset(spark, d):
    s = T.event_signal(spark, d).where(F.col("run").isin(1, 3))
    return rounded(s.groupBy("run", "feature").agg(F.sum("y").alias("total")), 4)


@query("run_parity", f"WITH {CELLS} SELECT CASE WHEN run % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, count(DISTINCT run) AS runs, count(*) AS cells FROM cells GROUP BY ALL")
def run_parity(spark, d):
    c = T.event_cells(spark, d)
    return c.groupBy(F.when(F.col("run") % 2 == 0, "even").otherwise("odd").alias("parity")).agg(F.count_distinct("run").alias("runs"), F.count("*").alias("cells"))


@query("constant_skip", f"WITH {VECTORS} SELECT run, feature FROM vec GROUP BY ALL HAVING max(y) = min(y)")
def constant_skip(spark, d):
    g = T.vector_signal(spark, d).groupBy("run", "feature").agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    return g.where("hi = lo").select("run", "feature")


@query("feature_set_check", f"WITH {ORDERS}, h AS (SELECT DISTINCT run, feature FROM ord) SELECT run, (SELECT count(DISTINCT feature) FROM h) - count(*) AS missing FROM h GROUP BY run")
def feature_set_check(spark, d):
    return S.identical_features(T.order_signal(spark, d))


@query("discover_runs", "SELECT coalesce(n_nationkey, c_nationkey)::INTEGER AS nation, n_nationkey IS NULL AS extra, c_nationkey IS NULL AS missing FROM nation FULL JOIN (SELECT DISTINCT label AS c_nationkey FROM embeddings) c ON n_nationkey = c_nationkey WHERE n_nationkey IS NULL OR c_nationkey IS NULL")
def discover_runs(spark, d):
    n = T.table(spark, d, "nation").select("n_nationkey")
    c = T.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("c_nationkey")).distinct()
    rows = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "full").where("n_nationkey is null or c_nationkey is null")
    return rows.select(F.coalesce("n_nationkey", "c_nationkey").cast("int").alias("nation"), F.col("n_nationkey").isNull().alias("extra"), F.col("c_nationkey").isNull().alias("missing"))


# -- joins --


@query("row_alignment", f"WITH {SIGNAL}, d AS (SELECT run, scan, sum(x) AS design FROM signal GROUP BY ALL) SELECT feature, count(*) AS n, round(sum(y * design), 2) AS product FROM signal JOIN d USING (run, scan) GROUP BY feature")
def row_alignment(spark, d):
    s = T.event_signal(spark, d)
    design = s.groupBy("run", "scan").agg(F.sum("x").alias("design"))
    return rounded(s.join(design, ["run", "scan"]).groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("design")).alias("product")), 2)


@query("boxcar_join", f"""WITH {TRIALS}, g AS (SELECT unnest(range(720))::INTEGER AS sample)
SELECT run, sample, count(*) AS n FROM et JOIN g ON sample * 3600.0 >= onset AND sample * 3600.0 < onset + 10800.0 GROUP BY ALL""")  # fmt: skip
def boxcar_join(spark, d):
    return S.box_cover(T.event_table(spark, d).withColumn("duration", F.lit(10800.0)), 3600.0, 720)


@query("interp_asof", f"""WITH {CELLS}, {TRIALS}, h AS (SELECT run, scan, sum(y) AS v FROM cells GROUP BY ALL), g AS (SELECT r.run::INTEGER AS run, s.scan::INTEGER AS scan FROM range(6) r(run), range(720) s(scan)),
f AS (SELECT g.run, g.scan, coalesce(v, 0) AS v FROM g LEFT JOIN h ON h.run = g.run AND h.scan = g.scan), p AS (SELECT event_id, run, floor(onset / 3600)::INTEGER AS lo, onset / 3600 - floor(onset / 3600) AS fr FROM et)
SELECT event_id, round((1 - fr) * a.v + fr * b.v, 6) AS value FROM p JOIN f a ON a.run = p.run AND a.scan = lo LEFT JOIN f b ON b.run = p.run AND b.scan = lo + 1""")  # fmt: skip
def interp_asof(spark, d):
    grid = T.event_signal(spark, d).groupBy("run", F.col("scan").alias("sample")).agg(F.sum("y").alias("value"))
    points = T.event_table(spark, d).select("event_id", "run", F.col("onset").alias("t"))
    return rounded(S.interpolate(points, ["run"], grid, 3600.0).select("event_id", "value"))


@query("scatter_axis", f"WITH {VECTORS}, m AS (SELECT feature, avg(y) AS mean FROM vec GROUP BY feature) SELECT a.feature, round(m.mean, 8) AS mean FROM (SELECT unnest(range(80))::INTEGER AS feature) a LEFT JOIN m USING (feature)")
def scatter_axis(spark, d):
    means = T.vector_signal(spark, d).groupBy("feature").agg(F.avg("y").alias("mean"))
    return rounded(S.scatter(means, spark.range(80).select(F.col("id").cast("int").alias("feature")), "feature"), 8)


@query("session_pairs", "SELECT a.label AS a, b.label AS b FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label")
def session_pairs(spark, d):
    return S.session_pairs(T.table(spark, d, "embeddings"), "label")


@query("paired_summary", f"""WITH {CELLS}, a AS (SELECT scan, feature, avg(y) AS v FROM cells WHERE run = 0 GROUP BY ALL), b AS (SELECT scan, feature, avg(y) AS v FROM cells WHERE run = 1 GROUP BY ALL)
SELECT count(*) AS n, round(avg(a.v), 6) AS mean_one, round(avg(b.v), 6) AS mean_two, round(avg(b.v - a.v), 6) AS mean_difference FROM a JOIN b USING (scan, feature)""")  # fmt: skip
def paired_summary(spark, d):
    c = T.event_cells(spark, d)
    one, two = (c.where(F.col("run") == r).groupBy("scan", "feature").agg(F.avg("y").alias("v")) for r in (0, 1))
    return rounded(S.paired_summary(one, two, ["scan", "feature"], "v"))


@query("absent_levels", f"WITH {CELLS}, h AS (SELECT DISTINCT scan, feature FROM cells) SELECT s.scan, f.feature FROM (SELECT DISTINCT scan FROM h) s CROSS JOIN (SELECT DISTINCT feature FROM h) f ANTI JOIN h ON h.scan = s.scan AND h.feature = f.feature")
def absent_levels(spark, d):
    return S.absent_levels(T.event_cells(spark, d), "scan", "feature")


@query("valid_in_all", "WITH g AS (SELECT d.lang, d.source, avg(l.quality) AS q FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL) SELECT source FROM g WHERE q IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM g)")
def valid_in_all(spark, d):
    j = T.table(spark, d, "documents").select("doc_id", "lang", "source").join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return S.valid_in_all(j.groupBy("lang", "source").agg(F.avg("quality").alias("q")), "lang", "source", "q")


@query("scoring_space", f"WITH {VECTORS}, r AS (SELECT DISTINCT run FROM vec), f AS (SELECT DISTINCT feature FROM vec) SELECT r.run, k.candidate, count(*) AS features FROM r, (SELECT unnest(range(3))::INTEGER AS candidate) k, f GROUP BY ALL")
def scoring_space(spark, d):
    v = T.vector_signal(spark, d)
    runs, features = v.select("run").distinct(), v.select("feature").distinct()
    kernels = F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("candidate")))
    # the space is a product of dimensions: its size is counted from theirs, without its rows
    return runs.join(kernels, how="cross").join(F.broadcast(features.agg(F.count("*").alias("features"))), how="cross").select("run", "candidate", "features")


# -- reshapes --


@query("modulator_expand", f"""WITH {TRIALS} SELECT run, event_index, round(onset, 6) AS onset, p.regressor, p.place::INTEGER AS place, round(p.modulation, 6) AS modulation FROM (
SELECT *, unnest([{{'place': 0, 'regressor': 'task', 'modulation': 1.0::DOUBLE}}, {{'place': 1, 'regressor': 'response_time', 'modulation': response_time}}, {{'place': 2, 'regressor': 'is_purchase', 'modulation': (trial_type = 'purchase')::INTEGER::DOUBLE}}]) AS p FROM et)""")  # fmt: skip
def modulator_expand(spark, d):
    e = T.event_table(spark, d)
    rows = S.expand_regressors(e, [("task", F.lit(1.0)), ("response_time", F.col("response_time")), ("is_purchase", (F.col("trial_type") == "purchase"))])
    return rounded(rounded(rows.select("run", "event_index", "onset", "regressor", "place", "modulation"), 6, "onset"), 6, "modulation")


@query("trial_table", f"WITH {TRIALS}, k AS (SELECT *, row_number() OVER (ORDER BY run, event_index) - 1 AS trial_index FROM et) SELECT event_id, trial_index, 'run-' || lpad((run + 1)::VARCHAR, 2, '0') || '_trial-' || lpad(event_index::VARCHAR, greatest(4, length(event_index::VARCHAR))::INTEGER, '0') AS trial_id FROM k")
def trial_table(spark, d):
    return S.trial_ids(T.event_table(spark, d)).select("event_id", F.col("trial_index").cast("long").alias("trial_index"), "trial_id")


@query("scatter_blocks", f"WITH {VECTORS} SELECT f.feature, round(CASE WHEN max(v.y) <> min(v.y) THEN avg(v.y) END, 8) AS mean FROM (SELECT unnest(range((SELECT max(feature) + 3 FROM vec)))::INTEGER AS feature) f LEFT JOIN vec v ON v.feature = f.feature GROUP BY f.feature")
def scatter_blocks(spark, d):
    """Means of the features that the blocks hold (constant ones are skipped), on an axis that goes two places beyond the last feature."""
    v = T.vector_signal(spark, d)
    means = v.groupBy("feature").agg(F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo <> hi").select("feature", "mean")
    axis = v.agg(F.max("feature").alias("last")).select(F.explode(F.sequence(F.lit(0), (F.col("last") + 2).cast("int"))).alias("feature"))
    return rounded(S.scatter(means, axis, "feature"), 8)


@query("pivot_scopes", f"WITH {CELLS} SELECT feature, round(sum(y) FILTER (run % 2 = 0), 4) AS even, round(sum(y) FILTER (run % 2 = 1), 4) AS odd FROM cells GROUP BY feature")
def pivot_scopes(spark, d):
    c = T.event_cells(spark, d).withColumn("scope", F.when(F.col("run") % 2 == 0, "even").otherwise("odd"))
    return rounded(c.groupBy("feature").pivot("scope", ["even", "odd"]).agg(F.sum("y")), 4)


@query("unpivot_scopes", f"WITH {CELLS} SELECT feature, unnest(['y', 'x']) AS scope, round(unnest([sum(y), sum(x)]), 4) AS value FROM cells GROUP BY feature")
def unpivot_scopes(spark, d):
    s = T.event_cells(spark, d).groupBy("feature").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))
    return rounded(s.unpivot(["feature"], ["y", "x"], "scope", "value"), 4)


@query("subset_levels", "WITH l AS (SELECT source, list(DISTINCT lang) AS langs FROM documents GROUP BY source), q AS (SELECT list(DISTINCT lang) AS all_ FROM documents) SELECT source, len(list_filter(langs, lambda x: x NOT IN ('en', 'fr', 'de'))) = 0 AS subset FROM l, q")
def subset_levels(spark, d):
    l = T.table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return l.select("source", S.is_subset(F.col("langs"), F.array(F.lit("en"), F.lit("fr"), F.lit("de"))).alias("subset"))


@query("repetition_cube", "WITH k AS (SELECT o_custkey AS item, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS repetition, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT item, o_orderkey, repetition::INTEGER AS repetition FROM k WHERE n >= 3 AND repetition < 3")
def repetition_cube(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("item"), "o_orderkey", "o_orderdate")
    return S.repetitions(o, "item", ["o_orderdate", "o_orderkey"], 3).select("item", "o_orderkey", "repetition")


# -- scalar functions --


@query("category_levels", "SELECT DISTINCT p_size::VARCHAR AS level FROM part UNION SELECT DISTINCT trim(o_orderpriority) FROM orders")
def category_levels(spark, d):
    p = T.table(spark, d, "part").select(C.level_name(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("level"))
    return p.union(T.table(spark, d, "orders").select(C.level_name(F.col("o_orderpriority")))).distinct()


@query("category_indicators", f"WITH {TRIALS} SELECT event_id, (trial_type = 'purchase')::INTEGER::DOUBLE AS \"trial_type[purchase]\", (trial_type = 'view')::INTEGER::DOUBLE AS \"trial_type[view]\" FROM et")
def category_indicators(spark, d):
    return T.event_table(spark, d).select("event_id", *C.indicators(F.col("trial_type"), "trial_type", ["click", "purchase", "view"], "click"))


@query("missing_indicator", "SELECT doc_id, coalesce(l.quality, 0)::DOUBLE AS quality, (l.quality IS NULL)::INTEGER::DOUBLE AS missing_quality FROM documents LEFT JOIN labels l USING (doc_id)")
def missing_indicator(spark, d):
    j = T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", *C.numeric_modulator(F.col("quality"), "quality"))


@query("kernel_curve", """WITH t AS (SELECT i::INTEGER AS sample, i * 0.1::DOUBLE AS t FROM range(320) r(i)),
g AS (SELECT sample, CASE WHEN t > 0 THEN exp(5 * ln(t) - t - lgamma(6)) - exp(15 * ln(t) - t - lgamma(16)) / 6 ELSE 0 END AS v FROM t) SELECT sample, round(v / max(v) OVER (), 8) + 0.0 AS value FROM g""")  # fmt: skip
def kernel_curve(spark, d):
    t = spark.range(320).select(F.col("id").cast("int").alias("sample"), (F.col("id") * 0.1).alias("t"))
    v = t.select("sample", C.double_gamma(F.col("t"), 6.0, 16.0, 1.0, 1.0, 6.0).alias("v"))
    top = v.agg(F.max("v").alias("top"))
    return rounded(v.join(F.broadcast(top)).select("sample", (F.col("v") / F.col("top")).alias("value")), 8)


@query("lobe_timing", "WITH p AS (SELECT p_partkey, 2.0 + p_size / 10.0::DOUBLE AS delay, 0.5 + p_size / 100.0::DOUBLE AS disp FROM part) SELECT p_partkey, round(delay - disp, 8) AS peak, round(sqrt(delay * disp), 8) AS sd, round(delay, 8) AS delay, round(disp, 8) AS dispersion FROM p")
def lobe_timing(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", (2.0 + F.col("p_size") / 10.0).alias("delay"), (0.5 + F.col("p_size") / 100.0).alias("disp"))
    peak, sd = C.lobe_timing(F.col("delay"), F.col("disp"), F.lit(0.0))
    p = p.select("p_partkey", peak.alias("peak"), sd.alias("sd"))
    delay, dispersion = C.lobe_parameters(F.col("peak"), F.col("sd"), F.lit(0.0))
    return rounded(p.select("p_partkey", "peak", "sd", delay.alias("delay"), dispersion.alias("dispersion")), 8)


@query("sample_counts", "SELECT p_partkey, ceil(p_size / 0.1 - 1e-9)::INTEGER AS samples FROM part")
def sample_counts(spark, d):
    return T.table(spark, d, "part").select("p_partkey", C.sample_count(F.col("p_size").cast("double"), 0.1).alias("samples"))


@query("label_check", "SELECT c_custkey, regexp_matches(c_mktsegment, '^[A-Za-z0-9_-]+$') AS ok FROM customer")
def label_check(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").rlike("^[A-Za-z0-9_-]+$").alias("ok"))


@query("component_names", "SELECT i::INTEGER AS i, 'denoise_pc_' || lpad(i::VARCHAR, 3, '0') AS name FROM range(11) r(i)")
def component_names(spark, d):
    i = F.col("id").cast("int")
    return spark.range(11).select(i.alias("i"), F.format_string("denoise_pc_%03d", i).alias("name"))


@query("event_classes", f"WITH {TRIALS} SELECT run, CASE WHEN response_time IS NULL OR response_time <= 0 THEN 'missing' WHEN trial_type = 'refund' THEN 'incorrect' ELSE 'valid' END AS class, count(*) AS n FROM et GROUP BY ALL")
def event_classes(spark, d):
    return S.event_classes(T.event_table(spark, d)).groupBy("run", "class").agg(F.count("*").alias("n"))


@query("histogram_counts", "SELECT least(21, greatest(0, floor(value / 25.0)::INTEGER + 1))::INTEGER AS bin, count(*) AS n FROM events GROUP BY ALL")
def histogram_counts(spark, d):
    return S.histogram(T.table(spark, d, "events"), "value", 0.0, 500.0, 20)


@query("robust_range", """WITH q AS (SELECT event_type, quantile_cont(value, 0.001) AS p01, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.999) AS p999, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
SELECT event_type, round(CASE WHEN lo >= p50 - 1.1 * (p50 - p01) THEN lo ELSE p01 END, 6) AS low, round(CASE WHEN hi <= p50 + 1.1 * (p999 - p50) THEN hi ELSE p999 END, 6) AS high FROM q""")  # fmt: skip
def robust_range(spark, d):
    q = T.table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", [0.001, 0.1, 0.5, 0.9, 0.999]).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    p01, _, p50, _, p999 = (F.col("q")[i] for i in range(5))
    low = F.when(F.col("lo") >= p50 - 1.1 * (p50 - p01), F.col("lo")).otherwise(p01)
    high = F.when(F.col("hi") <= p50 + 1.1 * (p999 - p50), F.col("hi")).otherwise(p999)
    return rounded(q.select("event_type", low.alias("low"), high.alias("high")))


# -- diagnostics --


@query("one_sample_t", f"WITH {VECTORS} SELECT feature, count(y) AS n, round(avg(y), 8) AS mean, round(avg(y) / sqrt(var_samp(y) / count(y)), 6) AS t, count(y) - 1 AS df FROM vec GROUP BY feature")
def one_sample_t(spark, d):
    return rounded(rounded(D.one_sample_t(T.vector_signal(spark, d), "feature", "y", with_p=False), 8, "mean"), 6, "t")


@query("one_sample_p")
def one_sample_p(spark, d):
    return rounded(D.one_sample_t(T.vector_signal(spark, d), "feature", "y"), 8)


@query("even_run_points", f"WITH {VECTORS}, j AS (SELECT feature, run, y AS x, (scan % 7)::DOUBLE + 0.5 AS r FROM vec WHERE run % 2 = 0) SELECT feature, run, round(x - avg(x) OVER w, 8) + 0.0 AS x, round(r - avg(r) OVER w, 8) + 0.0 AS r FROM j WINDOW w AS (PARTITION BY feature, run)")
def even_run_points(spark, d):
    s = T.vector_signal(spark, d).select("feature", "run", F.col("y").alias("x"), ((F.col("scan") % 7) + 0.5).alias("r"))
    return rounded(D.even_run_points(s, "feature", "run", "x", "r"), 8)


@query("kernel_ids", "SELECT l_linenumber, l_orderkey, CASE WHEN l_quantity = floor(l_quantity) AND l_quantity < 20 THEN l_quantity::INTEGER END AS kernel FROM lineitem")
def kernel_ids(spark, d):
    li = T.table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", F.col("l_quantity").alias("kernel"))
    return D.kernel_ids(li, "kernel", 20)


@query("split_reliability", f"WITH {VECTORS}, m AS (SELECT run, feature, avg(y) FILTER (scan % 2 = 0) AS a, avg(y) FILTER (scan % 2 = 1) AS b FROM vec GROUP BY ALL) SELECT run, round(corr(a, b), 8) AS r, count(*) AS n FROM m GROUP BY run")
def split_reliability(spark, d):
    v = T.vector_signal(spark, d).withColumn("half", F.col("scan") % 2)
    return rounded(D.split_half(v, ["run"], "feature", "half", "y"), 8)


@query("threshold_curve", f"WITH {VECTORS}, m AS (SELECT feature, abs(avg(y)) AS r FROM vec GROUP BY feature), t AS (SELECT unnest([0.0, 0.002, 0.004, 0.008])::DOUBLE AS threshold) SELECT threshold, count(*) AS n, round(avg(r), 8) AS mean FROM m JOIN t ON r >= threshold GROUP BY threshold")
def threshold_curve(spark, d):
    m = T.vector_signal(spark, d).groupBy("feature").agg(F.abs(F.avg("y")).alias("r"))
    return rounded(D.threshold_curve(m, "r", [0.0, 0.002, 0.004, 0.008]), 8, "mean")


@query("pattern_rdm", f"WITH {VECTORS}, m AS (SELECT run, feature, avg(y) AS v FROM vec GROUP BY ALL) SELECT a.run AS a, b.run AS b, round(1 - corr(a.v, b.v), 8) AS distance FROM m a JOIN m b ON a.feature = b.feature AND a.run < b.run GROUP BY ALL")
def pattern_rdm(spark, d):
    m = T.vector_signal(spark, d).groupBy("run", "feature").agg(F.avg("y").alias("v"))
    return rounded(D.pattern_distances(m, "run", "feature", "v"), 8)


@query("rdm_agreement", f"""WITH {VECTORS}, m AS (SELECT scan % 2 AS half, run, feature, avg(y) AS v FROM vec GROUP BY ALL),
r AS (SELECT a.half, a.run AS a, b.run AS b, 1 - corr(a.v, b.v) AS d FROM m a JOIN m b ON a.half = b.half AND a.feature = b.feature AND a.run < b.run GROUP BY ALL)
SELECT round(corr(x.d, y.d), 8) AS r, count(*) AS n FROM r x JOIN r y ON x.a = y.a AND x.b = y.b AND x.half = 0 AND y.half = 1""")  # fmt: skip
def rdm_agreement(spark, d):
    v = T.vector_signal(spark, d)
    one, two = (D.pattern_distances(v.where(F.col("scan") % 2 == h).groupBy("run", "feature").agg(F.avg("y").alias("v")), "run", "feature", "v") for h in (0, 1))
    j = one.withColumnRenamed("distance", "x").join(two.withColumnRenamed("distance", "y"), ["a", "b"])
    return rounded(A.correlation(j, [], "x", "y"), 8)


@query("workflow_medians", f"WITH {SIGNAL} SELECT feature, round(median(y), 6) AS activation, round(avg((y > 0)::INTEGER), 8) AS active FROM signal GROUP BY feature")
def workflow_medians(spark, d):
    s = T.event_signal(spark, d)
    return rounded(rounded(s.groupBy("feature").agg(F.median("y").alias("activation"), F.avg((F.col("y") > 0).cast("double")).alias("active")), 6, "activation"), 8, "active")


@query("equivalence_test")
def equivalence_test(spark, d):
    v = T.vector_signal(spark, d)
    halves = v.groupBy("run", "feature").agg((F.avg(F.when(F.col("scan") % 2 == 0, F.col("y"))) - F.avg(F.when(F.col("scan") % 2 == 1, F.col("y")))).alias("difference"))
    return rounded(D.paired_equivalence(halves, ["run"], "difference", 0.02), 8)


@query("table_fingerprint")
def table_fingerprint(spark, d):
    from ripplemark.functions.fingerprints import table_digest

    return table_digest(T.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("online_moments", f"WITH {CELLS} SELECT run, feature, count(*) AS n, round(covar_pop(x, y) * count(*), 6) + 0.0 AS xy, round(var_pop(y) * count(*), 6) + 0.0 AS yy FROM cells GROUP BY ALL")
def online_moments(spark, d):
    from ripplemark.streaming.moments import moments

    m = moments(T.event_cells(spark, d), ["run", "feature"])
    return rounded(m.select("run", "feature", "n", "xy", "yy"), 6)


