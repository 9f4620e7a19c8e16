"""Aggregations, sequences and choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplemark.operators import aggregates as A
from ripplemark.operators import picks as P
from ripplemark.operators import windows as W
from ripplemark.queries.base import CELLS, ORDERS, SIGNAL, TRIALS, VECTORS, query, rounded
from ripplemark.sources import tables as T

# -- canonical signals --


@query("signal_long", f"WITH {SIGNAL} SELECT run, scan, feature, round(y, 6) AS y, x FROM signal")
def signal_long(spark, d):
    return rounded(T.event_signal(spark, d))


@query("signal_vectors", f"WITH {VECTORS} SELECT run, scan, feature, round(y, 6) AS y FROM vec")
def signal_vectors(spark, d):
    return rounded(T.vector_signal(spark, d))


@query("signal_orders", f"WITH {ORDERS} SELECT run, scan, feature, round(y, 2) AS y, round(x, 2) AS x FROM ord")
def signal_orders(spark, d):
    return rounded(T.order_signal(spark, d), 2)


@query("signal_packed", f"WITH {SIGNAL} SELECT run, feature, count(*) AS scans, round(sum(y * (scan + 1)), 2) AS moment, round(max(y), 6) AS top FROM signal GROUP BY ALL")
def signal_packed(spark, d):
    p = T.packed(T.event_signal(spark, d))
    moment = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return p.select("run", "feature", F.size("y").cast("long").alias("scans"), F.round(moment, 2).alias("moment"), F.round(F.array_max("y"), 6).alias("top"))


@query("feature_blocks", f"WITH {VECTORS}, v AS (SELECT feature FROM vec GROUP BY feature HAVING max(y) <> min(y)) SELECT feature, ((row_number() OVER (ORDER BY feature) - 1) // 16)::INTEGER AS block FROM v")
def feature_blocks(spark, d):
    return T.feature_blocks(T.vector_signal(spark, d), 16)


@query("block_scan", f"""WITH {VECTORS}, v AS (SELECT feature FROM vec GROUP BY feature HAVING max(y) <> min(y)),
b AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1) // 16 AS block FROM v)
SELECT run, block::INTEGER AS block, count(*) AS n, round(sum(y), 6) AS total FROM vec JOIN b USING (feature) GROUP BY ALL""")  # fmt: skip
def block_scan(spark, d):
    s = T.vector_signal(spark, d)
    rows = s.join(T.feature_blocks(s, 16), "feature")
    return rounded(rows.groupBy("run", "block").agg(F.count("*").alias("n"), F.sum("y").alias("total")))


# -- sums of squares and pooling --


@query("sums_of_squares", f"WITH {SIGNAL} SELECT run, feature, round(sum((y - 40 * x) ** 2), 4) AS sse, round(CASE WHEN max(y) = min(y) THEN 0 ELSE var_pop(y) * count(*) END, 4) AS sst, count(*) AS n FROM signal GROUP BY ALL")
def sums_of_squares(spark, d):
    s = T.event_signal(spark, d).withColumn("fitted", 40 * F.col("x"))
    return rounded(A.sums_of_squares(s, ["run", "feature"]), 4)


@query("pooled_r2", f"""WITH {SIGNAL}, s AS (SELECT run, feature, sum((y - 245 * x) ** 2) AS sse, var_pop(y) * count(*) AS sst FROM signal GROUP BY ALL)
SELECT feature, round(sum(sse), 4) AS sse, round(sum(sst), 4) AS sst, round(CASE WHEN sum(sst) > 0 THEN 1 - sum(sse) / sum(sst) END, 8) AS r2 FROM s GROUP BY feature""")  # fmt: skip
def pooled_r2(spark, d):
    s = T.event_signal(spark, d).withColumn("fitted", 245 * F.col("x"))
    out = A.pooled_r2(A.sums_of_squares(s, ["run", "feature"]), ["feature"])
    return rounded(rounded(out, 4, "sse", "sst"), 8, "r2")


@query("sufficient_stats", f"""WITH {SIGNAL}, k AS (SELECT *, 1.0::DOUBLE AS one FROM signal)
SELECT run, feature, round(sum(x * x), 4) AS a_0_0, round(sum(x * one), 4) AS a_0_1, round(sum(one * one), 4) AS a_1_1, round(sum(x * y), 4) AS b_0, round(sum(y), 4) AS b_1, round(sum(y * y), 4) AS c, count(*) AS n
FROM k GROUP BY run, feature""")  # fmt: skip
def sufficient_stats(spark, d):
    s = T.event_signal(spark, d).withColumn("one", F.lit(1.0))
    return rounded(rounded(A.sufficient_statistics(s, ["run", "feature"], ["x", "one"]), 4, "a_0_0", "a_0_1", "a_1_1"), 4, "b_0", "b_1", "c")


@query("finite_summary", f"WITH {VECTORS} SELECT run, round(avg(y), 8) AS mean, count(y) AS n, round(var_samp(y), 8) AS variance, round(median(y), 8) AS median FROM vec GROUP BY run")
def finite_summary(spark, d):
    return rounded(A.finite_summary(T.vector_signal(spark, d), ["run"], "y"), 8)


@query("percentiles_by_model", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def percentiles_by_model(spark, d):
    return rounded(A.percentiles(T.table(spark, d, "events"), ["event_type"], "value", [0.1, 0.5, 0.9]))


@query("joint_quartiles", """WITH j AS (SELECT d.lang, d.n_chars::DOUBLE AS a, l.quality::DOUBLE AS b FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, count(*) AS n, round(quantile_cont(a, 0.25), 6) AS q1, round(quantile_cont(a, 0.5), 6) AS q2, round(quantile_cont(a, 0.75), 6) AS q3 FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY lang""")  # fmt: skip
def joint_quartiles(spark, d):
    j = T.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("a")).join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.percentile("a", [0.25, 0.5, 0.75])
    out = j.where("a is not null and quality is not null").groupBy("lang").agg(F.count("*").alias("n"), q.alias("q"))
    return rounded(out.select("lang", "n", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3))))


@query("top_counts", "SELECT label, count(*) AS count, round(count(*) / (SELECT count(*) FROM embeddings), 8) AS share FROM embeddings GROUP BY label ORDER BY count DESC, label LIMIT 10")
def top_counts(spark, d):
    return rounded(A.top_counts(T.table(spark, d, "embeddings"), "label"), 8)


@query("observed_levels", "SELECT DISTINCT (user_id % 6)::INTEGER AS run, event_type AS level FROM events")
def observed_levels(spark, d):
    return T.table(spark, d, "events").select((F.col("user_id") % 6).cast("int").alias("run"), F.col("event_type").alias("level")).distinct()


@query("level_counts", f"WITH {TRIALS} SELECT run, count(*) FILTER (trial_type = 'click') AS click, count(*) FILTER (trial_type = 'purchase') AS purchase, count(*) FILTER (trial_type = 'refund') AS refund FROM et GROUP BY run")
def level_counts(spark, d):
    return A.level_counts(T.event_table(spark, d), ["run"], "trial_type", ["click", "purchase", "refund"])


@query("boundary_share", "SELECT o_orderstatus AS status, round(avg((o_totalprice > 150000)::INTEGER), 8) AS share, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL")
def boundary_share(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 150000).alias("flag"), (F.col("o_orderpriority") != "5-LOW").alias("used"))
    return rounded(A.flag_share(o, ["status"], "flag", "used"), 8)


@query("pooled_share", """WITH b AS (SELECT o_orderstatus AS status, o_custkey % 7 AS block, avg((o_totalprice > 150000)::INTEGER) AS share, count(*) AS n FROM orders GROUP BY ALL)
SELECT status, round(sum(share * n) / sum(n), 8) AS share, sum(n)::BIGINT AS n FROM b GROUP BY status""")  # fmt: skip
def pooled_share(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("block"), (F.col("o_totalprice") > 150000).alias("flag"))
    return rounded(A.pooled_share(A.flag_share(o, ["status", "block"], "flag"), ["status"]), 8)


@query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def correlation(spark, d):
    return rounded(A.correlation(T.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 8)


@query("correlation_all", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem")
def correlation_all(spark, d):
    return rounded(A.correlation(T.table(spark, d, "lineitem"), [], "l_quantity", "l_extendedprice"), 8)


@query("rt_corr", f"""WITH {VECTORS}, j AS (SELECT feature, run, y AS b, (scan % 7)::DOUBLE + 0.5 AS r FROM vec),
c AS (SELECT feature, run, b - avg(b) OVER w AS b, r - avg(r) OVER w AS r FROM j WINDOW w AS (PARTITION BY feature, run)),
m AS (SELECT feature, run, sum(b * r) AS xy, sum(b * b) AS xx, sum(r * r) AS yy, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT feature, unnest(['run-' || lpad(run::VARCHAR, 2, '0'), 'all', CASE WHEN run % 2 = 0 THEN 'even' ELSE 'odd' END]) AS scope, xy, xx, yy, n FROM m)
SELECT feature, scope, round(sum(xy) / sqrt(sum(xx) * sum(yy)), 8) AS r, sum(n)::BIGINT AS n FROM s GROUP BY ALL""")  # fmt: skip
def rt_corr(spark, d):
    s = T.vector_signal(spark, d).withColumn("r", (F.col("scan") % 7) + 0.5)
    return rounded(A.within_run_correlation(s, "feature", "run", "y", "r"), 8)


@query("standard_errors", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 8) AS mean_error,
round(avg((value > 400)::INTEGER), 8) AS rate, round(sqrt(avg((value > 400)::INTEGER) * (1 - avg((value > 400)::INTEGER)) / count(value)), 8) AS rate_error FROM events GROUP BY event_type""")  # fmt: skip
def standard_errors(spark, d):
    e = T.table(spark, d, "events").withColumn("hit", F.col("value") > 400)
    return rounded(rounded(A.standard_errors(e, ["event_type"], "value", "hit"), 8, "mean_error", "rate", "rate_error"), 6, "mean")


@query("glm_comparison", f"WITH {SIGNAL}, m AS (SELECT unnest([['sum', feature], ['count', feature]]) AS k, unnest([y, x]) AS v FROM signal) SELECT k[1] AS model, k[2] AS statistic, count(*) AS n, round(median(v), 6) AS median FROM m GROUP BY ALL")
def glm_comparison(spark, d):
    s = T.event_signal(spark, d)
    long = s.select("feature", F.expr("stack(2, 'sum', y, 'count', x) as (model, v)"))
    return rounded(long.groupBy("model", F.col("feature").alias("statistic")).agg(F.count("*").alias("n"), F.median("v").alias("median")))


@query("binomial_count", "SELECT event_type, count(*) FILTER (value < 24.5) AS hits, count(*) AS n FROM events GROUP BY event_type")
def binomial_count(spark, d):
    return T.table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 24.5).alias("hits"), F.count("*").alias("n"))


# -- sequences --


@query("lag_moments", f"""WITH {SIGNAL}, l AS (SELECT run, feature, y, lag(y) OVER (PARTITION BY run, feature ORDER BY scan) AS b FROM signal)
SELECT run, feature, round(sum(y * b), 4) AS m1, round(sum(b * b), 4) AS m0, round(sum(y * b) / sum(b * b), 8) AS ratio FROM l GROUP BY ALL""")  # fmt: skip
def lag_moments(spark, d):
    return rounded(rounded(W.lag_moments(T.event_signal(spark, d), ["run", "feature"]), 4, "m1", "m0"), 8, "ratio")


@query("whiten_ar1", f"""WITH {SIGNAL}, l AS (SELECT run, scan, feature, y, lag(y) OVER (PARTITION BY run, feature ORDER BY scan) AS b FROM signal)
SELECT run, scan, feature, round(CASE WHEN b IS NULL THEN y ELSE (y - 0.3 * b) / sqrt(1 - 0.09) END, 6) AS white FROM l""")  # fmt: skip
def whiten_ar1(spark, d):
    return rounded(W.whiten(T.event_signal(spark, d), ["run", "feature"], F.lit(0.3)).select("run", "scan", "feature", "white"))


@query("prefix_sums", f"WITH {SIGNAL} SELECT run, scan, feature, round(sum(y) OVER (PARTITION BY run, feature ORDER BY scan), 4) AS prefix FROM signal")
def prefix_sums(spark, d):
    return rounded(W.prefix_sums(T.event_signal(spark, d), ["run", "feature"], "scan", "y").select("run", "scan", "feature", "prefix"), 4)


@query("centre_within_run", f"WITH {VECTORS} SELECT run, scan, feature, round(y - avg(y) OVER (PARTITION BY run, feature), 8) + 0.0 AS y FROM vec")
def centre_within_run(spark, d):
    return rounded(A.centred(T.vector_signal(spark, d), ["run", "feature"], ["y"]), 8)


@query("acf10", f"""WITH {SIGNAL}, e AS (SELECT run, feature, scan, y - avg(y) OVER (PARTITION BY run, feature) AS e FROM signal),
p AS (SELECT a.run, a.feature, (a.scan - b.scan)::INTEGER AS lag, sum(a.e * b.e) AS s FROM e a JOIN e b ON a.run = b.run AND a.feature = b.feature AND a.scan - b.scan BETWEEN 0 AND 10 GROUP BY ALL)
SELECT p.run, p.feature, p.lag, round(p.s / z.s, 8) AS r FROM p JOIN p z ON z.run = p.run AND z.feature = p.feature AND z.lag = 0 WHERE p.lag > 0""")  # fmt: skip
def acf10(spark, d):
    return rounded(W.autocorrelation(T.event_signal(spark, d), ["run", "feature"]), 8)


@query("presentation_order", f"WITH {TRIALS} SELECT event_id, (row_number() OVER (PARTITION BY trial_type ORDER BY onset, event_id) - 1)::INTEGER AS repetition FROM et")
def presentation_order(spark, d):
    return W.presentation_order(T.event_table(spark, d), "trial_type", ["onset", "event_id"]).select("event_id", "repetition")


@query("circular_shift", f"WITH {TRIALS} SELECT event_id, round((onset + 1000000.5) - 2592000.0 * floor((onset + 1000000.5) / 2592000.0), 6) AS onset FROM et")
def circular_shift(spark, d):
    e = T.event_table(spark, d)
    return rounded(e.select("event_id", W.circular_shift(F.col("onset"), 1000000.5, 2592000.0).alias("onset")), 6)


@query("lagged_corr", f"""WITH {VECTORS}, c AS (SELECT run, scan, feature, y - avg(y) OVER (PARTITION BY run, scan) AS v FROM vec),
u AS (SELECT run, scan, feature, v / sqrt(sum(v * v) OVER (PARTITION BY run, scan)) AS v FROM c),
p AS (SELECT a.run, a.scan - b.scan AS lag, a.scan, sum(a.v * b.v) AS r FROM u a JOIN u b ON a.run = b.run AND a.feature = b.feature AND a.scan - b.scan BETWEEN 1 AND 15 GROUP BY ALL)
SELECT run, lag::INTEGER AS lag, round(avg(r), 8) AS r, count(*) AS pairs FROM p GROUP BY ALL""")  # fmt: skip
def lagged_corr(spark, d):
    return rounded(W.lagged_pattern_correlation(T.vector_signal(spark, d), "run", "scan", "feature", "y"), 8)


@query("smallest_step", f"WITH {TRIALS}, g AS (SELECT run, onset - lag(onset) OVER (PARTITION BY run ORDER BY onset, event_id) AS d FROM et) SELECT run, round(min(d), 6) AS step FROM g GROUP BY run")
def smallest_step(spark, d):
    return rounded(W.smallest_step(T.event_table(spark, d), ["run"], "onset"))


@query("half_width", f"""WITH {CELLS}, s AS (SELECT feature, scan, round(sum(y), 6) AS y FROM cells GROUP BY ALL),
m AS (SELECT *, max(y) OVER (PARTITION BY feature) AS top FROM s), i AS (SELECT *, sum((y < 0.5 * top)::INTEGER) OVER (PARTITION BY feature ORDER BY scan) AS island FROM m),
w AS (SELECT feature, island, count(*) AS width, min(scan) FILTER (y = top) AS peak_at FROM i WHERE y >= 0.5 * top GROUP BY ALL)
SELECT feature, width, peak_at FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY peak_at) AS k FROM w WHERE peak_at IS NOT NULL) WHERE k = 1""")  # fmt: skip
def half_width(spark, d):
    s = T.event_cells(spark, d).groupBy("feature", "scan").agg(F.round(F.sum("y"), 6).alias("y"))
    return W.half_width(s, ["feature"], "scan", "y")


# -- choices --

_SCORES = "s AS (SELECT l_suppkey AS item, l_linenumber AS candidate, round(avg(l_quantity), 1) AS score FROM lineitem GROUP BY ALL)"


def _scores(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("candidate")).agg(F.round(F.avg("l_quantity"), 1).alias("score"))


@query("kernel_pick", f"WITH {_SCORES} SELECT item, min(candidate) AS candidate, min(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item) AS top FROM s) WHERE score = top GROUP BY item")
def kernel_pick(spark, d):
    return P.best_candidate(_scores(spark, d), ["item"], "candidate", "score")


@query("fraction_choose", f"WITH {_SCORES} SELECT item, max(candidate) AS candidate, max(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item) AS top FROM s) WHERE score = top GROUP BY item")
def fraction_choose(spark, d):
    return P.best_fraction(_scores(spark, d), ["item"], "candidate", "score")


@query("ridge_choose", f"""WITH {_SCORES}, full_ AS (SELECT item FROM s GROUP BY item HAVING count(*) = count(score)),
c AS (SELECT candidate, quantile_cont(score, 0.9) AS objective FROM s SEMI JOIN full_ USING (item) GROUP BY candidate), e AS (SELECT max(objective) AS top, min(candidate) AS lo, max(candidate) AS hi FROM c),
b AS (SELECT min(candidate) AS candidate FROM c, e WHERE objective >= top - 1e-12)
SELECT b.candidate, round(c.objective, 6) AS objective, (lo < hi AND (b.candidate = lo OR b.candidate = hi)) AS at_boundary FROM b JOIN c USING (candidate), e""")  # fmt: skip
def ridge_choose(spark, d):
    return rounded(P.best_penalty(_scores(spark, d), "item", "candidate", "score"))


@query("reml_top2", f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS n, lead(candidate) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY item ORDER BY score, candidate))
SELECT item, candidate, score, runner_up, round(n - score, 6) AS gap FROM k WHERE k = 1""")  # fmt: skip
def reml_top2(spark, d):
    return rounded(P.two_best(_scores(spark, d), ["item"], "candidate", "score"))


@query("pcstop_choice", f"""WITH {_SCORES}, c AS (SELECT item, candidate - 1 AS count, score FROM s), b AS (SELECT item, score AS base FROM c WHERE count = 0),
g AS (SELECT c.item, c.count, score - base AS gain FROM c JOIN b USING (item)),
w AS (SELECT *, max(gain) OVER (PARTITION BY item ORDER BY count) AS best, max(gain) OVER (PARTITION BY item) AS top FROM g),
z AS (SELECT *, min(CASE WHEN best * 1.05 >= top - 1.42e-14 * greatest(1, abs(top)) THEN count END) OVER (PARTITION BY item) AS stop FROM w),
h AS (SELECT *, max(CASE WHEN count = stop THEN best END) OVER (PARTITION BY item) AS held FROM z)
SELECT item, (CASE WHEN max(top) <= 0 THEN 0 ELSE min(CASE WHEN gain = held THEN count END) END)::INTEGER AS count FROM h GROUP BY item""")  # fmt: skip
def pcstop_choice(spark, d):
    curve = _scores(spark, d).select("item", (F.col("candidate") - 1).alias("count"), "score")
    return P.first_good_enough(curve, ["item"], "count", "score")


@query("eligible_pick", f"""WITH {_SCORES}, bad AS (SELECT candidate FROM s GROUP BY candidate HAVING min(score) < 5), k AS (SELECT * FROM s ANTI JOIN bad USING (candidate))
SELECT item, min(candidate) AS candidate, min(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item) AS top FROM k) WHERE score = top GROUP BY item""")  # fmt: skip
def eligible_pick(spark, d):
    s = _scores(spark, d)
    bad = s.groupBy("candidate").agg(F.min("score").alias("m")).where("m < 5").select("candidate")
    return P.best_candidate(s.join(F.broadcast(bad), "candidate", "left_anti"), ["item"], "candidate", "score")


@query("scored_everywhere", "WITH s AS (SELECT d.source AS feature, d.lang AS candidate, avg(l.quality) AS score FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL) SELECT feature FROM s GROUP BY feature HAVING count(*) = count(score)")
def scored_everywhere(spark, d):
    j = T.table(spark, d, "documents").select("doc_id", F.col("source").alias("feature"), F.col("lang").alias("candidate")).join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return P.scored_everywhere(j.groupBy("feature", "candidate").agg(F.avg("quality").alias("score")), "feature", "score")


@query("pool_mask", """WITH s AS (SELECT p_partkey AS feature, avg(l_discount) AS v FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey),
k AS (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, feature) AS place, count(*) FILTER (v > 0.08) OVER () AS n FROM s)
SELECT feature, coalesce(v <= 0.03, false) AS pool, CASE WHEN n >= 100 THEN coalesce(v > 0.08, false) ELSE v IS NOT NULL AND place <= 100 END AS scoring FROM k""")  # fmt: skip
def pool_mask(spark, d):
    from ripplemark.operators.shaping import pool_masks

    s = T.table(spark, d, "part").select(F.col("p_partkey").alias("feature")).join(T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), "l_discount"), "feature", "left")
    return pool_masks(s.groupBy("feature").agg(A.exact_mean(F.col("l_discount")).alias("v")), "feature", "v", pool_at_most=0.03, scoring_above=0.08)


@query("evenly_spaced", """WITH k AS (SELECT o_orderpriority AS grp, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
t AS (SELECT *, CASE WHEN n <= 64 THEN 1.0 ELSE (n - 1) / 63.0 END::DOUBLE AS step FROM k)
SELECT grp, o_orderkey FROM t WHERE k = floor(floor(k / step + 0.5) * step + 0.5)""")  # fmt: skip
def evenly_spaced(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), "o_orderkey", "o_totalprice")
    return P.evenly_spaced(o, ["grp"], ["o_totalprice", "o_orderkey"], 64).select("grp", "o_orderkey")


@query("strongest_feature", f"""WITH {VECTORS}, c AS (SELECT run, feature, corr(y, (scan % 7)::DOUBLE) AS r FROM vec GROUP BY ALL)
SELECT run, feature, round(r, 8) AS r FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(r) DESC, feature) AS k FROM c WHERE r IS NOT NULL) WHERE k = 1""")  # fmt: skip
def strongest_feature(spark, d):
    s = T.vector_signal(spark, d).withColumn("m", (F.col("scan") % 7).cast("double"))
    c = A.correlation(s, ["run", "feature"], "y", "m")
    return rounded(P.strongest(c, ["run"], "feature", "r"), 8)


@query("level_order", "SELECT p_size::VARCHAR AS level, row_number() OVER (ORDER BY p_size) AS place FROM (SELECT DISTINCT p_size FROM part)")
def level_order(spark, d):
    from ripplemark.functions.scalars import level_name, level_order

    levels = T.table(spark, d, "part").select(level_name(F.col("p_size")).alias("level")).distinct()
    return levels.select("level", F.row_number().over(Window.orderBy(*level_order(F.col("level")))).cast("long").alias("place"))
