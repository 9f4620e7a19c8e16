"""Least squares, held-out prediction, noise and likelihoods as aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import aggregates as A
from ripplemark.operators import picks as P
from ripplemark.operators import regression as R
from ripplemark.operators import windows as W
from ripplemark.queries.base import ORDERS, SIGNAL, VECTORS, query, rounded
from ripplemark.sources import tables as T

_SUMS = """c AS (SELECT run, feature, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM signal WINDOW w AS (PARTITION BY run, feature)),
s AS (SELECT run, feature, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM c GROUP BY ALL)"""
_FIT = "e AS (SELECT *, xy / xx AS effect, greatest(0, yy - xy * xy / xx) AS sse FROM s)"


@query("ols_effect", f"WITH {SIGNAL}, {_SUMS}, {_FIT} SELECT run, feature, round(effect, 6) AS effect, round(sse / (n - 2) / xx, 6) AS variance, round(effect / sqrt(sse / (n - 2) / xx), 6) AS t, n - 2 AS dof FROM e")
def ols_effect(spark, d):
    return rounded(R.ols_one(T.event_signal(spark, d), ["run", "feature"]).select("run", "feature", "effect", "variance", "t", "dof"))


@query("ols_r2", f"WITH {SIGNAL}, {_SUMS}, {_FIT} SELECT feature, round(1 - sum(sse) / sum(yy), 8) AS r2 FROM e GROUP BY feature")
def ols_r2(spark, d):
    fits = R.ols_one(T.event_signal(spark, d), ["run", "feature"])
    return rounded(A.pooled_r2(fits, ["feature"]).select("feature", "r2"), 8)


@query("fixed_effects", f"""WITH {SIGNAL}, {_SUMS}, {_FIT}, f AS (SELECT feature, avg(effect) AS effect, sum(sse / (n - 2) / xx) / (count(*) * count(*)) AS variance, sum(n - 2)::BIGINT AS dof, count(*) AS runs FROM e GROUP BY feature)
SELECT feature, round(effect, 6) AS effect, round(variance, 6) AS variance, dof, runs, round(effect / sqrt(variance), 6) AS t FROM f""")  # fmt: skip
def fixed_effects(spark, d):
    return rounded(A.fixed_effects(R.ols_one(T.event_signal(spark, d), ["run", "feature"]), ["feature"]))


_TWO = """c AS (SELECT run, feature, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y FROM (SELECT *, cos(pi() * (scan + 0.5) / 720) AS z FROM signal) WINDOW w AS (PARTITION BY run, feature)),
s AS (SELECT run, feature, count(*) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM c GROUP BY ALL),
b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s)"""


def _two(spark, d):
    import math

    return T.event_signal(spark, d).withColumn("z", F.cos(F.lit(math.pi) * (F.col("scan") + 0.5) / 720))


@query("ols_two", f"""WITH {SIGNAL}, {_TWO}, e AS (SELECT *, greatest(0, yy - bx * xy - bz * zy) AS sse FROM b)
SELECT run, feature, round(bx, 6) AS effect_x, round(bz, 6) AS effect_z, round(sse / (n - 3) * zz / det, 6) AS variance_x, round(sse / (n - 3) * xx / det, 6) AS variance_z, n - 3 AS dof FROM e""")  # fmt: skip
def ols_two(spark, d):
    return rounded(R.ols_two(_two(spark, d), ["run", "feature"]).drop("sse", "sst"))


@query("contrast_weights", f"WITH {SIGNAL}, {_TWO} SELECT run, feature, round(1.0 * bx - 0.5 * bz, 6) AS effect FROM b")
def contrast_weights(spark, d):
    from ripplemark.plans.model import parse_contrast

    w = parse_contrast("x - 0.5 * z", ["x", "z"])
    fits = R.ols_two(_two(spark, d), ["run", "feature"])
    return rounded(fits.select("run", "feature", (F.lit(float(w[0])) * F.col("effect_x") + F.lit(float(w[1])) * F.col("effect_z")).alias("effect")))


@query("delta_r2", f"""WITH {SIGNAL}, {_TWO}, e AS (SELECT feature, sum(greatest(0, yy - bx * xy - bz * zy)) AS f, sum(greatest(0, yy - zy * zy / zz)) AS n, sum(yy) AS t FROM b GROUP BY feature)
SELECT feature, round(1 - f / t, 8) AS full_r2, round(1 - n / t, 8) AS nuisance_r2, round(greatest(0, (1 - f / t) - (1 - n / t)), 8) AS delta_r2 FROM e""")  # fmt: skip
def delta_r2(spark, d):
    return rounded(R.delta_r2(_two(spark, d), "feature", "run", "x", "z", "y"), 8)


@query("residualise", f"""WITH {SIGNAL}, z AS (SELECT *, cos(pi() * (scan + 0.5) / 720) AS z FROM signal),
c AS (SELECT run, scan, feature, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y FROM z WINDOW w AS (PARTITION BY run, feature)),
b AS (SELECT run, feature, sum(z * y) / sum(z * z) AS b FROM c GROUP BY ALL) SELECT run, scan, feature, round(y - b * z, 6) + 0.0 AS y FROM c JOIN b USING (run, feature)""")  # fmt: skip
def residualise(spark, d):
    c = A.centred(_two(spark, d), ["run", "feature"], ["z", "y"])
    b = c.groupBy("run", "feature").agg(F.try_divide(F.sum(F.col("z") * F.col("y")), F.sum(F.col("z") * F.col("z"))).alias("b"))
    return rounded(c.join(b, ["run", "feature"]).select("run", "scan", "feature", (F.col("y") - F.col("b") * F.col("z")).alias("y")))


# -- held-out prediction --

#: Three candidate regressors: counts of the same hour, an hour before, and both.
_CANDIDATES = """act AS (SELECT run, scan, sum(x) AS x FROM signal GROUP BY ALL),
reg AS (SELECT run, scan, 0 AS candidate, x FROM act UNION ALL SELECT run, scan, 1, coalesce(lag(x) OVER (PARTITION BY run ORDER BY scan), 0) FROM act
        UNION ALL SELECT run, scan, 2, x + coalesce(lag(x) OVER (PARTITION BY run ORDER BY scan), 0) FROM act),
rc AS (SELECT run, scan, candidate, x - avg(x) OVER (PARTITION BY run, candidate) AS x FROM reg),
sc AS (SELECT run, scan, feature, y - avg(y) OVER (PARTITION BY run, feature) AS y FROM signal),
a AS (SELECT run, candidate, sum(x * x) AS a FROM rc GROUP BY ALL), cc AS (SELECT run, feature, sum(y * y) AS c FROM sc GROUP BY ALL),
st AS (SELECT run, candidate, feature, a.a, sum(x * y) AS b, cc.c FROM sc JOIN rc USING (run, scan) JOIN a USING (run, candidate) JOIN cc USING (run, feature) GROUP BY ALL)"""
_LORO = """lo AS (SELECT h.candidate, h.feature, h.run, h.a, h.b, h.c, sum(o.b) / sum(o.a) AS beta FROM st h JOIN st o ON o.candidate = h.candidate AND o.feature = h.feature AND o.run <> h.run GROUP BY ALL),
sco AS (SELECT candidate, feature, 1 - sum(greatest(0, c - 2 * beta * b + beta * beta * a)) / sum(c) AS score FROM lo GROUP BY ALL)"""


def _regressors(signal):
    act = signal.groupBy("run", "scan").agg(F.sum("x").alias("x"))
    from pyspark.sql import Window

    before = F.coalesce(F.lag("x").over(Window.partitionBy("run").orderBy("scan")), F.lit(0.0))
    wide = act.select("run", "scan", "x", before.alias("l"))
    return wide.select("run", "scan", F.expr("stack(3, 0, x, 1, l, 2, x + l) as (candidate, x)"))


def _stats(spark, d):
    s = T.event_signal(spark, d)
    return R.candidate_statistics(s, _regressors(s))


@query("candidate_stats", f"WITH {SIGNAL}, {_CANDIDATES} SELECT run, candidate, feature, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM st")
def candidate_stats(spark, d):
    return rounded(_stats(spark, d), 6)


@query("loro_r2", f"WITH {SIGNAL}, {_CANDIDATES}, {_LORO} SELECT candidate, feature, round(score, 8) AS score FROM sco")
def loro_r2(spark, d):
    return rounded(R.leave_one_run_out(_stats(spark, d)), 8)


@query("loro_orders", f"""WITH {ORDERS}, d AS (SELECT DISTINCT run, scan, feature, x AS x, y FROM ord), c AS (SELECT run, feature, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM d WINDOW w AS (PARTITION BY run, feature)),
st AS (SELECT 0 AS candidate, run, feature, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM c GROUP BY ALL), {_LORO} SELECT candidate, feature, round(score, 8) AS score FROM sco""")  # fmt: skip
def loro_orders(spark, d):
    s = R.centred_sums(T.order_signal(spark, d), ["run", "feature"], ["x", "y"])
    return rounded(R.leave_one_run_out(s.select("run", F.lit(0).alias("candidate"), "feature", F.col("s_x_x").alias("a"), F.col("s_x_y").alias("b"), F.col("s_y_y").alias("c"))), 8)


@query("kernel_select", f"""WITH {SIGNAL}, {_CANDIDATES}, {_LORO}, m AS (SELECT *, max(score) OVER (PARTITION BY feature) AS top FROM sco),
p AS (SELECT feature, min(candidate) AS candidate FROM m WHERE score >= top - 64 * 2.220446049250313e-16 * greatest(1, abs(top)) GROUP BY feature)
SELECT p.feature, p.candidate, round(s.score, 8) AS score, round(z.score, 8) AS canonical_score, round(s.score - z.score, 8) + 0.0 AS delta
FROM p JOIN sco s ON s.feature = p.feature AND s.candidate = p.candidate JOIN sco z ON z.feature = p.feature AND z.candidate = 0""")  # fmt: skip
def kernel_select(spark, d):
    scores = R.leave_one_run_out(_stats(spark, d))
    best = P.best_candidate(scores, ["feature"], "candidate", "score")
    base = scores.where("candidate = 0").select("feature", F.col("score").alias("canonical_score"))
    return rounded(best.join(base, "feature").withColumn("delta", F.col("score") - F.col("canonical_score")), 8)


_SPLIT = """f AS (SELECT candidate, feature, sum(b) / sum(a) AS beta FROM st WHERE run % 2 = {train} GROUP BY ALL),
sco AS (SELECT st.candidate, st.feature, 1 - sum(greatest(0, c - 2 * beta * b + beta * beta * a)) / sum(c) AS score FROM st JOIN f USING (candidate, feature) WHERE run % 2 = {test} GROUP BY ALL)"""


@query("split_eval", f"WITH {SIGNAL}, {_CANDIDATES}, {_SPLIT.format(train=1, test=0)} SELECT candidate, feature, round(score, 8) AS score FROM sco")
def split_eval(spark, d):
    return rounded(R.split_scores(_stats(spark, d), F.col("run") % 2 == 1, F.col("run") % 2 == 0), 8)


@query("split_both_ways", f"""WITH {SIGNAL}, {_CANDIDATES}, f AS (SELECT run % 2 AS part, candidate, feature, sum(b) / sum(a) AS beta FROM st GROUP BY ALL)
SELECT CASE WHEN st.run % 2 = 0 THEN 'odd_to_even' ELSE 'even_to_odd' END AS split, st.candidate, st.feature, round(1 - sum(greatest(0, c - 2 * beta * b + beta * beta * a)) / sum(c), 8) AS score
FROM st JOIN f ON f.candidate = st.candidate AND f.feature = st.feature AND f.part <> st.run % 2 GROUP BY ALL""")  # fmt: skip
def split_both_ways(spark, d):
    s = _stats(spark, d)
    odd, even = F.col("run") % 2 == 1, F.col("run") % 2 == 0
    one = R.split_scores(s, odd, even).select(F.lit("odd_to_even").alias("split"), "*")
    return rounded(one.unionByName(R.split_scores(s, even, odd).select(F.lit("even_to_odd").alias("split"), "*")), 8)


@query("onoff_r2", f"""WITH {SIGNAL}, {_CANDIDATES}, p AS (SELECT feature, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM st WHERE candidate = 0 GROUP BY feature) SELECT feature, round(1 - (c - b * b / a) / c, 8) AS r2 FROM p""")
def onoff_r2(spark, d):
    s = _stats(spark, d).where("candidate = 0").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    sse = F.col("c") - F.try_divide(F.col("b") * F.col("b"), F.col("a"))
    return rounded(s.select("feature", A.r_squared(sse, F.col("c")).alias("r2")), 8)


# -- noise --


@query("lag1_rho", f"""WITH {SIGNAL}, {_SUMS}, b AS (SELECT run, feature, xy / xx AS b FROM s), r AS (SELECT sg.run, sg.feature, sg.scan, (sg.y - avg(sg.y) OVER w) - b.b * (sg.x - avg(sg.x) OVER w) AS e FROM signal sg JOIN b ON b.run = sg.run AND b.feature = sg.feature WINDOW w AS (PARTITION BY sg.run, sg.feature)),
l AS (SELECT run, feature, e, lag(e) OVER (PARTITION BY run, feature ORDER BY scan) AS p FROM r) SELECT run, feature, round(sum(e * p) / sum(p * p), 8) AS ratio FROM l GROUP BY ALL""")  # fmt: skip
def lag1_rho(spark, d):
    return rounded(_residual_ratios(spark, d), 8)


def _residual_ratios(spark, d):
    keys = ["run", "feature"]
    c = A.centred(T.event_signal(spark, d), keys, ["x", "y"])
    b = c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("b"))
    e = c.join(b, keys).select(*keys, "scan", (F.col("y") - F.col("b") * F.col("x")).alias("e"))
    return W.lag_moments(e, keys, "scan", "e").select(*keys, "ratio")


@query("pooled_rho", f"""WITH {SIGNAL}, {_SUMS}, b AS (SELECT run, feature, xy / xx AS b FROM s), r AS (SELECT sg.run, sg.feature, sg.scan, (sg.y - avg(sg.y) OVER w) - b.b * (sg.x - avg(sg.x) OVER w) AS e FROM signal sg JOIN b ON b.run = sg.run AND b.feature = sg.feature WINDOW w AS (PARTITION BY sg.run, sg.feature)),
l AS (SELECT run, feature, e, lag(e) OVER (PARTITION BY run, feature ORDER BY scan) AS p FROM r), q AS (SELECT sum(e * p) / sum(p * p) AS rho FROM l GROUP BY run, feature)
SELECT round(greatest(-0.2, least(0.95, median(rho))), 8) AS rho, (median(rho) <= -0.2 OR median(rho) >= 0.95) AS at_bound FROM q""")  # fmt: skip
def pooled_rho(spark, d):
    from ripplemark.operators.dense import pooled_rho as pool

    return rounded(pool(_residual_ratios(spark, d).withColumnRenamed("ratio", "rho")), 8)


@query("rho_shrunk", f"""WITH {SIGNAL}, l AS (SELECT run, feature, y - avg(y) OVER (PARTITION BY run, feature) AS e, scan FROM signal), p AS (SELECT run, feature, e, lag(e) OVER (PARTITION BY run, feature ORDER BY scan) AS b FROM l),
r AS (SELECT run, feature, sum(e * b) / sum(b * b) AS rho FROM p GROUP BY ALL), z AS (SELECT *, atanh(rho) AS z FROM r), m AS (SELECT avg(z) AS mu, var_samp(z) AS v FROM z)
SELECT run, feature, round(tanh(mu + greatest(0, v - 1.0 / 717) / v * (z - mu)), 8) AS rho FROM z, m""")  # fmt: skip
def rho_shrunk(spark, d):
    s = A.centred(T.event_signal(spark, d), ["run", "feature"], ["y"])
    z = W.lag_moments(s, ["run", "feature"]).select("run", "feature", F.atanh("ratio").alias("z"))
    m = z.agg(F.avg("z").alias("mu"), F.var_samp("z").alias("v"))
    keep = F.greatest(F.lit(0.0), F.col("v") - 1.0 / 717) / F.col("v")
    return rounded(z.join(F.broadcast(m)).select("run", "feature", F.tanh(F.col("mu") + keep * (F.col("z") - F.col("mu"))).alias("rho")), 8)


# -- likelihoods and encoding --


@query("reml_criterion", f"""WITH {VECTORS}, t AS (SELECT feature, sum(CASE WHEN scan % 4 = 3 THEN y * y ELSE 0 END) AS rss, count(*) AS dof FROM vec GROUP BY feature),
k AS (SELECT feature, scan % 4 AS axis, 1.0 + scan % 4 AS s2, sum(y * y) AS c2 FROM vec WHERE scan % 4 < 3 GROUP BY ALL), g AS (SELECT unnest([0.0, 0.1, 1.0, 10.0])::DOUBLE AS ratio),
q AS (SELECT k.feature, g.ratio, sum(c2 / (1 + g.ratio * s2)) AS q, sum(ln(1 + g.ratio * s2)) AS logdet FROM k, g GROUP BY ALL)
SELECT q.feature, q.ratio, round(t.dof * ln((t.rss + q.q) / t.dof) + q.logdet, 6) AS criterion FROM q JOIN t USING (feature)""")  # fmt: skip
def reml_criterion(spark, d):
    v = T.vector_signal(spark, d).withColumn("axis", F.col("scan") % 4)
    by = v.groupBy("feature").agg(
        F.sum(F.when(F.col("axis") == 3, F.col("y") ** 2).otherwise(0.0)).alias("rss"), F.count("*").alias("dof"),
        F.array(*(F.sum(F.when(F.col("axis") == i, F.col("y") ** 2).otherwise(0.0)) for i in range(3))).alias("c2"),
    )
    s2 = F.array(*(F.lit(1.0 + i) for i in range(3)))
    rows = by.withColumn("s2", s2).withColumn("ratio", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.1, 1.0, 10.0)))))
    q = F.expr("aggregate(zip_with(c2, s2, (c, s) -> c / (1 + ratio * s)), rss, (a, x) -> a + x)")
    logdet = F.expr("aggregate(transform(s2, s -> ln(1 + ratio * s)), 0D, (a, x) -> a + x)")
    return rounded(rows.select("feature", "ratio", (F.col("dof") * F.ln(q / F.col("dof")) + logdet).alias("criterion")))


@query("encoding_within", f"""WITH {VECTORS}, j AS (SELECT *, (scan % 5)::DOUBLE AS x FROM vec), tr AS (SELECT feature, run, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM j WHERE run < 5 WINDOW w AS (PARTITION BY feature, run)),
b AS (SELECT feature, sum(x * y) / sum(x * x) AS b FROM tr GROUP BY feature), te AS (SELECT feature, run, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM j WHERE run >= 5 WINDOW w AS (PARTITION BY feature, run))
SELECT feature, round(any_value(b.b), 8) AS slope, round(1 - sum((y - b.b * x) ** 2) / sum(y * y), 8) AS r2 FROM te JOIN b USING (feature) GROUP BY feature""")  # fmt: skip
def encoding_within(spark, d):
    j = T.vector_signal(spark, d).withColumn("x", (F.col("scan") % 5).cast("double"))
    s = R.centred_sums(j, ["feature", "run"], ["x", "y"])
    xx, xy, yy, train = F.col("s_x_x"), F.col("s_x_y"), F.col("s_y_y"), F.col("run") < 5
    sums = s.groupBy("feature").agg(*(F.sum(F.when(train == own, c)).alias(f"{n}_{'train' if own else 'test'}") for n, c in (("xx", xx), ("xy", xy), ("yy", yy)) for own in (True, False)))
    slope = F.try_divide(F.col("xy_train"), F.col("xx_train"))
    lost = F.col("yy_test") - 2 * slope * F.col("xy_test") + slope * slope * F.col("xx_test")
    return rounded(sums.where("yy_test is not null").select("feature", slope.alias("slope"), (1 - F.try_divide(lost, F.col("yy_test"))).alias("r2")), 8)


@query("encoding_absolute", f"""WITH {VECTORS}, j AS (SELECT *, (scan % 5)::DOUBLE AS x FROM vec), b AS (SELECT feature, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j WHERE run < 5 GROUP BY feature),
e AS (SELECT j.feature, j.run, sum((y - a - b * x) ** 2) AS sse, var_pop(y) * count(*) AS sst FROM j JOIN b USING (feature) WHERE run >= 5 GROUP BY ALL) SELECT feature, round(1 - sum(sse) / sum(sst), 8) AS r2 FROM e GROUP BY feature""")  # fmt: skip
def encoding_absolute(spark, d):
    j = T.vector_signal(spark, d).withColumn("x", (F.col("scan") % 5).cast("double"))
    b = j.where("run < 5").groupBy("feature").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    e = j.where("run >= 5").join(b, "feature").withColumn("fitted", F.col("a") + F.col("b") * F.col("x"))
    return rounded(A.pooled_r2(A.sums_of_squares(e, ["feature", "run"]), ["feature"]).select("feature", "r2"), 8)
