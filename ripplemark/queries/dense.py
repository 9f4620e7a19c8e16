"""Dense estimators on blocks of features, with SQL where fixed designs make them sums of fixed vectors; the tests hold the others against plain NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ripplemark.operators import dense as B
from ripplemark.operators import estimators as E
from ripplemark.operators import picks as P
from ripplemark.plans import design as X
from ripplemark.plans.kernels import Library
from ripplemark.queries import design_sql as W
from ripplemark.queries.base import SIGNAL, query, rounded
from ripplemark.sources import tables as T

HOURS = np.arange(T.HOURS, dtype=float)


def packed_events(spark, d):
    """Hourly sums by event type, packed; time in hours."""
    return T.packed(T.event_signal(spark, d))


def hour_events(n: int = 24) -> pd.DataFrame:
    """A fixed stimulus: n events, every 29 hours, of two kinds. A design, the same for every table."""
    onset = 5.0 + 29.0 * np.arange(n)
    return pd.DataFrame({"onset": onset, "duration": np.where(np.arange(n) % 3 == 0, 4.0, 1.0), "trial_type": np.where(np.arange(n) % 2 == 0, "a", "b")})


def designs() -> dict[int, X.Design]:
    return {r: X.compile_design(hour_events(), HOURS, drift="polynomial", drift_order=2) for r in range(T.RUNS)}


def nuisances() -> dict[int, np.ndarray]:
    return {r: X.compile_nuisance(HOURS, drift="polynomial", drift_order=2).matrix for r in range(T.RUNS)}


def library() -> Library:
    return Library.of([(a, 16.0, c, 1.0, 6.0, 0.0, 32.0) for a in (4.5, 7.5) for c in (0.8, 1.2)])


def candidate_runs() -> dict[int, E.CandidateRun]:
    lib = library()
    task = [X.event_responses(hour_events(), HOURS, p).sum(axis=1, keepdims=True) for p in lib.parameters]
    return {r: E.candidate_run(n, task) for r, n in nuisances().items()}


def _contrast(ds: dict[int, X.Design], text: str) -> dict[int, np.ndarray]:
    from ripplemark.plans.model import contrast_vector

    return {r: contrast_vector(text, x.names) for r, x in ds.items()}


@query("glm_ols")
def glm_ols(spark, d):
    ds = designs()
    return rounded(B.fit_glm(packed_events(spark, d), {r: x.matrix for r, x in ds.items()}, {"a-b": _contrast(ds, "a - b"), "a": _contrast(ds, "a")}))


@query("glm_ar1")
def glm_ar1(spark, d):
    ds = designs()
    return rounded(B.fit_glm(packed_events(spark, d), {r: x.matrix for r, x in ds.items()}, {"a-b": _contrast(ds, "a - b")}, "ar1"))


@query("glm_one_regressor", f"""WITH {SIGNAL}, z AS (SELECT *, cos(pi() * (scan + 0.5) / 720) AS z FROM signal), c AS (SELECT run, feature, z - avg(z) OVER w AS z, y - avg(y) OVER w AS y FROM z WINDOW w AS (PARTITION BY run, feature)),
s AS (SELECT run, feature, count(*) AS n, sum(z * z) AS zz, sum(z * y) AS zy, sum(y * y) AS yy FROM c GROUP BY ALL), e AS (SELECT *, zy / zz AS effect, (yy - zy * zy / zz) / (n - 2) / zz AS variance FROM s)
SELECT feature, round(avg(effect), 4) AS effect, round(sum(variance) / 36, 4) AS variance, round(avg(effect) / sqrt(sum(variance) / 36), 6) AS t FROM e GROUP BY feature""")  # fmt: skip
def glm_one_regressor(spark, d):
    x = np.column_stack([np.cos(np.pi * (HOURS + 0.5) / T.HOURS), np.ones(T.HOURS)])
    runs = range(T.RUNS)
    out = B.fit_glm(packed_events(spark, d), dict.fromkeys(runs, x), {"z": dict.fromkeys(runs, np.array([1.0, 0.0]))})
    return rounded(rounded(out.select("feature", "effect", "variance", "t"), 4, "effect", "variance"), 6, "t")


@query("glm_delta_r2", W.delta_r2(designs()[0].matrix, nuisances()[0]))
def glm_delta_r2(spark, d):
    return rounded(B.task_delta_r2(packed_events(spark, d), {r: x.matrix for r, x in designs().items()}, nuisances()), 8)


@query("glm_selected")
def glm_selected(spark, d):
    lib = library()
    kernels = B.select_kernels(packed_events(spark, d), candidate_runs()).select("feature", "kernel")
    each = {k: {r: X.compile_design(hour_events(), HOURS, kernel=p, drift="polynomial", drift_order=2).matrix for r in range(T.RUNS)} for k, p in enumerate(lib.parameters)}
    return rounded(B.fit_selected(packed_events(spark, d), kernels, each, {"a-b": _contrast(designs(), "a - b")}))


@query("lag_estimates")
def lag_estimates(spark, d):
    return rounded(B.lag_estimates(packed_events(spark, d), {r: x.matrix for r, x in designs().items()}))


def _task_columns() -> list[np.ndarray]:
    return [X.event_responses(hour_events(), HOURS, p).sum(axis=1, keepdims=True) for p in library().parameters]


@query("kernel_scores", W.kernel_scores(_task_columns(), nuisances()[0]))
def kernel_scores(spark, d):
    return rounded(B.candidate_scores(packed_events(spark, d), candidate_runs()), 8)


@query("kernel_select_dense", W.kernel_select(_task_columns(), nuisances()[0]))
def kernel_select_dense(spark, d):
    return rounded(B.select_kernels(packed_events(spark, d), candidate_runs()), 8)


@query("kernel_split_dense", W.kernel_split(_task_columns(), nuisances()[0]))
def kernel_split_dense(spark, d):
    return rounded(B.candidate_scores(packed_events(spark, d), candidate_runs(), [0, 2, 4], [1, 3, 5]), 8)


def _trials() -> dict[int, np.ndarray]:
    x = X.event_responses(hour_events(), HOURS)
    return dict.fromkeys(range(T.RUNS), x)


@query("trial_ols", W.trials(W.ridge_weights(_trials()[0], nuisances()[0], 0.0)))
def trial_ols(spark, d):
    return rounded(B.trial_coefficients(packed_events(spark, d), _trials(), nuisances()))


@query("trial_ridge", W.trials(W.ridge_weights(_trials()[0], nuisances()[0], 0.5)))
def trial_ridge(spark, d):
    return rounded(B.trial_coefficients(packed_events(spark, d), _trials(), nuisances(), alpha=0.5))


@query("fractional_ridge")
def fractional_ridge(spark, d):
    return rounded(B.trial_coefficients(packed_events(spark, d), _trials(), nuisances(), fraction=0.6))


@query("trial_separate", W.trials(W.separate_weights(_trials()[0], nuisances()[0])))
def trial_separate(spark, d):
    return rounded(B.trial_coefficients(packed_events(spark, d), _trials(), nuisances(), separate=True))


@query("trial_r2", W.trial_r2(_trials()[0], nuisances()[0], 0.5))
def trial_r2(spark, d):
    return rounded(B.trial_r2(packed_events(spark, d), _trials(), nuisances(), alpha=0.5), 8)


def _predictors() -> dict[int, np.ndarray]:
    e = hour_events()
    return {r: np.column_stack([(e["trial_type"] == "a").to_numpy(float), (np.arange(len(e)) * (r + 3)) % 7 * 1.0]) for r in range(T.RUNS)}


@query("encode_trials", W.encode_trials(W.ridge_weights(_trials()[0], nuisances()[0], 0.0), _predictors(), [0, 2, 4], [1, 3, 5]))
def encode_trials(spark, d):
    coefs = B.trial_coefficients(packed_events(spark, d), _trials(), nuisances())
    return rounded(B.encode_coefficients(coefs, _predictors(), [0, 2, 4], [1, 3, 5]), 8)


@query("ridge_cv", W.ridge_cv(_trials()[0], nuisances()[0], _predictors(), [0.0, 0.1, 1.0, 10.0]))
def ridge_cv(spark, d):
    scores = B.penalty_scores(packed_events(spark, d), _trials(), nuisances(), _predictors(), [0.0, 0.1, 1.0, 10.0])
    return rounded(P.best_penalty(scores, "feature", "penalty", "score"), 8)


@query("fraction_cv")
def fraction_cv(spark, d):
    scores = B.penalty_scores(packed_events(spark, d), _trials(), nuisances(), _predictors(), [0.2, 0.5, 0.8, 1.0], "fraction")
    return rounded(P.best_fraction(scores, ["feature"], "penalty", "score"), 8)


@query("ridge_cv_selected")
def ridge_cv_selected(spark, d):
    lib = library()
    each = {k: dict.fromkeys(range(T.RUNS), X.event_responses(hour_events(), HOURS, p)) for k, p in enumerate(lib.parameters)}
    scores = B.penalty_scores(packed_events(spark, d), _trials(), nuisances(), _predictors(), [0.0, 1.0], candidates=candidate_runs(), kernel_trials=each)
    return rounded(scores, 8)


@query("reml_fit")
def reml_fit(spark, d):
    return rounded(B.variance_components(packed_events(spark, d), {r: x.matrix for r, x in designs().items()}, _trials()))


@query("reml_select")
def reml_select(spark, d):
    each = [dict.fromkeys(range(T.RUNS), X.event_responses(hour_events(), HOURS, p)) for p in library().parameters]
    return rounded(B.select_random_design(packed_events(spark, d), nuisances(), each))


def _components(spark, d):
    packed = packed_events(spark, d)
    return packed, B.noise_components(packed, packed.select("feature").distinct(), nuisances(), 3)


def _task() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    x = X.event_responses(hour_events(), HOURS).sum(axis=1, keepdims=True)
    return {r: (x, n) for r, n in nuisances().items()}


@query("noise_components")
def noise_components(spark, d):
    _, comps = _components(spark, d)
    rows = [(r, k, float(np.abs(c[:, k]).max()), float((c[:, k] ** 2).sum())) for r, c in comps.items() for k in range(c.shape[1])]
    return rounded(spark.createDataFrame(rows, "run int, component int, peak double, energy double"))


@query("component_scores")
def component_scores(spark, d):
    packed, comps = _components(spark, d)
    return rounded(B.component_scores(packed, _task(), comps, [0, 1, 2, 3]), 8)


@query("component_count")
def component_count(spark, d):
    packed, comps = _components(spark, d)
    scores = B.component_scores(packed, _task(), comps, [0, 1, 2, 3])
    curve = scores.groupBy("count").agg(F.median("score").alias("score")).withColumn("scope", F.lit("all"))
    return P.first_good_enough(curve, ["scope"], "count", "score")


@query("denoise_gate")
def denoise_gate(spark, d):
    packed, comps = _components(spark, d)
    return rounded(B.component_tests(packed, _task(), comps, 2))


@query("mixture_threshold")
def mixture_threshold(spark, d):
    """The values are rounded to 3 places and counted, so that the fit reads a table of bounded size."""
    v = T.table(spark, d, "events").select(F.round(F.ln("value"), 3).alias("v")).groupBy("v").count().orderBy("v").collect()
    t = E.mixture_threshold(np.array([r["v"] for r in v]), np.array([r["count"] for r in v], float))
    return rounded(spark.createDataFrame([(t, len(v))], "threshold double, distinct_values long"))


@query("glm_prepared")
def glm_prepared(spark, d):
    from ripplemark.plans.prepared import Prepared, fit_prepared

    ds = designs()
    roles = {n: "task" if n in ("a", "b") else "intercept" if n == "constant" else "nuisance" for n in ds[0].names}
    prepared = Prepared({r: x.matrix for r, x in ds.items()}, {r: x.names for r, x in ds.items()}, roles)
    return rounded(fit_prepared(packed_events(spark, d), prepared, {"a": "a", "a-b": "a - b"}))


@query("denoise_select")
def denoise_select(spark, d):
    from ripplemark.operators.denoising import select_components

    task = {r: t for r, (t, _) in _task().items()}
    found = select_components(packed_events(spark, d), task, nuisances(), counts=(0, 1, 2, 3), threshold=0.0005)
    return rounded(found.scores.withColumn("chosen", F.col("count") == found.count), 8)


def _each_trials() -> dict[int, dict[int, np.ndarray]]:
    return {k: dict.fromkeys(range(T.RUNS), X.event_responses(hour_events(), HOURS, p)) for k, p in enumerate(library().parameters)}


def _problem(kind: str, grid: list[float]):
    from ripplemark.operators.nested import Problem

    return Problem(_each_trials(), nuisances(), _predictors(), grid, kind, candidate_runs())


@query("nested_ridge")
def nested_ridge(spark, d):
    from ripplemark.operators.nested import nested_evaluation

    return rounded(nested_evaluation(packed_events(spark, d), _problem("ridge", [0.0, 1.0, 10.0]))[0], 8)


@query("nested_fraction")
def nested_fraction(spark, d):
    from ripplemark.operators.nested import nested_evaluation

    return rounded(nested_evaluation(packed_events(spark, d), _problem("fraction", [0.3, 0.6, 1.0]))[0], 8)


@query("nested_refit")
def nested_refit(spark, d):
    from ripplemark.operators.nested import coefficients, tune

    packed, problem = packed_events(spark, d), _problem("fraction", [0.3, 0.6, 1.0])
    return rounded(coefficients(packed, problem, tune(packed, problem, range(T.RUNS))))


def _kernel_designs() -> dict[int, dict[int, np.ndarray]]:
    each = [X.compile_design(hour_events(), HOURS, kernel=p, drift="polynomial", drift_order=2).matrix for p in library().parameters]
    return {k: dict.fromkeys(range(T.RUNS), x) for k, x in enumerate(each)}


@query("selected_delta_r2", W.selected_delta_r2([x[0] for x in _kernel_designs().values()], _task_columns(), nuisances()[0]))
def selected_delta_r2(spark, d):
    from ripplemark.operators.selected import selected_delta_r2 as gain

    packed = packed_events(spark, d)
    kernels = B.select_kernels(packed, candidate_runs()).select("feature", "kernel")
    return rounded(gain(packed, kernels, _kernel_designs(), nuisances()), 8)


@query("reml_diagnostics")
def reml_diagnostics(spark, d):
    from ripplemark.operators.selected import random_design_diagnostics

    return rounded(random_design_diagnostics(packed_events(spark, d), nuisances(), list(_each_trials().values())))


@query("component_fold_scores")
def component_fold_scores(spark, d):
    packed, comps = _components(spark, d)
    return rounded(B.component_fold_scores(packed, _task(), comps, [0, 1, 2]), 8)
