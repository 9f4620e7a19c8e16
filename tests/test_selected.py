from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplemark.operators import estimators as E
from ripplemark.operators import selected as S
from ripplemark.plans import simulate as M
from ripplemark.plans.design import event_responses
from ripplemark.plans.kernels import CANONICAL, Library
from tests.test_prepared import packed


@pytest.fixture(scope="module")
def trials():
    rng = np.random.default_rng(5)
    xs = {k: {r: np.abs(rng.normal(size=(50, 5))) for r in (0, 1)} for k in (0, 2)}
    ns = {r: np.ones((50, 1)) for r in (0, 1)}
    return xs, ns, {r: rng.normal(size=(50, 4)) for r in (0, 1)}


def test_trials_by_kernel_and_fraction(spark, trials):
    xs, ns, signals = trials
    picks = spark.createDataFrame([(0, 0, 0.5), (1, 2, 0.8), (2, 2, None), (3, None, 0.5)], "feature int, kernel int, fraction double")
    rows = {(r["run"], r["trial"], r["feature"]): r["coef"] for r in S.selected_trials(packed(spark, signals), picks, xs, ns).collect()}
    for r in (0, 1):
        for f, k, part in ((0, 0, 0.5), (1, 2, 0.8)):
            want = E.TrialPath.of(xs[k][r], ns[r], False).fractional(signals[r][:, [f]], part)[0][:, 0]
            assert [rows[r, t, f] for t in range(5)] == pytest.approx(want)
        assert all(rows[r, t, f] is None for t in range(5) for f in (2, 3))
    plain = S.selected_trials(packed(spark, signals), picks.drop("fraction"), xs, ns, alpha=0.3).where("run = 1 and feature = 2").orderBy("trial").collect()
    assert [r["coef"] for r in plain] == pytest.approx(E.TrialPath.of(xs[2][1], ns[1], True).ridge(signals[1][:, [2]], 0.3)[:, 0])


def test_components_by_rho(spark, trials):
    xs, ns, signals = trials
    rhos = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 0.3)], "feature int, rho double")
    rows = {r["feature"]: r for r in S.variance_components_by_rho(packed(spark, signals), rhos, ns, xs[0]).collect()}
    want = E.reml_fit(E.pool_terms([E.reml_terms(signals[r], ns[r], xs[0][r], 0.3) for r in (0, 1)]))
    assert rows[1]["criterion"] == pytest.approx(want["criterion"][1]) and rows[3]["status"] == "no_rho" and rows[3]["ratio"] is None


def test_eligibility_names_the_run():
    rng = np.random.default_rng(0)
    ok = E.candidate_run(np.ones((20, 1)), [rng.normal(size=(20, 1)), rng.normal(size=(20, 1))])
    flat = E.candidate_run(np.ones((20, 1)), [rng.normal(size=(20, 1)), np.ones((20, 1))])
    table = S.eligibility({0: ok, 1: flat})
    assert table[0] == (0, True, "") and not table[1][1] and "run 1" in table[1][2]


def test_decoding(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 2, float(i % 3), (np.eye(3)[i % 3] * 4 + rng.normal(size=3)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, label double, v array<double>")
    assert all(r["accuracy"] > 0.8 and r["n"] == 60 for r in S.decoding_accuracy(df, "fold", "label", "v").collect())


def test_simulated_truth():
    rng = np.random.default_rng(1)
    e = M.ar1_noise(4000, 0.6, 2.0, rng)[:, 0]
    assert abs((e[1:] * e[:-1]).mean() / (e**2).mean() - 0.6) < 0.05 and abs(e.var() - 2) < 0.4
    p = M.phase_surrogate(e, rng)
    np.testing.assert_allclose(np.abs(np.fft.rfft(p))[1:-1], np.abs(np.fft.rfft(e - e.mean()))[1:-1], rtol=1e-6)
    lib = Library.of([(5.0, 16.0, 1.0, 1.0, 6.0, 0.0, 32.0)])
    assert M.library_floor(CANONICAL, lib) == pytest.approx(1.0) and M.recovery((5.0, 16.0, 1.0, 1.0, 6.0, 0.0, 32.0), CANONICAL)["peak_error"] < -0.5
    assert len(M.half_splits([1, 2, 3, 4], 0, 99)) == 3 and len(M.half_splits([1, 2, 3], 0, 2)) == 2
    import pandas as pd

    times = np.arange(40) * 1.0
    got = event_responses(pd.DataFrame({"onset": [5.0], "duration": [2.0]}), times)[:, 0]
    assert np.abs(got - M.synthesise([5.0], [2.0], [1.0], times, CANONICAL)).max() < 0.02


def test_mean_interval(spark):
    from ripplemark.operators.diagnostics import mean_interval

    df = spark.range(10).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    r = mean_interval(df, ["k"], "v").first()
    assert r["mean"] == 4.5 and r["high"] - r["low"] == pytest.approx(2 * 1.96 * np.std(range(10), ddof=1) / np.sqrt(10))
