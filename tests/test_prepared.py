from __future__ import annotations

import numpy as np
import pytest

from ripplemark.operators import denoising as N
from ripplemark.operators import estimators as E
from ripplemark.plans.prepared import Prepared, delta_r2_prepared, fit_prepared, role_table


def packed(spark, signals):
    rows = [(r, int(f), [float(v) for v in y[:, f]]) for r, y in signals.items() for f in range(y.shape[1])]
    return spark.createDataFrame(rows, "run int, feature int, y array<double>")


def test_prepared_designs_by_role(spark):
    rng = np.random.default_rng(0)
    m = {r: np.column_stack([rng.normal(size=(30, 2)), np.ones(30)]) for r in (0, 1)}
    names = {0: ("a", "m", "one"), 1: ("a", "m", "one")}
    p = Prepared(m, names, {"a": "task", "m": "nuisance", "one": "intercept"})
    y = {r: rng.normal(size=(30, 3)) + 2 * x[:, :1] for r, x in m.items()}
    rows = {r["feature"]: r for r in fit_prepared(packed(spark, y), p, {"a": "a"}, "ols").collect()}
    want = E.combine_runs([E.fit_run(y[r], m[r], np.array([[1.0, 0, 0]])) for r in (0, 1)])
    assert all(rows[f]["t"] == pytest.approx(want["t"][0, f]) for f in range(3))
    assert all(r["delta_r2"] > 0.5 for r in delta_r2_prepared(packed(spark, y), p).collect())
    assert len(role_table(p)) == 6 and p.identity() == p.identity()
    with pytest.raises(ValueError):
        Prepared(m, names, {"a": "task", "m": "odd", "one": "intercept"})
    with pytest.raises(ValueError):
        p.vectors({"x": "q"})


def denoise_problem(seed=0, shared=True):
    rng = np.random.default_rng(seed)
    task, nuisance, signals = {}, {}, {}
    for r in range(4):
        n = 80 + 4 * r
        x = np.clip(np.sin(np.arange(n) / 5 + r), 0, 1)[:, None]
        latent = rng.normal(size=(n, 2)).cumsum(0) * 0.3
        task[r], nuisance[r] = x, np.ones((n, 1))
        noise = rng.normal(size=(n, 30))
        mix = latent @ rng.normal(size=(2, 30)) * (1.5 if shared else 0)
        signals[r] = noise + mix + x * np.r_[np.full(10, 2.0), np.zeros(20)]
    return task, nuisance, signals


def test_components_help_where_noise_is_shared(spark):
    task, nuisance, signals = denoise_problem()
    df = packed(spark, signals)
    found = N.select_components(df, task, nuisance, counts=(0, 1, 2, 3, 4), threshold=0.1)
    assert found.count >= 1 and found.names()[0] == "denoise_pc_000" and found.significant > 0
    wider = N.with_components(nuisance, found)
    assert all(wider[r].shape[1] == 1 + found.count for r in wider)
    with pytest.raises(ValueError):
        N.with_components(wider, found)
    curve = {r["count"]: r["score"] for r in found.scores.collect()}
    assert curve[found.count] > curve[0]


def test_three_runs_are_needed(spark):
    task, nuisance, signals = denoise_problem()
    with pytest.raises(ValueError):
        N.select_components(packed(spark, {r: signals[r] for r in (0, 1)}), {r: task[r] for r in (0, 1)}, {r: nuisance[r] for r in (0, 1)})
    with pytest.raises(ValueError):
        N.select_components(packed(spark, signals), task, nuisance, counts=(1, 2))


def test_onoff_is_the_pooled_r2(spark):
    task, nuisance, signals = denoise_problem()
    rows = {r["feature"]: r["r2"] for r in N.onoff_r2(packed(spark, signals), task, nuisance).collect()}
    x = np.concatenate([task[r] - task[r].mean() for r in range(4)])
    y = np.concatenate([signals[r] - signals[r].mean(0) for r in range(4)])
    beta = (x.T @ y) / (x.T @ x)
    want = 1 - ((y - x @ beta) ** 2).sum(0) / (y**2).sum(0)
    assert all(rows[f] == pytest.approx(want[f]) for f in range(30))
