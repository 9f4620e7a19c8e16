"""The dense queries against plain NumPy on whole arrays, written from the definitions."""

from __future__ import annotations

import numpy as np
import pytest

from ripplemark.plans import design as X
from ripplemark.queries import QUERIES
from ripplemark.queries import dense as Q
from ripplemark.queries.base import SIGNAL
from ripplemark.sources import tables as T
from tests.oracle import connection

RUNS = range(T.RUNS)


@pytest.fixture(scope="module")
def y(data):
    """run to scans x features, and the features."""
    rows = connection(data).sql(f"WITH {SIGNAL} SELECT run, scan, feature, y FROM signal").df()
    features = sorted(rows["feature"].unique())
    return {r: rows[rows["run"] == r].pivot(index="scan", columns="feature", values="y")[features].to_numpy(float) for r in RUNS}, features


@pytest.fixture(scope="module")
def result(spark, data):
    held = {}

    def get(name, *keys):
        if name not in held:
            held[name] = QUERIES[name](spark, data).toPandas()
        return held[name].set_index(list(keys)).sort_index() if keys else held[name]

    return get


def off(a, x):
    """What least squares on x leaves of a."""
    return a - x @ np.linalg.lstsq(x, a, rcond=None)[0]


def same(got, want, tolerance=2e-5):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-5, atol=tolerance)


def one_run(y, x, c):
    """Effect and variance by the normal equations; residual and total sums of squares."""
    inverse = np.linalg.pinv(x.T @ x)
    rest = off(y, x)
    sse = (rest**2).sum(0)
    return c @ inverse @ x.T @ y, sse / (len(y) - np.linalg.matrix_rank(x)) * (c @ inverse @ c), sse, ((y - y.mean(0)) ** 2).sum(0)


def pooled(y, xs, c):
    parts = [one_run(y[r], xs[r], c[r]) for r in RUNS]
    effect, variance = np.mean([p[0] for p in parts], 0), np.sum([p[1] for p in parts], 0) / len(parts) ** 2
    return effect, variance, 1 - np.sum([p[2] for p in parts], 0) / np.sum([p[3] for p in parts], 0)


def test_glm_ols(y, result):
    xs = {r: d.matrix for r, d in Q.designs().items()}
    got = result("glm_ols", "contrast", "feature")
    for name, text in (("a-b", "a - b"), ("a", "a")):
        effect, variance, r2 = pooled(y[0], xs, Q._contrast(Q.designs(), text))
        rows = got.loc[name].loc[y[1]]
        same(rows["effect"], effect)
        same(rows["t"], effect / np.sqrt(variance), 1e-4)
        same(rows["r2"], r2)


def test_glm_ar1_is_ols_on_filtered_rows(y, result):
    """Each feature by itself: its coefficient rounded to the stated bins, all rows filtered, and ordinary least squares."""
    from ripplemark.operators import estimators as E

    rows = result("glm_ar1", "feature").loc[y[1]]
    cs = Q._contrast(Q.designs(), "a - b")
    for i in range(len(y[1])):
        effects, variances = [], []
        for r, d in Q.designs().items():
            rest = off(y[0][r][:, i], d.matrix)
            rho = (rest[1:] @ rest[:-1]) / (rest @ rest)
            rho = int(rho * E.AR_BINS) / E.AR_BINS

            def filtered(a, rho=rho):
                out = a.astype(float).copy()
                out[1:] -= rho * a[:-1]
                return out

            e, v, *_ = one_run(filtered(y[0][r][:, i]), filtered(d.matrix), cs[r])
            effects.append(e)
            variances.append(v)
        same(rows["effect"].iloc[i], np.mean(effects), 1e-4)


def test_glm_delta_r2(y, result):
    rows = result("glm_delta_r2", "feature").loc[y[1]]
    sst = sum(((v - v.mean(0)) ** 2).sum(0) for v in y[0].values())
    full = 1 - sum((off(y[0][r], d.matrix) ** 2).sum(0) for r, d in Q.designs().items()) / sst
    null = 1 - sum((off(y[0][r], n) ** 2).sum(0) for r, n in Q.nuisances().items()) / sst
    same(rows["full_r2"], full)
    same(rows["delta_r2"], full - null)


def held_out(y, tasks, ns, train, test):
    """R2 on the test runs of amplitudes fitted on the stacked training runs, nuisance taken from both sides of every run."""
    ys, xs = {r: off(y[r], ns[r]) for r in ns}, {r: off(tasks[r], ns[r]) for r in ns}
    a = np.linalg.lstsq(np.concatenate([xs[r] for r in train]), np.concatenate([ys[r] for r in train]), rcond=None)[0]
    return sum(((ys[r] - xs[r] @ a) ** 2).sum(0) for r in test), sum((ys[r] ** 2).sum(0) for r in test)


def tasks_of(p, runs=RUNS):
    return dict.fromkeys(runs, X.event_responses(Q.hour_events(), Q.HOURS, p).sum(axis=1, keepdims=True))


def loro(y, p, ns, runs=RUNS):
    parts = [held_out(y, tasks_of(p), ns, [r for r in runs if r != h], [h]) for h in runs]
    return 1 - sum(p[0] for p in parts) / sum(p[1] for p in parts)


def test_kernel_scores_and_selection(y, result):
    scores = np.array([loro(y[0], p, Q.nuisances()) for p in Q.library().parameters])
    got = result("kernel_scores", "candidate", "feature")
    split = result("kernel_split_dense", "candidate", "feature")
    for i, p in enumerate(Q.library().parameters):
        same(got.loc[i].loc[y[1]]["score"], scores[i], 1e-7)
        lost, energy = held_out(y[0], tasks_of(p), Q.nuisances(), [0, 2, 4], [1, 3, 5])
        same(split.loc[i].loc[y[1]]["score"], 1 - lost / energy, 1e-7)
    rows = result("kernel_select_dense", "feature").loc[y[1]]
    assert rows["kernel"].tolist() == scores.argmax(0).tolist()
    same(rows["delta"], scores.max(0) - scores[0], 1e-7)


def test_selected_fits(y, result):
    kernels = result("kernel_select_dense", "feature").loc[y[1]]["kernel"].tolist()
    got, gain = result("glm_selected", "feature").loc[y[1]], result("selected_delta_r2", "feature").loc[y[1]]
    for i, k in enumerate(kernels):
        xs = {r: X.compile_design(Q.hour_events(), Q.HOURS, kernel=Q.library().parameters[k], drift="polynomial", drift_order=2).matrix for r in RUNS}
        own = {r: v[:, [i]] for r, v in y[0].items()}
        effect, variance, r2 = pooled(own, xs, Q._contrast(Q.designs(), "a - b"))
        same(got["effect"].iloc[i], effect[0])
        same(got["r2"].iloc[i], r2[0])
        sst = sum(((v - v.mean(0)) ** 2).sum(0) for v in own.values())
        null = 1 - sum((off(own[r], n) ** 2).sum(0) for r, n in Q.nuisances().items()) / sst
        same(gain["delta_r2"].iloc[i], (r2 - null)[0])


def ridge(y, x, n, alpha):
    yr, xr = off(y, n), off(x, n)
    norm = np.sqrt((xr**2).sum(0))
    return np.linalg.solve((xr / norm).T @ (xr / norm) + alpha * np.eye(x.shape[1]), (xr / norm).T @ yr) / norm[:, None]


def fraction(y, x, n, share):
    """Plain coordinates shrunk until their norm has this share, by bisection on the penalty in the coefficients' own form."""
    yr, xr = off(y, n), off(x, n)
    plain = np.linalg.lstsq(xr, yr, rcond=None)[0]
    out = plain.copy()
    for i in range(y.shape[1] if share < 1 else 0):

        def norm(t, i=i):
            b = np.linalg.solve(xr.T @ xr + np.exp(t) * np.eye(xr.shape[1]), xr.T @ yr[:, i])
            return np.linalg.norm(b) / np.linalg.norm(plain[:, i]) - share

        low, high = -30.0, 30.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if norm(middle) > 0 else (low, middle)
        out[:, i] = np.linalg.solve(xr.T @ xr + np.exp(low) * np.eye(xr.shape[1]), xr.T @ yr[:, i])
    return out


def coefs_of(frame, features, r):
    part = frame[frame["run"] == r].pivot(index="trial", columns="feature", values="coef")
    return part[features].to_numpy(float)


def test_trials(y, result):
    x, ns = Q._trials()[0], Q.nuisances()
    total = np.zeros((3, len(y[1])))
    for r in RUNS:
        v = y[0][r]
        same(coefs_of(result("trial_ols"), y[1], r), ridge(v, x, ns[r], 0.0), 1e-4)
        same(coefs_of(result("trial_ridge"), y[1], r), ridge(v, x, ns[r], 0.5), 1e-4)
        same(coefs_of(result("fractional_ridge"), y[1], r), fraction(v, x, ns[r], 0.6), 1e-4)
        apart = [np.linalg.lstsq(np.column_stack([x[:, j], x.sum(1) - x[:, j], ns[r]]), v, rcond=None)[0][0] for j in range(x.shape[1])]
        same(coefs_of(result("trial_separate"), y[1], r), apart, 1e-4)
        b = ridge(v, x, ns[r], 0.5)
        total += [(off(v - x @ b, ns[r]) ** 2).sum(0), (off(v, ns[r]) ** 2).sum(0), ((v - v.mean(0)) ** 2).sum(0)]
    rows = result("trial_r2", "feature").loc[y[1]]
    same(rows["full_r2"], 1 - total[0] / total[2])
    same(rows["delta_r2"], (total[1] - total[0]) / total[2])


def encode(train, test):
    """R2 of test coefficients by slopes from rows centred in each training run; (coefficients, predictors) of each run."""

    def mid(a):
        return a - a.mean(0)

    slope = np.linalg.lstsq(np.concatenate([mid(p) for _, p in train]), np.concatenate([mid(b) for b, _ in train]), rcond=None)[0]
    return 1 - sum((mid(b - p @ slope) ** 2).sum(0) for b, p in test) / sum((mid(b) ** 2).sum(0) for b, _ in test)


def test_encoding_and_penalties(y, result):
    x, ns, ps = Q._trials()[0], Q.nuisances(), Q._predictors()
    plain = {r: ridge(y[0][r], x, ns[r], 0.0) for r in RUNS}
    same(result("encode_trials", "feature").loc[y[1]]["r2"], encode([(plain[r], ps[r]) for r in (0, 2, 4)], [(plain[r], ps[r]) for r in (1, 3, 5)]))

    def scores(grid, betas, target):
        out = []
        for g in grid:
            b = {r: betas(r, g) for r in RUNS}
            out.append(np.mean([encode([(b[r], ps[r]) for r in RUNS if r != h], [(target(h, b), ps[h])]) for h in RUNS], axis=0))
        return np.array(out)

    alphas = [0.0, 0.1, 1.0, 10.0]
    table = scores(alphas, lambda r, a: ridge(y[0][r], x, ns[r], a), lambda h, b: b[h])
    objective = np.percentile(table, 90, axis=1)
    got = result("ridge_cv").iloc[0]
    assert got["penalty"] == alphas[int(np.argmax(objective))]
    same(got["objective"], objective.max(), 1e-6)
    shares = [0.2, 0.5, 0.8, 1.0]
    table = scores(shares, lambda r, f: fraction(y[0][r], x, ns[r], f), lambda h, b: plain[h])
    rows = result("fraction_cv", "feature").loc[y[1]]
    assert rows["penalty"].tolist() == [shares[i] for i in table.argmax(0)]
    same(rows["score"], table.max(0), 1e-6)


@pytest.mark.parametrize("kind", ["ridge", "fraction"])
def test_nested_evaluation_looks_at_training_runs_only(y, result, kind):
    ns, ps = Q.nuisances(), Q._predictors()
    grid = [0.0, 1.0, 10.0] if kind == "ridge" else [0.3, 0.6, 1.0]
    fit, none = (ridge, 0.0) if kind == "ridge" else (fraction, 1.0)
    xs = [t[0] for t in Q._each_trials().values()]
    held = {}

    def betas(r, kernels, value):
        key = r, tuple(kernels), tuple(np.atleast_1d(value))
        if key not in held:
            values = np.broadcast_to(value, len(kernels))
            held[key] = np.concatenate([fit(y[0][r][:, [i]], xs[k], ns[r], float(v)) for i, (k, v) in enumerate(zip(kernels, values, strict=True))], axis=1)
        return held[key]

    def kernels_of(runs):
        return np.array([loro(y[0], p, ns, runs) for p in Q.library().parameters]).argmax(0)

    def choose(runs):
        table = np.zeros((len(grid), len(y[1])))
        for h in runs:
            train = [r for r in runs if r != h]
            ks = kernels_of(train)
            for i, g in enumerate(grid):
                target = betas(h, ks, g if kind == "ridge" else none)
                table[i] += encode([(betas(r, ks, g), ps[r]) for r in train], [(target, ps[h])]) / len(runs)
        if kind == "ridge":
            return np.full(len(y[1]), grid[int(np.argmax(np.percentile(table, 90, axis=1)))])
        return np.array(grid)[table.argmax(0)]

    got = result(f"nested_{kind}", "direction", "feature")
    for name, train, test in (("odd_to_even", [1, 3, 5], [0, 2, 4]), ("even_to_odd", [0, 2, 4], [1, 3, 5])):
        ks, value = kernels_of(train), choose(train)
        rows = got.loc[name].loc[y[1]]
        assert rows["kernel"].tolist() == ks.tolist() and rows["penalty"].tolist() == value.tolist()
        want = encode([(betas(r, ks, value), ps[r]) for r in train], [(betas(r, ks, value if kind == "ridge" else none), ps[r]) for r in test])
        same(rows["r2"], want, 1e-6)
    if kind == "fraction":
        ks, value = kernels_of(list(RUNS)), choose(list(RUNS))
        for r in RUNS:
            same(coefs_of(result("nested_refit"), y[1], r), betas(r, ks, value), 1e-4)


def restricted(y, xs, zs, ratio):
    """-2 log restricted likelihood over runs, the noise variance profiled out, but for a constant."""
    quad, logs, dof = 0.0, 0.0, 0
    for v, x, z in zip(y, xs, zs, strict=True):
        u, s, _ = np.linalg.svd(x, full_matrices=True)
        free = u[:, int((s > s[0] * 1e-10).sum()) :]
        cov = np.eye(free.shape[1]) + ratio * (free.T @ z) @ (free.T @ z).T
        e = free.T @ v
        quad += e @ np.linalg.solve(cov, e)
        logs += np.linalg.slogdet(cov)[1]
        dof += free.shape[1]
    return dof * np.log(quad / dof) + logs


def test_variance_components(y, result):
    rows = result("reml_fit", "feature").loc[y[1]]
    xs = [d.matrix for d in Q.designs().values()]
    zs = [Q._trials()[r] for r in RUNS]
    for i in range(len(y[1])):
        v = [y[0][r][:, i] for r in RUNS]
        ratio = float(rows["ratio"].iloc[i])
        here = restricted(v, xs, zs, ratio)
        steps = [ratio * f for f in (0.8, 1.25)] if ratio > 0 else [1e-4]
        assert all(here <= restricted(v, xs, zs, s) + 1e-6 for s in [*steps, 0.0])


def test_random_design_diagnostics(result):
    rows = result("reml_diagnostics").dropna(subset=["winner"])
    chosen = result("reml_select", "feature")
    assert (rows["delta_criterion"] >= -1e-6).all() and len(rows) == len(chosen.dropna(subset=["winner"]))
    for r in rows.itertuples():
        assert chosen.loc[r.feature]["winner"] == r.winner
        assert r.winner != 0 or abs(r.delta_criterion) < 1e-5


def test_components(y, result):
    ns, comps = Q.nuisances(), {}
    for r in RUNS:
        rest = off(y[0][r], ns[r])
        rest = rest[:, np.sqrt((rest**2).sum(0)) > 1e-9]
        comps[r] = np.linalg.svd(rest / np.sqrt((rest**2).sum(0)), full_matrices=False)[0]
    got = result("noise_components", "run", "component")
    for r in RUNS:
        for k in range(3):
            same(got.loc[(r, k)]["peak"], np.abs(comps[r][:, k]).max(), 1e-5)
    tasks = {r: t for r, (t, _) in Q._task().items()}
    scores, folds = result("component_scores", "count", "feature"), result("component_fold_scores", "fold", "count")
    for count in range(3):
        full = {r: np.column_stack([ns[r], comps[r][:, :count]]) for r in RUNS}
        energy = {r: (off(y[0][r], ns[r]) ** 2).sum(0) for r in RUNS}
        lost = {h: held_out(y[0], tasks, full, [r for r in RUNS if r != h], [h])[0] for h in RUNS}
        same(scores.loc[count].loc[y[1]]["score"], 1 - sum(lost.values()) / sum(energy.values()), 1e-6)
        for h in RUNS:
            same(folds.loc[(h, count)]["score"], np.median(1 - lost[h] / energy[h]), 1e-6)
