"""Dense estimators on blocks of features: designs are broadcast, signals stay in place.

A packed signal has one row for each run and feature (run, feature, y array by scan). Blocks are made by a hash of the feature, so they are even
whatever kernel or group a feature belongs to; all runs of a feature are in its block. Results do not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import estimators as E
from ripplemark.plans.design import some_runs
from ripplemark.sources.ship import ship

#: Features of a block, about.
BLOCK = 4096
Signals = dict[int, np.ndarray]
BlockFunction = Callable[[list, Signals, Any], pd.DataFrame]


def by_block(packed: DataFrame, function: BlockFunction, schema: str, shared: Any = None, block: int = BLOCK) -> DataFrame:
    """function(features, {run: scans x features}, shared) on every block. Features that lack a run, or have a run of another length, raise."""
    spark = packed.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(shared)
    n = packed.select("feature").distinct().count()
    blocks = max(1, -(-n // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        features = sorted(pdf["feature"].unique().tolist())
        signals = {}
        for r, part in pdf.groupby("run", sort=True):
            rows = dict(zip(part["feature"], part["y"], strict=True))
            if len(rows) != len(features) or len(part) != len(features) or len({len(v) for v in rows.values()}) != 1:
                raise ValueError("every run holds every feature once, with as many scans")
            signals[int(r)] = np.array([rows[f] for f in features], float).T
            if not np.isfinite(signals[int(r)]).all():
                raise ValueError("signals are finite")
        return function(features, signals, sent.value)

    dealt = packed.select("run", "feature", "y", F.pmod(F.xxhash64("feature"), F.lit(blocks)).alias("block"))
    out = dealt.groupBy("block").applyInPandas(lambda pdf: run(pdf.drop(columns="block")), schema)
    # undefined is null in tables
    return out.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


def _long(features: Sequence, columns: Mapping[str, np.ndarray], **constant) -> pd.DataFrame:
    return pd.DataFrame({"feature": features, **constant, **columns})


def _kind(packed: DataFrame) -> str:
    return dict(packed.dtypes)["feature"]


# -- linear models --


def fit_glm(packed: DataFrame, designs: Mapping[int, np.ndarray], contrasts: Mapping[str, Mapping[int, np.ndarray]], noise: str = "ols", block: int = BLOCK) -> DataFrame:
    """feature, contrast, effect, variance, t, z, p, dof, r2. contrasts: name to the vector of each run."""
    names = list(contrasts)

    def run(features, signals, shared):
        xs, cs = shared
        fits = [E.fit_run(y, xs[r], np.array([cs[n][r] for n in names]), noise) for r, y in signals.items()]
        out = E.combine_runs(fits)
        parts = [_long(features, {k: (v if v.ndim == 1 else v[i]) for k, v in out.items()}, contrast=n) for i, n in enumerate(names)]
        return pd.concat(parts)[["feature", "contrast", "effect", "variance", "t", "z", "p", "dof", "r2"]].astype({"dof": float})

    schema = f"feature {_kind(packed)}, contrast string, effect double, variance double, t double, z double, p double, dof double, r2 double"
    return by_block(packed, run, schema, (dict(designs), {n: dict(v) for n, v in contrasts.items()}), block)


def run_effects(packed: DataFrame, designs: Mapping[int, np.ndarray], contrast: Mapping[int, np.ndarray], noise: str = "ols", block: int = BLOCK) -> DataFrame:
    """run, feature, effect, variance, dof, sse, sst of one contrast."""

    def run(features, signals, shared):
        xs, cs = shared
        parts = []
        for r, y in signals.items():
            f = E.fit_run(y, xs[r], np.array([cs[r]]), noise)
            gone = f.sst <= 0
            parts.append(_long(features, {"effect": np.where(gone, np.nan, f.effects[0]), "variance": np.where(gone, np.nan, f.variances[0]), "dof": np.full(len(features), float(f.dof)), "sse": f.sse, "sst": f.sst}, run=r))
        return pd.concat(parts)[["run", "feature", "effect", "variance", "dof", "sse", "sst"]]

    return by_block(packed, run, f"run int, feature {_kind(packed)}, effect double, variance double, dof double, sse double, sst double", (dict(designs), dict(contrast)), block)


def task_delta_r2(packed: DataFrame, full: Mapping[int, np.ndarray], nuisance: Mapping[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """feature, full_r2, nuisance_r2, delta_r2."""

    def run(features, signals, shared):
        a, b = shared
        return _long(features, E.nested_gain(list(signals.values()), [a[r] for r in signals], [b[r] for r in signals]))

    return by_block(packed, run, f"feature {_kind(packed)}, full_r2 double, nuisance_r2 double, delta_r2 double", (dict(full), dict(nuisance)), block)


def fit_selected(packed: DataFrame, kernels: DataFrame, designs: Mapping[int, Mapping[int, np.ndarray]], contrasts: Mapping[str, Mapping[int, np.ndarray]], noise: str = "ols", block: int = BLOCK) -> DataFrame:
    """fit_glm with the design of each feature's kernel (kernels: feature, kernel). designs: kernel to run to matrix. Features without a kernel are undefined."""
    names = list(contrasts)
    kind = _kind(packed)
    rows = packed.join(kernels.select("feature", F.col("kernel").cast("double").alias("k")), "feature", "left").select("run", "feature", F.concat(F.array(F.coalesce("k", F.lit(-1.0))), "y").alias("y"))

    def run(features, signals, shared):
        xs, cs = shared
        first = next(iter(signals.values()))
        own = first[0].astype(int)
        parts = []
        for k in np.unique(own):
            cols = np.flatnonzero(own == k)
            some = [features[i] for i in cols]
            if k < 0:
                empty = np.full(len(some), np.nan)
                parts += [_long(some, dict.fromkeys(("effect", "variance", "t", "z", "p", "dof", "r2"), empty), contrast=n) for n in names]
                continue
            fits = [E.fit_run(y[1:, cols], xs[int(k)][r], np.array([cs[n][r] for n in names]), noise) for r, y in signals.items()]
            out = E.combine_runs(fits)
            parts += [_long(some, {c: (v if v.ndim == 1 else v[i]) for c, v in out.items()}, contrast=n) for i, n in enumerate(names)]
        return pd.concat(parts)[["feature", "contrast", "effect", "variance", "t", "z", "p", "dof", "r2"]].astype({"dof": float})

    schema = f"feature {kind}, contrast string, effect double, variance double, t double, z double, p double, dof double, r2 double"
    return by_block(rows, run, schema, ({k: dict(v) for k, v in designs.items()}, {n: dict(v) for n, v in contrasts.items()}), block)


# -- AR(1) --


def lag_estimates(packed: DataFrame, designs: Mapping[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """run, feature, raw, rho: residual lag ratio and its value corrected for the projection."""
    curves = {r: E.expected_lag_ratio(x) for r, x in designs.items()}

    def run(features, signals, shared):
        xs, expected = shared
        parts = []
        for r, y in signals.items():
            q = E.basis(xs[r])
            raw = E.lag_ratio(y - q @ (q.T @ y), (y**2).sum(axis=0))
            parts.append(_long(features, {"raw": raw, "rho": E.invert_lag_ratio(raw, expected[r])}, run=r))
        return pd.concat(parts)[["run", "feature", "raw", "rho"]]

    return by_block(packed, run, f"run int, feature {_kind(packed)}, raw double, rho double", (dict(designs), curves), block)


def pooled_rho(estimates: DataFrame, low: float = E.RHO_RANGE[0], high: float = E.RHO_RANGE[1]) -> DataFrame:
    """rho, at_bound: median over runs and features within the range; 0 if there is none."""
    middle = estimates.agg(F.median("rho").alias("m"))
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("m")))
    return middle.select(F.coalesce(clipped, F.lit(0.0)).alias("rho"), F.coalesce((clipped == low) | (clipped == high), F.lit(False)).alias("at_bound"))


# -- kernels --


def candidate_scores(packed: DataFrame, runs: Mapping[int, E.CandidateRun], train: Sequence[int] | None = None, test: Sequence[int] | None = None, block: int = BLOCK) -> DataFrame:
    """candidate, feature, score: leave one run out, or one split; null where a candidate or feature has no score."""

    def run(features, signals, shared):
        order = sorted(signals)
        parts = [E.candidate_sums(shared[r], signals[r]) for r in order]
        where = {r: i for i, r in enumerate(order)}
        scores = E.held_out_scores(parts, None if train is None else [where[r] for r in train], None if test is None else [where[r] for r in test])
        scores = np.where(np.isfinite(scores), scores, np.nan)
        return pd.concat([_long(features, {"score": s}, candidate=i) for i, s in enumerate(scores)])[["candidate", "feature", "score"]]

    return by_block(packed, run, f"candidate int, feature {_kind(packed)}, score double", dict(runs), block)


def select_kernels(packed: DataFrame, runs: Mapping[int, E.CandidateRun], block: int = BLOCK) -> DataFrame:
    """feature, kernel, score, canonical_score, delta: the best candidate by prediction of held-out runs (kernel null if none)."""

    def run(features, signals, shared):
        scores = E.held_out_scores([E.candidate_sums(shared[r], signals[r]) for r in sorted(signals)])
        best = E.best_candidates(scores)
        cols = np.arange(len(features))
        score = np.where(best >= 0, scores[np.maximum(best, 0), cols], np.nan)
        canonical = np.where(np.isfinite(scores[0]), scores[0], np.nan)
        return _long(features, {"kernel": pd.array(np.where(best >= 0, best, -1)), "score": score, "canonical_score": canonical, "delta": score - canonical})

    out = by_block(packed, run, f"feature {_kind(packed)}, kernel int, score double, canonical_score double, delta double", dict(runs), block)
    return out.withColumn("kernel", F.when(F.col("kernel") >= 0, F.col("kernel")))


# -- one coefficient for each event --


def trial_coefficients(packed: DataFrame, trials: Mapping[int, np.ndarray], nuisance: Mapping[int, np.ndarray], alpha: float = 0.0, fraction: float | None = None, separate: bool = False, block: int = BLOCK) -> DataFrame:
    """run, trial, feature, coef of every event: least squares, ridge on unit-norm columns, a fraction of the plain norm, or each trial apart."""

    def run(features, signals, shared):
        xs, ns = shared
        parts = []
        for r, y in signals.items():
            if separate:
                betas = np.where(np.ptp(y, axis=0) > 0, E.separate_trials(xs[r], ns[r], y), np.nan)
            else:
                path = E.TrialPath.of(xs[r], ns[r], fraction is None)
                betas = path.ridge(y, alpha) if fraction is None else path.fractional(y, fraction)[0]
            n = len(betas)
            parts.append(pd.DataFrame({"run": r, "trial": np.repeat(np.arange(n), len(features)), "feature": features * n, "coef": betas.ravel()}))
        return pd.concat(parts)

    return by_block(packed, run, f"run int, trial int, feature {_kind(packed)}, coef double", (dict(trials), dict(nuisance)), block)


def trial_r2(packed: DataFrame, trials: Mapping[int, np.ndarray], nuisance: Mapping[int, np.ndarray], alpha: float = 0.0, block: int = BLOCK) -> DataFrame:
    """feature, full_r2, nuisance_r2, delta_r2 of trial models, pooled over runs."""

    def run(features, signals, shared):
        xs, ns = shared
        total = np.zeros((3, len(features)))
        for r, y in signals.items():
            path = E.TrialPath.of(xs[r], ns[r], True)
            total += np.array(E.trial_sums(xs[r], ns[r], path, y, path.ridge(y, alpha)))
        full, null = 1 - E.ratio(total[0], total[2]), 1 - E.ratio(total[1], total[2])
        return _long(features, {"full_r2": full, "nuisance_r2": null, "delta_r2": full - null})

    return by_block(packed, run, f"feature {_kind(packed)}, full_r2 double, nuisance_r2 double, delta_r2 double", (dict(trials), dict(nuisance)), block)


def encode_coefficients(coefs: DataFrame, predictors: Mapping[int, np.ndarray], train: Sequence[int], test: Sequence[int], mode: str = "within_run", block: int = BLOCK) -> DataFrame:
    """feature, r2, slope_0 (mean), slope_1 and so on: events' coefficients (run, trial, feature, coef) predicted from predictors."""
    width = next(iter(predictors.values())).shape[1]
    packed = coefs.groupBy("run", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("trial", F.coalesce("coef", F.lit(float("nan"))).alias("c")))), lambda p: p["c"]).alias("y"))

    def run(features, signals, shared):
        order = sorted(signals)
        where = {r: i for i, r in enumerate(order)}
        e = E.encode([signals[r] for r in order], [shared[r] for r in order], [where[r] for r in train], [where[r] for r in test], mode)
        return _long(features, {"r2": e.r2, **{f"slope_{i}": c for i, c in enumerate(e.coefficients)}})

    schema = f"feature {_kind(packed)}, r2 double, " + ", ".join(f"slope_{i} double" for i in range(width + 1))
    return _by_block_nan(packed, run, schema, dict(predictors), block)


def _by_block_nan(packed: DataFrame, function: BlockFunction, schema: str, shared: Any, block: int) -> DataFrame:
    """by_block for values that may be undefined."""
    spark = packed.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(shared)
    n = packed.select("feature").distinct().count()
    blocks = max(1, -(-n // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        features = sorted(pdf["feature"].unique().tolist())
        signals = {int(r): np.array([dict(zip(p["feature"], p["y"], strict=True))[f] for f in features], float).T for r, p in pdf.groupby("run")}
        return function(features, signals, sent.value)

    out = packed.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(blocks))).groupBy("block").applyInPandas(lambda p: run(p.drop(columns="block")), schema)
    return out.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


# -- penalties --


def penalty_scores(packed: DataFrame, trials: Mapping[int, np.ndarray], nuisance: Mapping[int, np.ndarray], predictors: Mapping[int, np.ndarray], grid: Sequence[float], kind: str = "ridge", mode: str = "within_run",
                   candidates: Mapping[int, E.CandidateRun] | None = None, kernel_trials: Mapping[int, Mapping[int, np.ndarray]] | None = None, block: int = BLOCK) -> DataFrame:
    """penalty, feature, score: mean over held-out runs of the R2 with which the other runs' coefficients predict the run's, on fixed targets.

    With candidates, each fold chooses kernels from its training runs only, and takes each feature's trial design from kernel_trials (kernel to run to matrix).
    Ridge targets are coefficients at the same penalty; fractions are scored against unpenalised ones.
    """
    if kind not in ("ridge", "fraction"):
        raise ValueError("kind is ridge or fraction")

    def run(features, signals, shared):
        xs, ns, ps, cand, kx = shared
        order = sorted(signals)
        n = len(features)

        def betas(r: int, kernels: np.ndarray, value: float) -> np.ndarray:
            out = np.full((xs[r].shape[1], n), np.nan)
            for k in np.unique(kernels[kernels >= 0]):
                cols = np.flatnonzero(kernels == k)
                x = xs[r] if kx is None else kx[int(k)][r]
                path = E.TrialPath.of(x, ns[r], kind == "ridge")
                y = signals[r][:, cols]
                out[:, cols] = path.ridge(y, value) if kind == "ridge" else path.fractional(y, value)[0]
            return out

        sums_ = {r: E.candidate_sums(cand[r], signals[r]) for r in order} if cand is not None else {}
        scores = np.zeros((len(grid), n))
        for held in order:
            train = [r for r in order if r != held]
            kernels = np.zeros(n, int)
            if cand is not None:
                kernels = E.best_candidates(E.held_out_scores([sums_[r] for r in train]))
            plain = betas(held, kernels, 1.0 if kind == "fraction" else 0.0)
            for i, value in enumerate(grid):
                data = [betas(r, kernels, value) for r in train] + [plain if kind == "fraction" else betas(held, kernels, value)]
                e = E.encode(data, [ps[r] for r in train] + [ps[held]], list(range(len(train))), [len(train)], mode)
                scores[i] += e.r2 / len(order)
        return pd.concat([_long(features, {"score": s}, penalty=float(v)) for v, s in zip(grid, scores, strict=True)])[["penalty", "feature", "score"]]

    shared = (dict(trials), dict(nuisance), dict(predictors), dict(candidates) if candidates is not None else None, None if kernel_trials is None else some_runs(kernel_trials, sorted(trials)))
    return by_block(packed, run, f"penalty double, feature {_kind(packed)}, score double", shared, block)


# -- variance components --


def variance_components(packed: DataFrame, fixed: Mapping[int, np.ndarray], random: Mapping[int, np.ndarray], rho: float = 0.0, block: int = BLOCK) -> DataFrame:
    """feature, ratio, noise_variance, random_variance, criterion, at_upper, status."""

    def run(features, signals, shared):
        xs, zs = shared
        t = E.pool_terms([E.reml_terms(signals[r], xs[r], zs[r], rho) for r in sorted(signals)])
        return _long(features, E.reml_fit(t))

    return by_block(packed, run, f"feature {_kind(packed)}, ratio double, noise_variance double, random_variance double, criterion double, at_upper boolean, status string", (dict(fixed), dict(random)), block)


def select_random_design(packed: DataFrame, fixed: Mapping[int, np.ndarray], designs: Sequence[Mapping[int, np.ndarray]], rho: float = 0.0, block: int = BLOCK) -> DataFrame:
    """feature, winner, criterion, gap, ratio: which random design the restricted likelihood prefers."""

    def run(features, signals, shared):
        xs, zs = shared
        terms = [E.pool_terms([E.reml_terms(signals[r], xs[r], z[r], rho) for r in sorted(signals)]) for z in zs]
        out = E.reml_select(terms)
        return _long(features, out | {"winner": out["winner"].astype(int)})

    out = by_block(packed, run, f"feature {_kind(packed)}, winner int, criterion double, gap double, ratio double", (dict(fixed), [dict(z) for z in designs]), block)
    return out.withColumn("winner", F.when(F.col("winner") >= 0, F.col("winner")))


# -- noise components --


def noise_components(packed: DataFrame, pool: DataFrame, nuisance: Mapping[int, np.ndarray], most: int = 10, block: int = BLOCK) -> dict[int, np.ndarray]:
    """run to scans x components: principal components of the pool's features (pool: feature).

    Each block sums its scan x scan products; the sums of blocks are added in a tree, so no task holds more than a few of them.
    """
    spark = packed.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(dict(nuisance))
    rows = packed.join(pool.select("feature"), "feature", "left_semi")
    n = max(1, rows.select("feature").distinct().count())
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(max(1, -(-n // block)))))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        r, b = int(pdf["run"].iloc[0]), int(pdf["block"].iloc[0])
        gram, _, kept = E.pool_gram(np.array(pdf["y"].tolist(), float).T, sent.value[r])
        return pd.DataFrame({"run": [r], "block": [b], "gram": [gram.tobytes()], "kept": [kept]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g) for g in pdf["gram"])
        return pd.DataFrame({"run": [int(pdf["run"].iloc[0])], "block": [int(pdf["block"].iloc[0]) // 16], "gram": [np.asarray(total).tobytes()], "kept": [int(pdf["kept"].sum())]})

    schema = "run int, block long, gram binary, kept long"
    grams = dealt.groupBy("run", "block").applyInPandas(part, schema)
    blocks = max(1, -(-n // block))
    while blocks > 1:
        grams = grams.withColumn("next", F.floor(F.col("block") / 16)).groupBy("run", "next").applyInPandas(lambda p: add(p), schema)
        blocks = -(-blocks // 16)
    out = {}
    for r in grams.collect():  # one matrix of scans x scans for each run
        size = int(round(len(r["gram"]) / 8) ** 0.5)
        out[r["run"]] = E.gram_components(np.frombuffer(r["gram"]).reshape(size, size), most)
    return out


def component_scores(packed: DataFrame, runs: Mapping[int, tuple[np.ndarray, np.ndarray]], components: Mapping[int, np.ndarray], counts: Sequence[int], block: int = BLOCK) -> DataFrame:
    """count, feature, score: R2 of held-out runs, with so many components among the nuisance. runs: run to (task, nuisance)."""

    def run(features, signals, shared):
        designs, comps = shared
        order = sorted(signals)
        out = []
        for count in counts:
            prepared = []
            for r in order:
                task, nuisance = designs[r]
                c = E.candidate_run(np.column_stack([nuisance, comps[r][:, :count]]), [task])
                a, b, cc, _ = E.candidate_sums(c, signals[r])
                base = E.project_out(signals[r], E.basis(nuisance, normalise=False))
                prepared.append((a, b, cc, (base**2).sum(axis=0)))
            # the target energy is that without components, so counts compare on the same scale
            score = E.held_out_scores(prepared)[0]
            out.append(_long(features, {"score": np.where(np.isfinite(score), score, np.nan)}, count=count))
        return pd.concat(out)[["count", "feature", "score"]]

    return by_block(packed, run, f"count int, feature {_kind(packed)}, score double", (dict(runs), dict(components)), block)


def component_fold_scores(packed: DataFrame, runs: Mapping[int, tuple[np.ndarray, np.ndarray]], components: Mapping[int, np.ndarray], counts: Sequence[int], block: int = BLOCK) -> DataFrame:
    """fold (the run held out), count, features, score: median over features of that run's R2, for each number of components."""

    def run(features, signals, shared):
        designs, comps = shared
        order = sorted(signals)
        out = []
        for count in counts:
            prepared = []
            for r in order:
                task, nuisance = designs[r]
                a, b, c, _ = E.candidate_sums(E.candidate_run(np.column_stack([nuisance, comps[r][:, :count]]), [task]), signals[r])
                base = E.project_out(signals[r], E.basis(nuisance, normalise=False))
                prepared.append((a, b, c, (base**2).sum(axis=0)))
            for i, held in enumerate(order):
                score = E.held_out_scores(prepared, [j for j in range(len(order)) if j != i], [i])[0]
                out.append(_long(features, {"score": np.where(np.isfinite(score), score, np.nan)}, fold=held, count=count))
        return pd.concat(out)[["fold", "count", "feature", "score"]]

    each = by_block(packed, run, f"fold int, count int, feature {_kind(packed)}, score double", (dict(runs), dict(components)), block)
    return each.groupBy("fold", "count").agg(F.count("score").alias("features"), F.median("score").alias("score"))


def component_tests(packed: DataFrame, runs: Mapping[int, tuple[np.ndarray, np.ndarray]], components: Mapping[int, np.ndarray], count: int, noise: str = "ar1", block: int = BLOCK) -> DataFrame:
    """feature, f, p: whether the components explain more than the model without them, pooled over runs; AR(1)-filtered by each feature's run coefficient if asked for."""

    def run(features, signals, shared):
        designs, comps = shared
        small, full = np.zeros((2, len(features)))
        df1 = df2 = 0
        for r in sorted(signals):
            task, nuisance = designs[r]
            y = signals[r]
            x0 = np.column_stack([task, nuisance])
            x1 = np.column_stack([x0, comps[r][:, :count]])
            q1 = E.basis(x1)
            df1 += q1.shape[1] - E.basis(x0).shape[1]
            df2 += len(y) - q1.shape[1]
            rho = E.yule_walker(y - q1 @ (q1.T @ y)) if noise == "ar1" else np.zeros(y.shape[1])
            for value in np.unique(rho):
                cols = np.flatnonzero(rho == value)
                yw = E._ar_filter(y[:, cols], value)
                for x, total in ((x0, small), (x1, full)):
                    q = E.basis(E._ar_filter(x, value))
                    total[cols] += ((yw - q @ (q.T @ yw)) ** 2).sum(axis=0)
        if df1 <= 0:
            f = p = np.full(len(features), np.nan)
        else:
            f, p = E.nested_f(small, full, df1, df2)
        return _long(features, {"f": f, "p": p})

    return by_block(packed, run, f"feature {_kind(packed)}, f double, p double", (dict(runs), dict(components)), block)
