"""Estimators with a value for each feature: its kernel, its fraction, its noise coefficient."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import dense as B
from ripplemark.operators import estimators as E
from ripplemark.plans.design import some_runs


def with_values(packed: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """The packed signal with each feature's values (absent: NaN) before its scans, so that they reach its block with it."""
    head = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names))
    return packed.join(values.select("feature", *names), "feature", "left").select("run", "feature", F.concat(head, "y").alias("y"))


def _unpack(packed: DataFrame, values: DataFrame, names: Sequence[str], function: B.BlockFunction, schema: str, shared, block: int) -> DataFrame:
    def run(features, signals, sent):
        first = next(iter(signals.values()))
        own = {n: first[i] for i, n in enumerate(names)}
        return function(features, {r: y[len(names) :] for r, y in signals.items()}, (own, sent))

    return B._by_block_nan(with_values(packed, values, names), run, schema, shared, block)


def selected_trials(packed: DataFrame, picks: DataFrame, kernel_trials: Mapping[int, Mapping[int, np.ndarray]], nuisance: Mapping[int, np.ndarray], alpha: float = 0.0, block: int = B.BLOCK) -> DataFrame:
    """run, trial, feature, coef with the trial design of each feature's kernel.

    picks: feature, kernel and, if coefficients are to have a fraction of the plain norm, fraction. Features without a kernel or fraction are undefined.
    """
    names = ["kernel", *(["fraction"] if "fraction" in picks.columns else [])]

    def run(features, signals, given):
        own, (xs, ns) = given
        width = {r: next(iter(xs.values()))[r].shape[1] for r in signals}
        out = {r: np.full((width[r], len(features)), np.nan) for r in signals}
        for k in np.unique(own["kernel"][np.isfinite(own["kernel"])]):
            cols = np.flatnonzero(own["kernel"] == k)
            for r, y in signals.items():
                path = E.TrialPath.of(xs[int(k)][r], ns[r], "fraction" not in own)
                out[r][:, cols] = path.fractional(y[:, cols], own["fraction"][cols])[0] if "fraction" in own else path.ridge(y[:, cols], alpha)
        return pd.concat([pd.DataFrame({"run": r, "trial": np.repeat(np.arange(len(v)), len(features)), "feature": features * len(v), "coef": v.ravel()}) for r, v in out.items()])

    shared = (some_runs(kernel_trials, sorted(nuisance)), dict(nuisance))
    return _unpack(packed, picks, names, run, f"run int, trial int, feature {dict(packed.dtypes)['feature']}, coef double", shared, block)


def selected_delta_r2(packed: DataFrame, kernels: DataFrame, full: Mapping[int, Mapping[int, np.ndarray]], nuisance: Mapping[int, np.ndarray], block: int = B.BLOCK) -> DataFrame:
    """feature, full_r2, nuisance_r2, delta_r2 with the design of each feature's kernel (kernels: feature, kernel; full: kernel to run to matrix). Undefined without a kernel."""

    def run(features, signals, given):
        own, (xs, ns) = given
        out = {c: np.full(len(features), np.nan) for c in ("full_r2", "nuisance_r2", "delta_r2")}
        for k in np.unique(own["kernel"][np.isfinite(own["kernel"])]):
            cols = np.flatnonzero(own["kernel"] == k)
            found = E.nested_gain([signals[r][:, cols] for r in sorted(signals)], [xs[int(k)][r] for r in sorted(signals)], [ns[r] for r in sorted(signals)])
            for c, v in found.items():
                out[c][cols] = v
        return pd.DataFrame({"feature": features, **out})

    schema = f"feature {dict(packed.dtypes)['feature']}, full_r2 double, nuisance_r2 double, delta_r2 double"
    return _unpack(packed, kernels, ["kernel"], run, schema, ({k: dict(v) for k, v in full.items()}, dict(nuisance)), block)


def random_design_diagnostics(packed: DataFrame, fixed: Mapping[int, np.ndarray], designs: Sequence[Mapping[int, np.ndarray]], rho: float = 0.0, reference: int = 0, block: int = B.BLOCK) -> DataFrame:
    """feature, winner, criterion, reference_criterion, delta_criterion, ratio, reference_ratio, reference_status: what the preferred random design gains over a reference one."""
    best = B.select_random_design(packed, fixed, designs, rho, block)
    plain = B.variance_components(packed, fixed, designs[reference], rho, block)
    plain = plain.select("feature", F.col("criterion").alias("reference_criterion"), F.col("ratio").alias("reference_ratio"), F.col("status").alias("reference_status"))
    both = best.join(plain, "feature").withColumn("delta_criterion", F.col("reference_criterion") - F.col("criterion"))
    return both.select("feature", "winner", "criterion", "reference_criterion", "delta_criterion", "ratio", "reference_ratio", "reference_status")


def variance_components_by_rho(packed: DataFrame, rhos: DataFrame, fixed: Mapping[int, np.ndarray], random: Mapping[int, np.ndarray], block: int = B.BLOCK) -> DataFrame:
    """feature, ratio, noise_variance, random_variance, criterion, status with each feature's own AR(1) coefficient (rhos: feature, rho)."""

    def run(features, signals, given):
        own, (xs, zs) = given
        parts = []
        for rho in np.unique(own["rho"][np.isfinite(own["rho"])]):
            cols = np.flatnonzero(own["rho"] == rho)
            fit = E.reml_fit(E.pool_terms([E.reml_terms(signals[r][:, cols], xs[r], zs[r], float(rho)) for r in sorted(signals)]))
            parts.append(pd.DataFrame({"feature": [features[i] for i in cols], **{k: fit[k] for k in ("ratio", "noise_variance", "random_variance", "criterion", "status")}}))
        gone = np.flatnonzero(~np.isfinite(own["rho"]))
        parts.append(pd.DataFrame({"feature": [features[i] for i in gone], "ratio": np.nan, "noise_variance": np.nan, "random_variance": np.nan, "criterion": np.nan, "status": "no_rho"}))
        return pd.concat([p for p in parts if len(p)])

    schema = f"feature {dict(packed.dtypes)['feature']}, ratio double, noise_variance double, random_variance double, criterion double, status string"
    return _unpack(packed, rhos, ["rho"], run, schema, (dict(fixed), dict(random)), block)


def eligibility(runs: Mapping[int, E.CandidateRun]) -> list[tuple[int, bool, str]]:
    """candidate, whether every run can estimate it, and why not."""
    out = []
    for c in range(len(next(iter(runs.values())).x)):
        reasons = []
        for r in sorted(runs):
            x = runs[r].x[c]
            rank = E.basis(x).shape[1] if np.any(x) else 0
            if rank < x.shape[1]:
                reasons.append(f"run {r}: {rank} of {x.shape[1]} columns are independent of the nuisance")
        out.append((c, not reasons, "; ".join(reasons)))
    return out


def decoding_accuracy(df: DataFrame, fold: str, label: str, vector: str, rounds: int = 10) -> DataFrame:
    """fold, accuracy, n: a linear support vector classifier for each label against the rest, fitted on the other folds (folds are a caller's few)."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(fold).alias("fold"), F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    out = None
    for f in folds:
        model = OneVsRest(classifier=LinearSVC(maxIter=rounds)).fit(rows.where(F.col("fold") != f))
        part = model.transform(rows.where(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n")).select(F.lit(f).alias("fold"), "accuracy", "n")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there are no folds")
    found = out.collect()  # one row for each fold
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, out.schema)
