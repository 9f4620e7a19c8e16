"""Nested evaluation: kernels and penalties are chosen within the training runs, and judged on runs that took no part in any choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import dense as B
from ripplemark.operators import estimators as E
from ripplemark.operators import picks as P
from ripplemark.operators.selected import selected_trials
from ripplemark.plans.design import some_runs


@dataclass(frozen=True)
class Problem:
    """What tuning reads but the signal: trial designs of every kernel (kernel to run to matrix), nuisance and predictors by run, the grid.

    candidates: projected candidate designs by run, or None to use kernel 0 for every feature. kind: ridge (one penalty for all
    features) or fraction (one for each).
    """

    trials: Mapping[int, Mapping[int, np.ndarray]]
    nuisance: Mapping[int, np.ndarray]
    predictors: Mapping[int, np.ndarray]
    grid: Sequence[float]
    kind: str = "ridge"
    candidates: Mapping[int, E.CandidateRun] | None = None
    mode: str = "within_run"
    share: float = 0.9
    block: int = field(default=B.BLOCK)


@dataclass(frozen=True)
class Tuned:
    """picks: feature, kernel, penalty; alpha: the one penalty, or None for fractions; scores: those that the choice was made by."""

    picks: DataFrame
    alpha: float | None
    scores: DataFrame


def tune(packed: DataFrame, problem: Problem, runs: Sequence[int]) -> Tuned:
    """Kernels and penalties from these runs only; each fold chooses its kernels anew. Needs two runs, three with candidates."""
    p, chosen = problem, sorted(runs)
    if len(chosen) < (2 if p.candidates is None else 3):
        raise ValueError("tuning holds runs out: it needs two, and three to choose kernels within")
    some = packed.where(F.col("run").isin(chosen))

    def of(values: Mapping) -> dict:
        return {r: values[r] for r in chosen}

    own = None if p.candidates is None else of(p.candidates)
    each = None if own is None else some_runs(p.trials, chosen)
    scores = B.penalty_scores(some, of(p.trials[0]), of(p.nuisance), of(p.predictors), p.grid, p.kind, p.mode, own, each, p.block)
    kernels = some.select("feature").distinct().withColumn("kernel", F.lit(0)) if own is None else B.select_kernels(some, own, p.block).select("feature", "kernel")
    if p.kind == "fraction":
        best = P.best_fraction(scores, ["feature"], "penalty", "score").select("feature", "penalty")
        return Tuned(kernels.join(best, "feature", "left"), None, scores)
    best = P.best_penalty(scores, "feature", "penalty", "score", p.share).first()
    if best is None or best["penalty"] is None:
        raise ValueError("no feature is scored at every penalty")
    return Tuned(kernels.withColumn("penalty", F.lit(float(best["penalty"]))), float(best["penalty"]), scores)


def coefficients(packed: DataFrame, problem: Problem, tuned: Tuned) -> DataFrame:
    """run, trial, feature, coef of all runs of the signal at the tuned kernels and penalties."""
    runs = sorted(problem.nuisance)
    trials = some_runs(problem.trials, runs)
    picks = tuned.picks.select("feature", "kernel", *([F.col("penalty").alias("fraction")] if tuned.alpha is None else []))
    return selected_trials(packed, picks, trials, problem.nuisance, tuned.alpha or 0.0, problem.block)


def evaluate(packed: DataFrame, problem: Problem, train: Sequence[int], test: Sequence[int]) -> DataFrame:
    """feature, kernel, penalty, r2: tuned on the training runs, whose coefficients predict those of the test runs.

    Targets of a ridge are coefficients at its penalty, those of fractions are not penalised.
    """
    if set(train) & set(test) or not test:
        raise ValueError("training and test runs are apart, and there is a test run")
    tuned = tune(packed, problem, train)
    both = packed.where(F.col("run").isin([*train, *test]))
    few = Problem(problem.trials, {r: problem.nuisance[r] for r in [*train, *test]}, problem.predictors, problem.grid, problem.kind, problem.candidates, problem.mode, problem.share, problem.block)
    coefs = coefficients(both, few, tuned)
    if tuned.alpha is None:
        plain = coefficients(both, few, Tuned(tuned.picks.withColumn("penalty", F.when(F.col("penalty").isNotNull(), 1.0)), None, tuned.scores))
        coefs = coefs.where(F.col("run").isin(list(train))).unionByName(plain.where(F.col("run").isin(list(test))))
    r2 = B.encode_coefficients(coefs, {r: problem.predictors[r] for r in [*train, *test]}, sorted(train), sorted(test), problem.mode, problem.block).select("feature", "r2")
    return tuned.picks.join(r2, "feature", "left").select("feature", "kernel", "penalty", "r2")


def nested_evaluation(packed: DataFrame, problem: Problem) -> tuple[DataFrame, Tuned]:
    """direction, feature, kernel, penalty, r2 of odd runs predicting even ones and the reverse; and the choice from all runs, for a last fit."""
    runs = sorted(problem.nuisance)
    halves = {"even": [r for r in runs if r % 2 == 0], "odd": [r for r in runs if r % 2]}
    out = None
    for train, test in (("odd", "even"), ("even", "odd")):
        part = evaluate(packed, problem, halves[train], halves[test]).withColumn("direction", F.lit(f"{train}_to_{test}"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out.select("direction", "feature", "kernel", "penalty", "r2"), tune(packed, problem, runs)
