"""Noise components end to end: pool, components, count, gate, and the nuisance they are added to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.special import binomial_tail
from ripplemark.operators import dense as B
from ripplemark.operators import estimators as E
from ripplemark.operators import picks as P
from ripplemark.operators.shaping import pool_masks


@dataclass
class Denoising:
    """count: how many components; components: run to scans x count, named denoise_pc_000 and so on; scores: count, score."""

    count: int
    components: Mapping[int, np.ndarray]
    scores: DataFrame
    threshold: float
    significant: int
    tested: int
    identity: str

    def names(self) -> list[str]:
        return [f"denoise_pc_{i:03d}" for i in range(self.count)]


def onoff_r2(packed: DataFrame, task: Mapping[int, np.ndarray], nuisance: Mapping[int, np.ndarray], block: int = B.BLOCK) -> DataFrame:
    """feature, r2 of one response shared by all runs, in and on the same runs."""
    runs = {r: E.candidate_run(nuisance[r], [task[r]]) for r in nuisance}

    def run(features, signals, shared):
        import pandas as pd

        parts = [E.candidate_sums(shared[r], signals[r]) for r in sorted(signals)]
        a, b, c = (sum(p[i] for p in parts) for i in range(3))
        fit = E.Quadratic.of(a, b, c)
        return pd.DataFrame({"feature": features, "r2": 1 - E.ratio(fit.loss(fit.best())[0], sum(p[3] for p in parts))})

    return B.by_block(packed, run, f"feature {dict(packed.dtypes)['feature']}, r2 double", runs, block)


def pool_threshold(stat: DataFrame, places: int = 3) -> float:
    """Tail threshold of a mixture fitted to the rounded values and their counts, a table whose size does not grow with the features."""
    rows = stat.where("r2 is not null").select(F.round("r2", places).alias("v")).groupBy("v").count().orderBy("v").collect()
    return E.mixture_threshold(np.array([r["v"] for r in rows]), np.array([r["count"] for r in rows], float))


def select_components(
    packed: DataFrame, task: Mapping[int, np.ndarray], nuisance: Mapping[int, np.ndarray], counts: Sequence[int] = tuple(range(11)), threshold: float | None = None,
    factor: float = 1.05, gate: bool = True, alpha: float = 0.05, binomial_alpha: float = 0.05, noise: str = "ar1", block: int = B.BLOCK,
) -> Denoising:
    """Features with little response make the pool; the number of their components is where held-out prediction of the others stops to gain.

    The gate keeps them only if more features than chance allows are explained better with them. Needs three runs.
    """
    if len(nuisance) < 3:
        raise ValueError("components need three runs")
    if 0 not in counts or sorted(set(counts)) != sorted(counts) or min(counts) < 0 or not factor >= 1:
        raise ValueError("counts are distinct and hold 0, and the factor is 1 or more")
    stat = onoff_r2(packed, task, nuisance, block).persist()
    cut = pool_threshold(stat) if threshold is None else threshold
    masks = pool_masks(stat, "feature", "r2", cut, cut)
    comps = B.noise_components(packed, masks.where("pool").select("feature"), nuisance, max(counts), block)
    scored = packed.join(masks.where("scoring").select("feature"), "feature", "left_semi")
    runs = {r: (task[r], nuisance[r]) for r in nuisance}
    usable = [c for c in counts if all(v.shape[1] >= c for v in comps.values())]
    scores = B.component_scores(scored, runs, comps, usable, block).groupBy("count").agg(F.median("score").alias("score")).persist()
    chosen = P.first_good_enough(scores.withColumn("all", F.lit(0)), ["all"], "count", "score", factor).first()
    count = int(chosen["count"]) if chosen else 0
    significant = tested = 0
    if count and gate:
        found = B.component_tests(scored, runs, comps, count, noise, block).agg(F.count("p").alias("n"), F.count_if(F.col("p") < alpha).alias("k")).first()
        significant, tested = found["k"], found["n"]
        if binomial_tail(significant, tested, alpha) >= binomial_alpha:
            count = 0
    from ripplemark.plans.design import identity

    stat.unpersist()
    parts = {r: v[:, :count] for r, v in comps.items()}
    return Denoising(count, parts, scores, cut, significant, tested, identity(*(x for r in sorted(nuisance) for x in (r, nuisance[r]))))


def with_components(nuisance: Mapping[int, np.ndarray], result: Denoising) -> dict[int, np.ndarray]:
    """The nuisance with the components; raises if they were found with another nuisance (or have been added before)."""
    from ripplemark.plans.design import identity

    if identity(*(x for r in sorted(nuisance) for x in (r, nuisance[r]))) != result.identity:
        raise ValueError("the components belong to another nuisance")
    return {r: np.column_stack([n, result.components[r]]) for r, n in nuisance.items()}
