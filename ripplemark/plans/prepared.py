"""Designs that a caller has built, with the role of each column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ripplemark.operators import dense as B
from ripplemark.plans.design import check_design, estimable, identity
from ripplemark.plans.model import Contrast, contrast_vector

ROLES = ("task", "nuisance", "intercept", "other")


@dataclass(frozen=True)
class Prepared:
    """run to matrix and column names; column to role, the same for all runs."""

    matrices: Mapping[int, np.ndarray]
    names: Mapping[int, tuple[str, ...]]
    roles: Mapping[str, str]

    def __post_init__(self):
        for r, m in self.matrices.items():
            names = self.names[r]
            if m.ndim != 2 or m.shape[1] != len(names) or len(set(names)) != len(names) or not np.isfinite(m).all():
                raise ValueError(f"run {r}: a design is finite, with a distinct name for each column")
            if any(n not in self.roles or self.roles[n] not in ROLES for n in names):
                raise ValueError(f"run {r}: every column has a role among {ROLES}")
            check_design(m)
            for n in names:
                if self.roles[n] == "intercept" and np.ptp(m[:, names.index(n)]) != 0:
                    raise ValueError(f"run {r}: an intercept is constant")

    def columns(self, run: int, *roles: str) -> np.ndarray:
        return self.matrices[run][:, [i for i, n in enumerate(self.names[run]) if self.roles[n] in roles]]

    def vectors(self, contrasts: Mapping[str, Contrast]) -> dict[str, dict[int, np.ndarray]]:
        """Weights of each contrast and run, by column name; raises for one that a run cannot estimate."""
        out: dict[str, dict[int, np.ndarray]] = {}
        for name, c in contrasts.items():
            out[name] = {r: contrast_vector(c, self.names[r]) for r in self.matrices}
            for r, v in out[name].items():
                if not estimable(v, self.matrices[r]):
                    raise ValueError(f"run {r}: contrast {name!r} cannot be estimated")
        return out

    def identity(self) -> str:
        return identity(*(x for r in sorted(self.matrices) for x in (r, list(self.names[r]), self.matrices[r])), dict(self.roles))


def fit_prepared(packed: DataFrame, prepared: Prepared, contrasts: Mapping[str, Contrast], noise: str = "ar1", block: int = B.BLOCK) -> DataFrame:
    """feature, contrast, effect, variance, t, z, p, dof, r2."""
    return B.fit_glm(packed, prepared.matrices, prepared.vectors(contrasts), noise, block)


def delta_r2_prepared(packed: DataFrame, prepared: Prepared, block: int = B.BLOCK) -> DataFrame:
    """feature, full_r2, nuisance_r2, delta_r2: the gain of the task columns beyond all others but other."""
    runs = prepared.matrices
    if any(not prepared.columns(r, "task").shape[1] for r in runs):
        raise ValueError("a run has no task column")
    full = {r: prepared.columns(r, "task", "nuisance", "intercept") for r in runs}
    rest = {r: prepared.columns(r, "nuisance", "intercept") for r in runs}
    return B.task_delta_r2(packed, full, rest, block)


def role_table(prepared: Prepared) -> Sequence[tuple[int, str, str]]:
    """run, column, role of every design column."""
    return [(r, n, prepared.roles[n]) for r in sorted(prepared.names) for n in prepared.names[r]]
