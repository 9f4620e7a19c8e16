"""Gradient-boosted trees of depth two over small integer features, fitted on counted rows and written as SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

#: One row: features, label, how often it occurs.
Row = tuple[tuple[int, ...], int, int]


@dataclass(frozen=True)
class Tree:
    """Splits "feature <= cut": at the root, then on either side; four leaves."""

    root: tuple[int, int]
    sides: tuple[tuple[int, int], tuple[int, int]]
    leaves: tuple[float, float, float, float]

    def value(self, x: Sequence[int]) -> float:
        side = int(x[self.root[0]] > self.root[1])
        f, cut = self.sides[side]
        return self.leaves[2 * side + int(x[f] > cut)]

    def sql(self, names: Sequence[str]) -> str:
        def branch(side: int) -> str:
            f, cut = self.sides[side]
            return f"CASE WHEN {names[f]} <= {cut} THEN {self.leaves[2 * side]!r}D ELSE {self.leaves[2 * side + 1]!r}D END"

        return f"CASE WHEN {names[self.root[0]]} <= {self.root[1]} THEN {branch(0)} ELSE {branch(1)} END"


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Tree, ...]

    def raw(self, x: Sequence[int]) -> float:
        total = self.base
        for t in self.trees:  # in the order of the SQL, which must round alike
            total += t.value(x)
        return total

    def sql(self, names: Sequence[str]) -> str:
        """The log-odds as an SQL expression over the features' names."""
        return " + ".join([f"{self.base!r}D", *(t.sql(names) for t in self.trees)])


def _leaf(rows: list, ridge: float) -> tuple[float, float]:
    """Best value of a leaf, and its gain. rows: (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return -g / (h + ridge), g * g / (h + ridge)


def _split(rows: list, ridge: float) -> tuple[float, tuple[int, int]]:
    """Gain and place of the best split; ties go to the first feature and least cut."""
    best, place = _leaf(rows, ridge)[1], (0, 1 << 30)
    for f in range(len(rows[0][0]) if rows else 0):
        for cut in sorted({r[0][f] for r in rows})[:-1]:
            gain = sum(_leaf([r for r in rows if (r[0][f] <= cut) == left], ridge)[1] for left in (True, False))
            if gain > best + 1e-9:
                best, place = gain, (f, cut)
    return best, place


def boost(rows: list[Row], rounds: int = 20, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss."""
    total, positive = sum(n for _, _, n in rows), sum(n for _, y, n in rows if y)
    base = math.log((positive + 0.5) / (total - positive + 0.5))
    scores, trees = [base] * len(rows), []
    for _ in range(rounds if 0 < positive < total else 0):
        work = []
        for (x, y, n), s in zip(rows, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            work.append((x, n * (p - y), n * max(1e-6, p * (1 - p))))
        root = _split(work, ridge)[1]
        halves = [[r for r in work if (r[0][root[0]] > root[1]) == bool(side)] for side in (0, 1)]
        sides, leaves = [], []
        for half in halves:
            place = _split(half, ridge)[1] if half else (0, 1 << 30)
            sides.append(place)
            leaves += [rate * _leaf([r for r in half if (r[0][place[0]] > place[1]) == over], ridge)[0] for over in (False, True)]
        tree = Tree(root, (sides[0], sides[1]), (leaves[0], leaves[1], leaves[2], leaves[3]))
        trees.append(tree)
        scores = [s + tree.value(x) for (x, _, _), s in zip(rows, scores, strict=True)]
    return Boosted(base, tuple(trees))


def threshold(model: Boosted, rows: list[Row], precision: float) -> float:
    """Least log-odds from which the rows reach a precision; infinity if none does."""
    scored = sorted(((model.raw(x), y, n) for x, y, n in rows), reverse=True)
    right = all_ = 0
    best = math.inf
    for i, (s, y, n) in enumerate(scored):
        right, all_ = right + n * y, all_ + n
        if (i + 1 == len(scored) or scored[i + 1][0] < s) and right >= precision * all_:
            best = s
    return best
