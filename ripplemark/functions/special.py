"""Tail probabilities by the regularised incomplete beta function, for arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); NaN outside its domain."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a, b, x = a[ok], b[ok], x[ok]
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) if len(z) else z
    value = front * _fraction(p, q, z) / p if len(z) else z
    value = np.where(z == 0, 0.0, value)
    out[ok] = np.where(swap, 1 - value, value)
    return out


def t_tail(t, df) -> np.ndarray:
    """P(T > t) with df degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(invalid="ignore", divide="ignore"):
        half = 0.5 * betainc(df / 2, 0.5, np.where(np.isinf(t), 0.0, df / (df + t * t)))
    return np.where(t >= 0, half, 1 - half)


def f_tail(f, df1, df2) -> np.ndarray:
    """P(F > f)."""
    f, df1, df2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    with np.errstate(invalid="ignore"):
        return betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0)))


def binomial_tail(successes: int, trials: int, p: float) -> float:
    """P(X >= successes)."""
    if successes <= 0:
        return 1.0
    if successes > trials:
        return 0.0
    return float(betainc(successes, trials - successes + 1, p))


def normal_tail(z) -> np.ndarray:
    """P(Z > z)."""
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def normal_from_tail(p) -> np.ndarray:
    """z with P(Z > z) = p; NaN stays, 0 and 1 give infinities."""
    from statistics import NormalDist

    def one(v: float) -> float:
        if math.isnan(v):
            return math.nan
        if v <= 0:
            return math.inf
        return -math.inf if v >= 1 else -NormalDist().inv_cdf(v)

    return np.vectorize(one, otypes=[float])(np.asarray(p, float))


def _t_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t.to_numpy(float), df.to_numpy(float)))


def t_p(t: Column, df: Column, sides: int = 1) -> Column:
    """One- or two-sided p of t; null where either is null or df is not positive."""
    p = F.pandas_udf(_t_tails, DoubleType())(t if sides == 1 else F.abs(t), df.cast("double"))
    return F.when(t.isNotNull() & (df > 0), p * sides)
