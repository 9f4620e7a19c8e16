"""Column functions of task models: category names, modulators, censoring, kernels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing value.
MISSING = ("", "n/a", "nan")


def level_name(value: Column) -> Column:
    """Canonical text of a category: whole numbers without a point ("1", "1.0" and 1 are one level), missing as null.

    Infinite numbers raise, as they are no level.
    """
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    plain = text.rlike(r"^[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+\.$")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    infinite = F.lower(text).isin("inf", "-inf", "+inf", "infinity", "-infinity")
    name = F.when(plain, whole).otherwise(text)
    return F.when(text.isNull() | F.lower(text).isin(*MISSING), F.lit(None).cast("string")).when(infinite, F.raise_error(F.lit("a category is infinite")).cast("string")).otherwise(name)


def level_order(level: Column) -> list[Column]:
    """Sort keys that put numbers first, by value, and other levels after, by text."""
    number = level.try_cast("double")
    return [number.isNull().asc(), number.asc(), level.asc()]


def indicators(level: Column, column: str, levels: Sequence[str], reference: str | None = None) -> list[Column]:
    """1 or 0 for each level but the reference (the first if not given), named column[level]; missing counts as 0."""
    if len(set(levels)) < 2:
        raise ValueError("a categorical modulator needs two levels at least")
    reference = levels[0] if reference is None else reference
    if reference not in levels:
        raise ValueError(f"{reference!r} is not a level")
    return [F.when(level == F.lit(x), 1.0).otherwise(0.0).alias(f"{column}[{x}]") for x in levels if x != reference]


def numeric_modulator(value: Column, column: str) -> list[Column]:
    """The value with missing as 0, and its indicator of missing."""
    gone = value.isNull() | F.isnan(value.cast("double"))
    return [F.when(gone, 0.0).otherwise(value.cast("double")).alias(column), F.when(gone, 1.0).otherwise(0.0).alias(f"missing_{column}")]


def positive_or_null(value: Column) -> Column:
    """A response time; null where it is not finite or not above 0."""
    x = value.cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def double_gamma(t: Column, delay: float, delay_after: float, dispersion: float, dispersion_after: float, ratio: float, onset: float = 0.0) -> Column:
    """A gamma density less a later one over the ratio: the response kernel before it is scaled to a peak of 1."""

    def density(k: float, theta: float) -> Column:
        x = t - F.lit(onset)
        body = F.exp((F.lit(k - 1)) * F.ln(x) - x / F.lit(theta) - F.lit(math.lgamma(k) + k * math.log(theta)))
        return F.when(x > 0, body).otherwise(F.lit(0.0))

    return density(delay / dispersion, dispersion) - density(delay_after / dispersion_after, dispersion_after) / F.lit(ratio)


def sample_count(duration: Column, step: float) -> Column:
    """Samples of a kernel of this duration: the ratio rounded up, but to the nearest whole number if it is within 1e-12 of it."""
    ratio = duration / F.lit(step)
    near = F.round(ratio)
    return F.when(F.abs(ratio - near) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(near)), near).otherwise(F.ceil(ratio)).cast("int")


def lobe_timing(delay: Column, dispersion: Column, onset: Column) -> tuple[Column, Column]:
    """Peak and standard deviation of a gamma lobe with shape delay / dispersion and scale dispersion."""
    return onset + delay - dispersion, F.sqrt(delay * dispersion)


def lobe_parameters(peak: Column, sd: Column, onset: Column) -> tuple[Column, Column]:
    """Delay and dispersion of the gamma lobe with this peak and standard deviation."""
    rise = peak - onset
    dispersion = (F.sqrt(rise * rise + 4 * sd * sd) - rise) / 2
    return rise + dispersion, dispersion
