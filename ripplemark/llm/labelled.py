"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the hash by which rows are chosen.
STEPS = 1_000_000


def bounded_sample(rows: DataFrame, group: str, most: int, key: str = "doc_id", balanced: bool = False) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each group, all if it has fewer, chosen by a hash of the key; and the groups' sizes.

    The choice depends on keys only, so it is the same however rows are dealt, and nothing is sorted
    or gathered: one count for each group, then a filter. Rows with a null key or group are left out.
    balanced: take as many from each group as the smallest one has, if that is less.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    sizes = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    if not sizes:
        return rows, {}
    most = min(most, *sizes.values()) if balanced else most
    share: Column = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col(group) == F.lit(value), F.lit(min(STEPS, STEPS * most // n + 1))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(STEPS)) < share), sizes
