"""Fingerprints of arrays, tables and JSON values, in this engine's own canonical form."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from types import MappingProxyType
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freeze(value: Any) -> Any:
    """An immutable copy of a JSON value; anything else raises."""
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys of a JSON object are strings")
        return MappingProxyType({k: freeze(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return tuple(freeze(v) for v in value)
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        if not np.isfinite(value):
            raise ValueError("a JSON number is finite")
        return value
    raise TypeError(f"{type(value).__name__} is not a JSON value")


def thaw(value: Any) -> Any:
    """A plain JSON value again."""
    if isinstance(value, Mapping):
        return {k: thaw(v) for k, v in value.items()}
    return [thaw(v) for v in value] if isinstance(value, tuple) else value


def canonical_json(value: Any) -> str:
    return json.dumps(thaw(freeze(value)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def array_digest(values: np.ndarray) -> str:
    """Of shape, kind and little-endian bytes."""
    a = np.ascontiguousarray(values)
    a = a.astype(a.dtype.newbyteorder("<"))
    head = f"{a.dtype.str}:{','.join(map(str, a.shape))}:".encode()
    return hashlib.sha256(head + a.tobytes()).hexdigest()


def table_digest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, digest of a table, whatever order its rows are in.

    Rows are hashed alone; a sorted list of hashes would gather the table, so the digests of 256 groups (by the first byte) are hashed over
    sums that do not depend on order, and those 256 rows make the result.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    hashed = df.select(F.substring(row, 1, 2).alias("g"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    groups = hashed.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(5)))
    text = F.concat_ws(":", "g", "n", *(f"p{i}" for i in range(5)))
    return groups.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ","), 256).alias("digest"))


def assignment_digest(df: DataFrame, feature: str, kernel: str) -> DataFrame:
    """rows, digest of an assignment of kernels to features."""
    return table_digest(df.select(feature, kernel), [feature, kernel])
