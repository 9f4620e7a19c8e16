"""Registered queries: each an operator over the given tables, most with DuckDB SQL for the same rows.

Floats are rounded alike on both sides; undefined values are null.
"""

from __future__ import annotations

from ripplemark.queries import aggregate, dense, designs, linear, shaping  # noqa: F401
from ripplemark.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
