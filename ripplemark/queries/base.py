"""Registry, rounding, and the SQL of the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, *only: str) -> DataFrame:
    """Doubles rounded (all, or those named); -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(c), places) + F.lit(0.0)).alias(c) if kind == "double" and (not only or c in only) else F.col(c) for c, kind in df.dtypes))


CELLS = """cells AS (
  SELECT (user_id % 6)::INTEGER AS run, date_diff('hour', TIMESTAMP '2024-01-01', ts)::INTEGER AS scan, event_type AS feature, sum(value) AS y, count(*)::DOUBLE AS x
  FROM events GROUP BY ALL)"""
SIGNAL = f"""{CELLS},
grid AS (SELECT r.run::INTEGER AS run, s.scan::INTEGER AS scan, s.scan * 3600.0::DOUBLE AS t FROM range(6) r(run), range(720) s(scan)),
signal AS (SELECT g.run, g.scan, f.feature, coalesce(c.y, 0) AS y, coalesce(c.x, 0) AS x
  FROM grid g CROSS JOIN (SELECT DISTINCT event_type AS feature FROM events) f LEFT JOIN cells c ON c.run = g.run AND c.scan = g.scan AND c.feature = f.feature)"""
VECTORS = """ranked AS (SELECT label AS run, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS scan, embedding FROM embeddings),
vec AS (SELECT run, scan, (unnest(range(len(embedding))))::INTEGER AS feature, unnest(embedding)::DOUBLE AS y FROM ranked)"""
ORDERS = """ord AS (
  SELECT (l_suppkey % 6)::INTEGER AS run, floor(date_diff('day', DATE '1995-01-01', l_shipdate::DATE) / 7)::INTEGER AS scan, l_returnflag || l_linestatus AS feature,
         sum(l_extendedprice) AS y, sum(l_quantity) AS x
  FROM lineitem GROUP BY ALL)"""
TRIALS = """et AS (
  SELECT (user_id % 6)::INTEGER AS run, (row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) - 1)::INTEGER AS event_index, event_id,
         date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0::DOUBLE AS onset, 0.0::DOUBLE AS duration, event_type AS trial_type, value AS response_time
  FROM events)"""


def centred_sql(table: str, keys: str, *columns: str) -> str:
    """Rows of a table with columns less their means within the keys."""
    return f"SELECT * REPLACE ({', '.join(f'{c} - avg({c}) OVER (PARTITION BY {keys}) AS {c}' for c in columns)}) FROM {table}"
