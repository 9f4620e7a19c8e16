"""Queries that differed from their SQL on larger tables only."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from ripplemark.operators.aggregates import exact_mean
from ripplemark.queries import ORACLES, QUERIES
from tests.oracle import assert_same


def tables(path, **sql):
    """Parquet tables in a folder, and a connection that has them as views."""
    con = duckdb.connect()
    for name, rows in sql.items():
        con.execute(f"COPY ({rows}) TO '{path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


def test_pool_mask_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    # means of 0.03 and of 0.07, each in two orders of rows in which sums of doubles differ
    values = "[[0.0, 0.1, 0.01, 0.01], [0.01, 0.0, 0.01, 0.1], [0.09, 0.08, 0.06, 0.05], [0.05, 0.09, 0.08, 0.06]]"
    path, con = tables(
        tmp_path,
        part="SELECT range AS p_partkey FROM range(400)",
        lineitem=f"SELECT range AS l_partkey, unnest({values}[range % 4 + 1])::DOUBLE AS l_discount FROM range(400)",
    )
    got = QUERIES["pool_mask"](spark, path)
    want = {f: (f % 4 < 2, f % 4 > 1 and f < 200) for f in range(400)}  # the pool takes all means of 0.03, ties go by feature
    assert {r["feature"]: (r["pool"], r["scoring"]) for r in got.collect()} == want
    assert_same(got, con, ORACLES["pool_mask"].replace("avg(l_discount)", "avg(l_discount::DECIMAL(18, 2))"))


@pytest.mark.parametrize("values", [[0.1, 0.2, 0.3, None], [None], [1e300, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [-0.05, 0.05]])
def test_exact_mean_of_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    exact, plain = df.agg(exact_mean(F.col("x")), F.avg("x")).first()
    assert exact == plain or exact != exact and plain != plain or abs(exact - plain) < 1e-15


def events(rows):
    return f"SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(range) AS ts, {rows} AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(24000)"


def test_trial_table_keeps_numbers_of_more_than_four_digits(spark, tmp_path):
    path, con = tables(tmp_path, events=events("range % 2 * 6"))  # 24,000 events in one run
    got = QUERIES["trial_table"](spark, path)
    assert_same(got, con, ORACLES["trial_table"])
    assert got.select("trial_id").distinct().count() == 24_000


def test_trial_table_keeps_events_without_user_or_time(spark, tmp_path):
    rows = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts, CASE WHEN user_id <> 3 THEN user_id END AS user_id, event_type, value, props"
    path, con = tables(tmp_path, events=f"{rows} FROM ({events('range % 8')}) WHERE event_id < 500")
    assert_same(QUERIES["trial_table"](spark, path), con, ORACLES["trial_table"])
