from __future__ import annotations

import pytest

from ripplemark.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, data, con):
    assert_same(QUERIES[name](spark, data), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_dense_query_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
