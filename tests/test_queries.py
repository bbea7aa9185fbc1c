"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SMALL
from workloads.check import compare, connect
from workloads.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, SMALL, queries()[name], oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry(spark):
    assert entry(spark).columns == ["path", "length", "mtime_ms", "destination", "accounted"]


def test_all_queries_have_sql():
    assert set(ORACLES) == set(QUERIES)
