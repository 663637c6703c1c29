"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from panelkite.catalog import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    diff = differences(spark, duck, QUERIES[name], SQL[name], SF_DIR)
    # the smallest tables leave some results empty on both sides
    assert diff in ("", "EMPTY"), diff


def test_entry_offers_them():
    assert QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
