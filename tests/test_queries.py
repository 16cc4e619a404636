"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note, _, _ = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "text"] and rows.count() > 0
