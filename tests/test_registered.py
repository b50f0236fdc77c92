"""Every registered query against its expected-result SQL on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from leverwise.plans.registered import all_queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, engine, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = engine.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    assert got == want
    assert got, "a query without rows shows nothing"


def test_entry_is_the_flagship(spark):
    df = entry_module.entry(spark)
    assert {"dataset_id", "attr_id", "value", "base_value", "override_value"} <= set(df.columns)
    assert df.count() > 0


def test_sql_and_queries_have_the_same_names():
    assert set(all_queries()) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())
