"""The pipeline stage by stage against plain versions, and the queries with SQL against it."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from leverwise.llm import queries
from llm.test_filters import contaminated_by_definition, plain_by_definition
from llm.test_minhash import brute

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for number, (name, work) in enumerate(corpus_pipeline.STAGES):
        work(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        after = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "packing":
            assert {r.doc_id for r in after} == set(texts)
            assert sum(r.length for r in after) <= 1024 * len({r.sequence_id for r in after})
            continue
        assert docs.columns == columns
        assert all(r.n_chars == len(r.text) for r in after)
        left = {r.doc_id: r.text for r in after}
        if name == "near duplicates":
            groups = brute(sorted(texts.items()))
            assert set(left) == {component for _, _, component in groups}
        if name == "benchmark":
            items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
            assert all(row[2] == 0 for row in contaminated_by_definition(sorted(left.items()), items))
            dirty = {row[0] for row in contaminated_by_definition(sorted(texts.items()), items) if row[2]}
            assert dirty and all(left[i] == t for i, t in texts.items() if i not in dirty)
        if name == "personal data":
            assert set(left) == set(texts)
            assert any(plain_by_definition(t) for t in texts.values())
            assert not any(plain_by_definition(t) for t in left.values())
        before = after


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    engine = duckdb.connect()
    for file in os.listdir(SF_DIR):
        engine.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    df = queries.QUERIES[name](spark, SF_DIR)
    result = engine.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(result.fetchall())


def test_all_are_registered():
    names = set(entry_module.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) <= names and set(queries.SQL) <= set(entry_module.oracle_sql())
