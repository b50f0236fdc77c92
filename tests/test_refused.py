"""Refused rows are kept as they came and can be replayed."""

from __future__ import annotations

from conftest import rows_of

from leverwise.operators import overlay
from leverwise.operators.refused import UNKNOWN_END, UNKNOWN_PATH, refuse, refused_rows, unknown_ends, unknown_paths
from leverwise.plans.registered.common import now
from test_overlay import attribute, dataset

RESULTS = "dataset_id bigint not null, object_path string not null, attr_name string not null, value double"
EDGES = "structure_name string not null, parent_id bigint not null, child_id bigint not null"


def test_results_of_unknown_paths_come_back_and_complete_the_merge(tables, frame, spark, tmp_path):
    paths = [(1, 10, "p", 900, "a"), (1, 11, "q\"\\", 901, "ü")]
    t = tables(dataset=[dataset(1)], attribute=[attribute(10), attribute(11)], external_attr=paths[:1])
    rows = frame(RESULTS.replace(" not null", ""), (1, "p", "a", 1.5), (1, "q\"\\", "ü", 0.1), (1, "none", "a", None))
    found = unknown_paths(t, rows)
    refuse(found, "b1", "value", UNKNOWN_PATH).union(refuse(rows.limit(1), "b1", "other", "x")).write.parquet(f"{tmp_path}/refused")
    refused = spark.read.parquet(f"{tmp_path}/refused")
    back = refused_rows(refused, "value", RESULTS)
    assert rows_of(back) == rows_of(found) and back.columns == rows.columns
    assert rows_of(refused.where("target = 'value'"), "batch", "rule") == [("b1", UNKNOWN_PATH)] * 2
    first = overlay.merge_calculated(t, rows, now())
    later = t.replace(value=first.value, external_attr=tables(external_attr=paths).external_attr)
    assert rows_of(overlay.merge_calculated(later, back.where("value is not null"), now()).value, "attr_id", "value") == [(10, 1.5), (11, 0.1)]


def test_paths_of_other_models_are_unknown_when_scoped(tables, frame):
    t = tables(external_attr=[(1, 10, "p", 900, "a")])
    rows = frame("model_id bigint, object_path string, attr_name string", (1, "p", "a"), (2, "p", "a"))
    assert rows_of(unknown_paths(t, rows)) == []
    assert rows_of(unknown_paths(t, rows, scope_by_model=True)) == [(2, "p", "a")]


def test_edges_with_an_unknown_end(frame):
    nodes = frame("structure_name string, node_id bigint", ("s", 1), ("s", 2), ("s", 2), ("r", 3))
    edges = frame(EDGES.replace(" not null", ""), ("s", 1, 2), ("s", 1, 2), ("s", 1, 3), ("s", 4, 2), ("r", 1, 2), ("none", 1, 2), ("s", 1, 1))
    found = unknown_ends(nodes, edges)
    assert rows_of(found) == [("none", 1, 2), ("r", 1, 2), ("s", 1, 3), ("s", 4, 2)]
    assert rows_of(refused_rows(refuse(found, "b", "vdt_edge", UNKNOWN_END), "vdt_edge", EDGES)) == rows_of(found)
