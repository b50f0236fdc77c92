from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from leverwise.operators import hierarchy as op

BATCH = "model_id bigint, ext_category_id bigint, grouping_name string, category_path string"


@pytest.mark.parametrize(
    "path, expected",
    [
        ("A", [(1, "A", 7)]),
        ("A~~B", [(1, "A", None), (2, "B", 7)]),
        ("A~~", [(1, "A", 7)]),
        ("A~~B~~", [(1, "A", None), (2, "B", 7)]),
        ("A~~~~B", [(1, "A", None), (2, "", None), (3, "B", 7)]),
        ("~~A", [(1, "", None), (2, "A", 7)]),
        ("A~~~~", [(1, "A", None), (2, "", 7)]),
        ("", []),
        (None, []),
        ("A~", []),
        ("A" * 40, [(1, "A" * 40, 7)]),
    ],
)
def test_explode_paths(frame, path, expected):
    got = op.explode_paths(frame(BATCH, (1, 7, "G", path)))
    assert rows_of(got, "level", "category_name", "ext_category_id") == expected


def test_names_are_cut_only_on_demand(frame):
    got = op.explode_paths(frame(BATCH, (1, 7, "G", "A" * 40)), max_name_len=30)
    assert rows_of(got, "category_name") == [("A" * 30,)]


def test_unusable_paths_are_returned(frame):
    rows = [(1, 1, "G", "A~"), (1, 2, "G", ""), (1, 3, "G", None), (1, 4, "G", "A~~"), (1, 5, "G", "A~~B~~~")]
    assert rows_of(op.rejected_paths(frame(BATCH, *rows)), "ext_category_id") == [(1,), (2,), (3,), (5,)]


def test_resolve_categories_keeps_parents_apart(tables, frame):
    t = tables(grouping=[(1, False, "Geo")], category=[(1, "X", None, 1), (2, "Z", 1, 1)])
    batch = frame(BATCH, (1, 70, "Geo", "X~~Z"), (1, 71, "Geo", "Y~~Z"), (1, 72, "Geo", "X"), (1, 73, "New", "X"))
    grouping, category, id_map = op.resolve_categories(t, batch)
    assert rows_of(grouping) == [(1, False, "Geo"), (2, True, "New")]
    assert rows_of(category) == [(1, "X", None, 1), (2, "Z", 1, 1), (3, "Y", None, 1), (4, "Z", 3, 1), (5, "X", None, 2)]
    assert rows_of(id_map, "ext_category_id", "category_id") == [(70, 2), (71, 4), (72, 1), (73, 5)]


def test_resolving_twice_adds_nothing(tables, frame):
    t = tables(grouping=[(1, False, "Geo")])
    batch = frame(BATCH, (1, 70, "Geo", "A~~B~~C"))
    _, category, _ = op.resolve_categories(t, batch)
    _, again, _ = op.resolve_categories(t.replace(category=category), batch)
    assert rows_of(again) == rows_of(category) and category.count() == 3


def test_deep_trees_and_cycles(tables):
    chain = [(i, f"c{i}", i - 1 if i > 1 else None, 1) for i in range(1, 12)]
    cycle = [(50, "x", 51, 1), (51, "y", 50, 1)]
    t = tables(grouping=[(1, False, "Geo")], category=chain + cycle)
    assert rows_of(op.category_tree(t), "category_id", "level") == sorted(((i, i) for i in range(1, 12)), key=repr)
    assert op.category_ancestors(t).count() == 66
    columns = op.category_level_columns(t)
    assert rows_of(columns.where("category_id in (2, 9)"), "category_id", "L1", "L2", "L3") == [
        (2, "c1", "c2", None), (9, "c1", "c2", "c3")
    ]


def test_paths_of_a_deep_tree_take_few_jobs(tables, spark, monkeypatch):
    depth = 1000
    t = tables(grouping=[(1, True, "G")], category=[(k, f"c{k}", k - 1 if k else None, 1) for k in range(depth)])
    jobs = []
    plain = op.cut_lineage
    monkeypatch.setattr(op, "cut_lineage", lambda df: jobs.append(1) or plain(df))
    found = op.category_paths(t).where("level in (1, 2, 777, 1000)").select(
        "level", "category_id", F.expr("path[0].category_id").alias("top"), F.expr("path[level - 1].category_name").alias("own")
    )
    assert rows_of(found) == sorted([(1, 0, 0, "c0"), (2, 1, 0, "c1"), (777, 776, 0, "c776"), (1000, 999, 0, "c999")], key=repr)
    assert len(jobs) <= 11


def test_paths_of_cycles_strangers_and_chosen_groupings(tables, frame):
    rows = [(1, "a", None, 1), (2, "b", 1, 1), (3, "c", 2, 2), (4, "d", 3, 2), (5, "x", 6, 1), (6, "y", 5, 1), (7, "z", 99, 1), (8, "e", None, 2),
            (9, "self", 9, 1), (10, "below", 5, 1)]
    t = tables(grouping=[(1, True, "G"), (2, True, "H")], category=rows)
    level = lambda **o: rows_of(op.category_paths(t, **o), "category_id", "level")
    assert level() == [(1, 1), (2, 2), (3, 3), (4, 4), (8, 1)]
    assert level(one_grouping=True) == [(1, 1), (2, 2), (8, 1)]
    assert level(groupings=frame("grouping_id bigint", (2,))) == [(8, 1)]
    assert level(groupings=frame("grouping_id bigint", (1,), (1,))) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    empty = tables(category=[(5, "x", 6, 1), (6, "y", 5, 1)])
    assert rows_of(op.category_paths(empty)) == [] == rows_of(op.category_paths(tables()))
