from __future__ import annotations

import random

from conftest import planned, rows_of

from leverwise.operators import graph as op
from test_overlay import attribute, scenario


def test_diamond_edges_come_once(tables, frame):
    t = tables(
        attribute=[attribute(i) for i in range(1, 5)],
        vdt_node=[(i * 10, i, i, f"n{i}", 1, None) for i in range(1, 5)],
        vdt_edge=[(1, 10, 20, 1), (2, 10, 30, 1), (3, 20, 40, 1), (4, 30, 40, 1), (5, 10, 20, 1)],
        scenario=[scenario(7, 1, 2)],
        value=[(2, i, 1.0, i == 4) for i in range(1, 5)],
    )
    got = op.descendants(t, frame("attr_id bigint, scenario_id bigint", (1, 7)))
    assert rows_of(got, "parent_id", "child_id", "is_calc_redundant") == [
        (10, 20, False), (10, 30, False), (20, 40, True), (30, 40, True)
    ]


def test_reachable_nodes_equals_brute_force_with_cycles(frame):
    rng = random.Random(7)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(i, i + 1) for i in range(30, 45)}
    below: dict[int, set[int]] = {}
    for root in (0, 3, 30):
        seen, queue = {root}, [root]
        while queue:
            node = queue.pop()
            for parent, child in edges:
                if parent == node and child not in seen:
                    seen.add(child)
                    queue.append(child)
        below[root] = seen
    got = op.reachable_nodes(
        frame("parent_id bigint, child_id bigint", *edges), frame("root bigint", *[(r,) for r in below])
    )
    assert rows_of(got, "root", "node") == sorted(((r, n) for r, nodes in below.items() for n in nodes), key=repr)


def test_structure_choice(tables, frame):
    t = tables(
        attribute=[attribute(1), attribute(2)],
        vdt_node=[(10, 1, 1, "a", 1, None), (11, 1, 1, "a", 2, None), (20, 2, 2, "b", 1, None), (21, 2, 2, "b", 2, None)],
        vdt_edge=[(1, 10, 20, 1), (2, 11, 21, 2)],
        scenario=[scenario(7, 1, 2)], value=[(2, 1, 1.0, False), (2, 2, 1.0, False)],
    )
    asked = frame("attr_id bigint, scenario_id bigint", (1, 7))
    assert rows_of(op.descendants(t, asked), "child_id") == [(20,), (21,)]
    assert rows_of(op.descendants(t, asked, frame("vdt_structure_id bigint", (2,))), "child_id") == [(21,)]


def test_import_structure_replaces_only_the_named_tree(tables, frame):
    t = tables(
        vdt_structure=[(1, "old"), (2, "kept")],
        vdt_node=[(1, 5, 50, "n", 1, None), (2, 5, 50, "n", 2, None)], vdt_edge=[(1, 1, 1, 1), (2, 2, 2, 2)],
    )
    done = op.import_structure(
        t, frame("name string", ("old",), ("new",)),
        frame("structure_name string, node_id bigint, attribute_id bigint, name string, link string",
              ("old", 8, 80, "x", None), ("old", 9, 90, "y", "l"), ("new", 8, 80, "z", None)),
        frame("structure_name string, parent_id bigint, child_id bigint", ("old", 8, 9), ("old", 8, 99)),
    )
    assert rows_of(done.vdt_structure) == [(1, "old"), (2, "kept"), (3, "new")]
    assert rows_of(done.vdt_node) == [
        (2, 5, 50, "n", 2, None), (3, 8, 80, "x", 1, None), (4, 9, 90, "y", 1, "l"), (5, 8, 80, "z", 3, None)
    ]
    assert rows_of(done.vdt_edge) == [(2, 2, 2, 2), (3, 3, 4, 1)]


def test_dependencies_on_itself_are_dropped(tables, frame):
    t = tables(
        external_attr=[(1, 10, "p", 900, "a"), (1, 11, "p", 901, "b"), (2, 12, "p", 902, "c")],
        attribute_dependency=[(10, 99, 5), (12, 99, 1)],
    )
    rows = frame("model_id bigint, object_path string, attr_name string", (1, "p", "a"), (1, "p", "b"))
    deps = frame("model_id bigint, ext_attr_id bigint, depends_on_ext_attr_id bigint", (1, 900, 901), (1, 901, 901))
    assert rows_of(op.replace_dependencies(t, rows, deps)) == [(10, 11, 1), (12, 99, 1)]


def test_a_walk_sends_no_edges_through_the_driver(frame, monkeypatch):
    plans, keep = [], op.cut_lineage
    monkeypatch.setattr(op, "cut_lineage", lambda df: plans.append(planned(df)) or keep(df))
    got = op.reachable_nodes(frame("parent_id bigint, child_id bigint", (1, 2), (2, 3)), frame("root bigint", (1,)))
    assert rows_of(got, "root", "node") == [(1, 1), (1, 2), (1, 3)]
    assert len(plans) > 1 and not any("BroadcastHashJoin" in plan for plan in plans)
