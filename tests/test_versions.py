"""Versioned tables: only touched buckets are rewritten, only asked files are opened, a dead write shows nothing."""

from __future__ import annotations

import pytest
from conftest import planned, rows_of

from leverwise.operators import overlay
from leverwise.sources import versions
from leverwise.sources.versions import Layout, Slice, Store, create_store
from test_overlay import attribute, dataset, scenario

CELLS = "dataset_id bigint, attr_id bigint, value double, is_calc_redundant boolean"
IDS = "dataset_id bigint"


@pytest.fixture
def store(tables, tmp_path):
    t = tables(value=[(d, a, float(d * a), False) for d in range(12) for a in range(40)])
    return create_store({"value": t.value}, str(tmp_path), {"value": Layout("dataset_id", "attr_id", 8)})


def files(store):
    return {r.file: r.bucket for r in store.files("value").collect()}


def test_a_write_adds_files_for_touched_buckets_only(store, frame, spark):
    before = files(store)
    after = store.write({"value": Slice(frame(CELLS, (3, 1, 9.0, True)), frame(IDS, (3,), (99,)))})
    buckets = {r.bucket for r in store.files("value", frame(IDS, (3,), (99,))).collect()}
    assert {f for f, b in before.items() if b not in buckets} == set(before) & set(files(after))
    want = [r for r in rows_of(store.read("value")) if r[0] != 3] + [(3, 1, 9.0, True)]
    assert rows_of(after.read("value")) == sorted(want, key=repr)
    # The former version can still be read, and the newest is found.
    assert rows_of(Store(spark, store.root, 0).read("value")) == rows_of(store.read("value"))
    assert Store(spark, store.root).version == 1


def test_a_write_that_dies_before_its_manifest_changes_nothing(store, frame, spark, monkeypatch):
    before = rows_of(store.read("value"))

    def dies(*args):
        raise OSError("killed")

    monkeypatch.setattr(versions, "_commit", dies)
    with pytest.raises(OSError):
        store.write({"value": Slice(frame(CELLS, (3, 1, 9.0, True)), frame(IDS, (3,)))})
    monkeypatch.undo()
    found = Store(spark, store.root)
    assert found.version == 0 and rows_of(found.read("value")) == before
    assert rows_of(found.write({"value": Slice(frame(CELLS), frame(IDS, (3,)))}).read("value")) == [r for r in before if r[0] != 3]


def test_two_writers_of_one_version(store, frame):
    part = {"value": Slice(frame(CELLS, (3, 1, 9.0, True)), frame(IDS, (3,)))}
    store.write(part)
    with pytest.raises(Exception, match="already exists"):
        store.write(part)


def test_groups_and_ranges_open_few_files(store, frame, monkeypatch):
    one = frame(IDS, (5,))
    assert store.files("value", one).count() < store.files("value").count()
    assert rows_of(store.read("value", one)) == [r for r in rows_of(store.read("value")) if r[0] == 5]
    attrs = frame("attr_id bigint", (39,))
    narrow = store.files("value", one, attrs)
    assert 0 < narrow.count() <= store.files("value", one).count()
    assert [r for r in rows_of(store.read("value", one, attrs)) if r[1] == 39] == [(5, 39, 195.0, False)]
    assert rows_of(store.read("value", frame(IDS))) == [] == rows_of(store.read("value", frame(IDS, (None,), (1000,))))
    monkeypatch.setattr(versions, "PUSHED_IDS", 1)
    two = frame(IDS, (5,), (6,))
    assert rows_of(store.read("value", two)) == [r for r in rows_of(store.read("value")) if r[0] in (5, 6)]


def test_empty_tables_and_whole_new_tables(tables, frame, spark, tmp_path):
    t = tables(dataset=[dataset(1), dataset(2)])
    store = create_store({"value": t.value, "dataset": t.dataset}, str(tmp_path))
    assert rows_of(store.read("value")) == [] and rows_of(Store(spark, str(tmp_path)).read("dataset")) == rows_of(t.dataset)
    assert store.changed({"dataset": t.dataset}) == {}
    part = store.changed({"dataset": tables(dataset=[dataset(2), dataset(3)]).dataset})
    assert rows_of(part["dataset"].touched) == [(1,), (3,)]
    after = store.write(part | {"value": Slice(frame(CELLS, (1, 1, 1.0, False)), frame(IDS, (1,)))})
    assert rows_of(after.read("dataset"), "dataset_id") == [(2,), (3,)] and rows_of(after.read("value")) == [(1, 1, 1.0, False)]


def bundle(tables):
    return tables(
        dataset=[dataset(d) for d in range(1, 40)], attribute=[attribute(a) for a in range(6)],
        scenario=[scenario(1, 8, 9), scenario(2, 7, 8), scenario(3, 20, 21)],
        scenario_change=[(1, 0, 5.0), (1, 1, 6.0), (2, 1, 3.0), (3, 2, 1.0)],
        value=[(d, a, float(10 * d + a), False) for d in range(1, 40) for a in range(6)],
        user=[(1, "u", 9, None, False, False)], vdt_structure=[(1, "tree")],
        vdt_node=[(a, a, a, f"n{a}", 1, None) for a in range(6)],
    )


def test_a_request_for_one_dataset_opens_only_its_files(tables, frame, tmp_path):
    t = bundle(tables)
    names = ["dataset", "attribute", "scenario", "scenario_change", "value", "user", "unit_format", "vdt_node", "vdt_structure"]
    store = create_store({n: getattr(t, n) for n in names}, str(tmp_path))
    requests = frame("dataset_id bigint, benchmark_id bigint, structure_id bigint, user_id bigint", (9, 30, 1, 1))
    cut = store.for_datasets(frame(IDS, (9,), (30,)))
    assert rows_of(overlay.compare_datasets(cut, requests)) == rows_of(overlay.compare_datasets(t, requests))
    asked = frame("dataset_id bigint, user_id bigint", (9, 1))
    attrs = frame("attr_id bigint", (0,), (1,), (5,))
    one = store.for_datasets(frame(IDS, (9,)))
    assert rows_of(overlay.values_for(one, asked, attrs)) == rows_of(overlay.values_for(t, asked, attrs))
    for name in ("value", "scenario_change"):
        opened = {f.split("bucket=")[1].split("/")[0] for f in getattr(one, name).inputFiles()}
        assert len(opened) <= 2 < len({r.bucket for r in store.files("value").collect()})
        plan = getattr(one, name)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(" in plan or "EqualTo(" in plan


def test_refreshed_values_equal_a_new_resolution(tables, frame):
    t = bundle(tables)
    kept = overlay.resolved_values(t)
    changes = frame("scenario_id bigint, attr_id bigint, new_value double, is_revert boolean", (1, 0, None, True), (2, 4, 77.0, False), (3, 2, 2.0, False))
    after = t.replace(scenario_change=overlay.apply_changes(t, changes))
    written = frame("dataset_id bigint, attr_id bigint, value double, is_calc_redundant boolean", (8, 3, -1.0, True), (30, 0, -2.0, False), (39, 5, -3.0, False))
    value = t.value.join(written, ["dataset_id", "attr_id"], "left_anti").unionByName(written)
    after = after.replace(value=value)
    cells = overlay.affected_cells(after, changes, written)
    assert rows_of(cells) == sorted(
        [(9, 0), (8, 4), (9, 4), (21, 2), (8, 3), (9, 3), (30, 0), (39, 5)], key=repr
    )
    fresh = overlay.resolved_values(after)
    assert rows_of(overlay.refresh_resolved(after, kept, cells).select(*fresh.columns)) == rows_of(fresh)


def test_refreshed_values_after_another_base(tables, frame):
    t = bundle(tables)
    after = t.replace(scenario=tables(scenario=[scenario(1, 30, 9), scenario(2, 7, 8), scenario(3, 8, 21)]).scenario)
    moved = frame("scenario_id bigint", (1,), (3,))
    cells = overlay.affected_cells(t, scenarios=moved).union(overlay.affected_cells(after, scenarios=moved))
    fresh = overlay.resolved_values(after)
    kept = overlay.resolved_values(t)
    assert rows_of(overlay.refresh_resolved(after, kept, cells.distinct()).select(*fresh.columns)) == rows_of(fresh)
    assert rows_of(overlay.refresh_resolved(t, kept, cells.limit(0)).select(*fresh.columns)) == rows_of(kept)


def test_changes_are_found_in_one_pass(store, spark, monkeypatch):
    plans, keep = [], versions.cut_lineage
    monkeypatch.setattr(versions, "cut_lineage", lambda df: plans.append(planned(df)) or keep(df))
    old = store.read("value")
    more = old.where("dataset_id <> 3 or attr_id <> 1").union(old.where("dataset_id = 5 and attr_id = 2"))
    found = store.changed({"value": more})["value"]
    # A missing row and one that comes twice.
    assert rows_of(found.touched) == [(3,), (5,)]
    assert plans[-1].count("Scan parquet") == 1 and "replicaterows" not in plans[-1]


def test_resolved_cells_cuts_before_the_wide_columns_come_in(tables, frame):
    t = bundle(tables)
    got = overlay.resolved_cells(t, frame("dataset_id bigint, attr_id bigint", (1, 1)))
    top = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line)
    assert "LeftSemi" not in top
    assert rows_of(got) == rows_of(overlay.resolved_values(t).where("dataset_id = 1 and attr_id = 1"))
