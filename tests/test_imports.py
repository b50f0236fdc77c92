from __future__ import annotations

import pytest
from conftest import planned, rows_of

from leverwise.operators import analysis, ingest
from leverwise.plans.model_import import CHANGED, Batch, import_model, write_import
from leverwise.plans.registered.common import now
from leverwise.sources.schemas import BATCHES
from leverwise.sources.tables import load_tables
from leverwise.sources.versions import Store, create_store
from test_merge import model
from test_overlay import attribute, dataset


def ddl(name: str) -> str:
    return BATCHES[name].replace(" not null", "")


def row(model_id, ext, name, value, code="XXXX", unit="t", level=None, path="p"):
    return (model_id, ext, path, name, value, code, unit, level)


@pytest.mark.parametrize(
    "code, flags",
    [("CLAK", [True, True, False, True, True]), ("XCXX", [False, False, True, False, False]), ("", [False] * 5)],
)
def test_type_codes(frame, code, flags):
    got = ingest.decode_types(frame(ddl("model_rows"), row(1, 1, "a", 1.0, code)))
    assert list(got.select(*ingest.FLAGS).first()) == flags


def test_known_paths_keep_their_name_and_new_ones_are_added(tables, frame):
    t = tables(attribute=[attribute(10, name="stored name")], external_attr=[(1, 10, "p", 900, "a")])
    rows = frame(ddl("model_rows"), row(1, 900, "a", 1.0, unit=None), row(1, 901, "b", 2.0, "CLAK"), row(2, 902, "a", 3.0))
    done = ingest.upsert_attributes(t, rows)
    assert rows_of(done.attribute, "attr_id", "attr_name", "unit", "sec_level", "is_kpi") == [
        (10, "stored name", "#", 1, False), (11, "b", "t", 1, True), (12, "a", "t", 1, False)
    ]
    assert rows_of(done.external_attr, "model_id", "attr_id", "ext_attr_id") == [(1, 10, 900), (1, 11, 901), (2, 12, 902)]
    assert rows_of(done.actions, "attr_id", "action") == [(10, "UPDATE"), (11, "INSERT"), (12, "INSERT")]


def links(t, frame, **options):
    rows = frame(ddl("model_rows"), row(1, 900, "a", 1.0))
    pairs = frame(ddl("attribute_categories"), (1, 900, 70))
    id_map = frame("model_id bigint, ext_category_id bigint, category_id bigint", (1, 70, 5))
    return rows_of(ingest.replace_attribute_categories(t, rows, pairs, id_map, **options))


def test_category_links_of_other_attributes_stay_unless_asked(tables, frame):
    t = tables(
        external_attr=[(1, 10, "p", 900, "a"), (1, 11, "p", 901, "b")], category=[(4, "old", None, 1), (5, "c", None, 1)],
        attribute_category=[(10, 1, 4), (11, 1, 4)],
    )
    assert links(t, frame) == [(10, 1, 5), (11, 1, 4)]
    assert links(t, frame, legacy_full_replace=True) == [(10, 1, 5)]


def test_values_reach_the_same_path_of_other_models_unless_scoped(tables, frame):
    t = tables(
        dataset_category=[(3, "Scenario")], dataset=[dataset(7)],
        external_attr=[(1, 10, "p", 900, "a"), (2, 20, "p", 900, "a")],
    )
    imports = frame(ddl("imports"), (1, "_abc.xml", 900))
    rows = frame(ddl("model_rows"), row(1, 900, "a", 1.0))
    loaded = ingest.reload_model_datasets(t, imports, rows, now())
    assert rows_of(loaded.dataset.where("dataset_id = 8"), "dataset_name", "category_id") == [("Model Data - _debug", 3)]
    assert rows_of(loaded.value, "dataset_id", "attr_id") == [(8, 10), (8, 20)]
    scoped = ingest.reload_model_datasets(t, imports, rows, now(), scope_by_model=True)
    assert rows_of(scoped.value, "dataset_id", "attr_id") == [(8, 10)]


def test_null_names_in_paths(tables, frame):
    t = tables().replace(
        external_attr=frame(
            "model_id bigint, attr_id bigint, object_path string, ext_attr_id bigint, attr_name string",
            (1, 10, "object", 1, None),
        )
    )
    got = ingest.attributes_by_path(t, frame("path string", ("object[]",)), frame("model_id bigint", (1,)))
    assert rows_of(got, "path", "attr_id") == [("object[]", 10)]
    assert rows_of(ingest.external_id_map(t), "full_path") == [(None,)]


def test_import_and_reimport(tables, frame, spark, tmp_path):
    t = tables(
        grouping=[(1, False, "Geo")], model=[model(1)], dataset_category=[(3, "Scenario")],
        attribute=[attribute(10)], external_attr=[(1, 10, "p", 900, "a")], attribute_dependency=[(10, 10, 9)],
    )
    batch = Batch(
        frame(ddl("imports"), (1, "m.xml", 901)),
        frame(ddl("model_rows"), row(1, 900, "a", 1.0), row(1, 901, "b", 2.0)),
        frame(ddl("dependencies"), (1, 901, 900), (1, 900, 900)),
        frame(ddl("categories"), (1, 70, "Geo", "X~~Y")),
        frame(ddl("attribute_categories"), (1, 901, 70)),
    )
    done = import_model(t, batch, now())
    assert rows_of(done.tables.attribute_category) == [(11, 1, 2)]
    assert rows_of(done.tables.attribute_dependency) == [(11, 10, 1)]
    assert rows_of(done.tables.model, "filename", "top_of_tree_attr_id") == [("m.xml", 11)]
    assert rows_of(done.value, "dataset_id", "attr_id", "value") == [(1, 10, 1.0), (1, 11, 2.0)]

    store = create_store({name: getattr(t, name) for name in CHANGED}, str(tmp_path))
    after = write_import(done, store)
    assert after.version == Store(spark, str(tmp_path)).version == 1
    stored = done.tables.replace(**{name: after.read(name) for name in CHANGED})
    for name in CHANGED:
        assert rows_of(getattr(stored, name)) == rows_of(getattr(done.tables, name).select(*getattr(stored, name).columns))
    again = import_model(stored, batch, now())
    for name in CHANGED:
        assert rows_of(getattr(again.tables, name).select(*getattr(stored, name).columns)) == rows_of(getattr(stored, name))


def test_tables_load_with_declared_types(tables, spark, tmp_path):
    t = tables(value=[(1, 10, 1.0, False)])
    t.value.write.parquet(f"{tmp_path}/value")
    loaded = load_tables(spark, str(tmp_path), ["value"])
    assert rows_of(loaded.value) == [(1, 10, 1.0, False)]


def test_unknown_target_refuses_the_run(tables, frame):
    t = tables(
        external_attr=[(1, 10, "p", 900, "a"), (1, 11, "p", 901, "b")],
        sensitivity=[(5, 1, 0.1, 10, 1.0, dataset(1)[4])],
        sensitivity_value=[(5, 10, 1.0, 1.0), (6, 10, 2.0, 2.0)],
    )
    runs = frame(ddl("sensitivity_runs"), (1, 1, 0.3, "p", "a", 9.0), (2, 2, 0.3, "p", "b", 8.0), (3, 3, 0.3, "no", "x", 7.0))
    rows = frame(ddl("sensitivity_rows"), (1, "p", "b", 3.0, 4.0), (2, "p", "a", 5.0, 6.0), (3, "p", "a", 7.0, 8.0))
    done = analysis.import_sensitivity(t, runs, rows, now())
    assert rows_of(done.rejected, "run_id") == [(3,)]
    # the percentage of a known run is not refreshed
    assert rows_of(done.headers, "sensitivity_id", "dataset_id", "percent_change", "target_base_value") == [
        (5, 1, 0.1, 9.0), (6, 2, 0.3, 8.0)
    ]
    assert rows_of(analysis.with_details(t.sensitivity_value, done, "sensitivity_id")) == [(5, 11, 3.0, 4.0), (6, 10, 5.0, 6.0)]


def test_of_several_debug_files_the_last_model_counts(tables, frame):
    t = tables(
        dataset_category=[(4, "Scenario")],
        external_attr=[(1, 10, "p", 900, "a"), (2, 20, "p", 901, "a")],
    )
    imports = frame("model_id bigint, filename string", (1, "_one"), (2, "_two"))
    rows = frame(ddl("model_rows"), row(1, 900, "a", 1.0), row(2, 901, "a", 2.0))
    loaded = ingest.reload_model_datasets(t, imports, rows, now(), scope_by_model=True)
    assert rows_of(loaded.dataset, "dataset_name", "model_id") == [("Model Data - _debug", 2)]
    assert rows_of(loaded.value, "attr_id", "value") == [(20, 2.0)]


def test_an_upsert_sends_no_stored_paths_through_the_driver(tables, frame):
    t = tables(attribute=[attribute(10)], external_attr=[(1, 10, "p", 900, "a")])
    done = ingest.upsert_attributes(t, frame(ddl("model_rows"), row(1, 900, "a", 1.0), row(1, 901, "b", 2.0)))
    assert "BroadcastHashJoin" not in planned(done.actions)
    assert rows_of(done.actions, "attr_id", "action") == [(10, "UPDATE"), (11, "INSERT")]
