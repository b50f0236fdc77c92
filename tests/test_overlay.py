from __future__ import annotations

import pytest
from conftest import planned, rows_of
from pyspark.sql import functions as F

from leverwise.functions import sizes
from leverwise.operators import overlay as op
from leverwise.operators.catalogue import create_status, name_status
from leverwise.plans.registered import stored
from leverwise.plans.registered.common import now
from leverwise.plans.what_if import what_if_round
from leverwise.session import held
from leverwise.sources.sample import SampleTables

def attribute(attr_id, level=1, calculated=False, lever=True, kpi=False, name=None):
    return (attr_id, name or f"a{attr_id}", "t", level, False, lever, calculated, False, False, kpi)


def dataset(dataset_id, model_id=1, name=None):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    return (dataset_id, model_id, name or f"d{dataset_id}", "user", at, None, at, 1, 1, False)


def scenario(scenario_id, base, view, name="s", user=1):
    return (scenario_id, 1, base, view, name, user, None, True)


def user(user_id, level=5, power=False):
    return (user_id, f"u{user_id}", level, f"ad{user_id}", power, False)


@pytest.fixture(scope="module")
def t(tables):
    # 1: base without scenario; 2: view of scenario 20 on 1; 3: view of scenario 30 on 2.
    return tables(
        attribute=[attribute(10), attribute(11), attribute(12, calculated=True), attribute(13, level=4)],
        dataset=[dataset(1), dataset(2), dataset(3)],
        scenario=[scenario(20, 1, 2), scenario(30, 2, 3)],
        value=[(1, 10, 100.0, False), (2, 10, 110.0, False), (2, 11, 50.0, False), (3, 10, 120.0, False),
               (3, 11, 60.0, False), (3, 13, 7.0, False)],
        scenario_change=[(20, 10, 5.0), (20, 12, 9.0), (30, 11, 6.0), (20, 13, 70.0)],
        external_attr=[(1, 10, "p", 900, "a10"), (1, 11, "p", 901, "a11"), (1, 12, "p", 902, "a12")],
        user=[user(1), user(2, level=2), user(3, level=None)],
    )


def test_resolved_values(t):
    got = rows_of(op.resolved_values(t), "dataset_id", "attr_id", "value", "base_value", "override_value")
    assert got == [
        (1, 10, 100.0, 100.0, None),  # no scenario: everything is the stored value
        (2, 10, 5.0, 100.0, 5.0),
        (2, 11, 50.0, 50.0, None),  # base has no value: the own stored one
        (3, 10, 120.0, 5.0, None),  # the base is an overridden view itself
        (3, 11, 6.0, 50.0, 6.0),
        (3, 13, 7.0, 70.0, None),  # the base has only an override
    ]


def test_two_scenarios_on_one_view_fan_out(t, frame):
    extra = frame(
        "scenario_id bigint, model_id bigint, base_dataset_id bigint, view_dataset_id bigint, scenario_name string, "
        "created_by bigint, editing_by bigint, is_public boolean",
        scenario(21, 1, 2),
    )
    doubled = t.replace(scenario=t.scenario.unionByName(extra))
    got = rows_of(
        op.resolved_values(doubled), "dataset_id", "scenario_id", "attr_id", "value", "base_value"
    )
    assert [r for r in got if r[0] == 2] == [
        (2, 20, 10, 5.0, 100.0), (2, 20, 11, 50.0, 50.0), (2, 21, 10, 110.0, 100.0), (2, 21, 11, 50.0, 50.0)
    ]
    # dataset 3 sees its base once through each scenario of the base
    assert [r for r in got if r[0] == 3 and r[2] == 10] == [(3, 30, 10, 120.0, 110.0), (3, 30, 10, 120.0, 5.0)]


def test_calc_inputs(t):
    got = rows_of(op.calc_inputs(t), "dataset_id", "attr_name", "value", "is_override")
    assert (2, "a12", 9.0, 1) in got  # override of a calculated attribute, no stored value needed
    assert (2, "a10", 5.0, 0) in got and (1, "a10", 100.0, 0) in got
    assert not [r for r in got if r[1] == "a12" and r[3] == 0]


def test_calc_inputs_scoped_by_model(t, frame):
    moved = t.replace(external_attr=t.external_attr.withColumn("model_id", F.lit(2).cast("bigint")))
    assert not rows_of(op.calc_inputs(moved, scope_by_model=True).where("is_override = 0"))
    assert rows_of(op.calc_inputs(moved).where("is_override = 0"))


def test_levels_hide_attributes(t, frame):
    asked = frame("dataset_id bigint, user_id bigint", (3, 1), (3, 2), (3, 3))
    ids = frame("attr_id bigint", (11,), (13,))
    got = rows_of(op.values_for(t, asked, ids), "user_id", "attr_id")
    assert got == [(1, 11), (1, 13), (2, 11)]  # a NULL level sees nothing


def test_compare_datasets(tables, frame):
    t = tables(
        attribute=[attribute(10), attribute(11, level=4)],
        unit_format=[("t", "{0:2s}")],
        dataset=[dataset(1), dataset(2), dataset(5)],
        scenario=[scenario(20, 1, 2)],
        value=[(1, 10, 0.0, False), (2, 10, 3.0, False), (5, 10, 8.0, False), (1, 11, 10.0, False),
               (2, 11, 12.0, False), (5, 11, 15.0, False)],
        scenario_change=[(20, 11, 20.0)],
        vdt_node=[(1, 1, 10, "n10", 7, None), (2, 2, 11, "n11", 7, None), (3, 2, 11, "other tree", 8, None)],
        user=[user(1, level=2)],
    )
    asked = frame("dataset_id bigint, benchmark_id bigint, structure_id bigint, user_id bigint", (2, 5, 7, 1))
    columns = ("attr_id", "actual", "target", "target_change", "whatif_change", "whatif")
    assert rows_of(op.compare_datasets(t, asked), *columns) == [
        (10, 0.0, 8.0, None, None, 3.0),  # base zero: no change
        (11, None, None, 0.5, 1.0, None),  # hidden values, changes still shown
    ]
    assert rows_of(op.compare_datasets(t, asked, mask_changes=True), *columns)[1] == (11, None, None, None, None, None)


CHANGES = "scenario_id bigint, attr_id bigint, new_value double, is_revert boolean, user_id bigint"


def test_apply_changes(tables, frame):
    t = tables(
        scenario=[scenario(1, 8, 9)], value=[(9, 10, 4.0, False), (9, 12, 6.0, False)],
        scenario_change=[(1, 10, 5.0), (2, 10, 1.0)],
    )
    batch = frame(CHANGES, (1, 10, 7.0, False, 3), (1, 11, 3.0, False, 3), (1, 12, 9.0, True, 3))
    changed = op.apply_changes(t, batch)
    assert rows_of(changed) == [(1, 10, 7.0), (1, 11, 3.0), (2, 10, 1.0)]
    log = op.change_log(t, batch, now())
    assert rows_of(log, "attr_id", "user_id", "old_value", "new_value") == [(10, 3, 4.0, 7.0), (12, 3, 6.0, 9.0)]
    assert rows_of(op.apply_changes(t.replace(scenario_change=changed), batch)) == rows_of(changed)


def test_revert_brings_the_stored_value_back(t, frame):
    gone = op.apply_changes(t, frame(CHANGES, (30, 11, None, True, 1)))
    shown = op.resolved_values(t.replace(scenario_change=gone)).where("dataset_id = 3 and attr_id = 11")
    assert rows_of(shown, "value", "override_value") == [(60.0, None)]


@pytest.mark.parametrize(
    "rows", [[(1, 10, 7.0, False, 3), (1, 10, 8.0, False, 3)], [(1, 10, None, False, 3)]], ids=["duplicate", "no value"]
)
def test_bad_changes_stop_the_job(t, frame, rows):
    with pytest.raises(Exception, match="duplicate key|new_value is required"):
        op.apply_changes(t, frame(CHANGES, *rows)).collect()


def test_mark_redundant_clears_earlier_marks(tables, frame):
    t = tables(
        scenario=[scenario(1, 8, 9)], value=[(9, 10, 1.0, True), (9, 11, 2.0, False), (8, 10, 3.0, True)]
    )
    got = op.mark_redundant(t, frame("scenario_id bigint", (1,)), frame("scenario_id bigint, attr_id bigint", (1, 11)))
    assert rows_of(got) == [(9, 10, 1.0, False), (9, 11, 2.0, True)]


def test_name_status_wants_exactly_one(tables, frame):
    t = tables(dataset=[dataset(1, name="one"), dataset(2, name="two"), dataset(3, name="two")])
    names = frame("name string", ("none",), ("one",), ("two",))
    assert rows_of(name_status(names, t.dataset, "dataset_name")) == [
        ("none", "False"), ("one", "True"), ("two", "False")
    ]
    loud = frame("name string", ("ONE ",))
    assert rows_of(name_status(loud, t.dataset, "dataset_name")) == [("ONE ", "False")]
    assert rows_of(name_status(loud, t.dataset, "dataset_name", ignore_case=True)) == [("ONE ", "True")]


def test_create_status(tables, frame):
    t = tables(
        dataset=[dataset(1, name="x")],
        scenario=[scenario(1, 1, 1, name="x"), scenario(2, 1, 1, name="y"), scenario(3, 1, 1, name="y")],
    )
    asked = frame(
        "request_id bigint, dataset_name string, scenario_name string, user_id bigint",
        (1, "x", "x", 1), (2, "x", "y", 1), (3, "x", "x", 2),
    )
    assert rows_of(create_status(t, asked)) == [
        (1, "dataset", 0), (1, "scenario", 0), (2, "dataset", 0), (2, "scenario", 1), (3, "dataset", 1), (3, "scenario", 1)
    ]


def test_search_is_literal_unless_a_pattern_is_asked_for(tables, frame):
    t = tables(
        attribute=[attribute(10, name="50% ore"), attribute(11, name="500 ore")],
        dataset=[dataset(1)], value=[(1, 10, 1.0, False), (1, 11, 2.0, False)],
        category=[(1, "c", None, 1)], attribute_category=[(10, 1, 1), (11, 1, 1)], user=[user(1)],
    )
    asked = frame("dataset_id bigint, user_id bigint", (1, 1))
    assert rows_of(op.search_values(t, asked, "50%"), "attr_id") == [(10,)]
    assert rows_of(op.search_values(t, asked, "50%", pattern=True), "attr_id") == [(10,), (11,)]
    assert rows_of(op.search_values(t, asked, "ORE"), "attr_id") == []
    assert rows_of(op.search_values(t, asked, "ORE", ignore_case=True), "attr_id") == [(10,), (11,)]


def test_copy_dataset(t, frame):
    asked = frame(
        "base_dataset_id bigint, dataset_name string, description string, user_id bigint, category_id bigint, "
        "is_public boolean, model_version int",
        (2, "copy", "text", 1, 3, False, 1),
    )
    copy = op.copy_dataset(t, asked, now())
    assert rows_of(copy.dataset, "dataset_id", "dataset_name", "origin") == [(4, "copy", "user")]
    assert rows_of(copy.value) == [(4, 10, 5.0, False), (4, 11, 50.0, False)]
    assert rows_of(copy.scenario, "scenario_id", "base_dataset_id", "view_dataset_id", "is_public") == [(31, 2, 4, False)]


def test_what_if_round(t, frame):
    def twice(inputs):
        return inputs.where("is_override = 0 and dataset_id = 2").select(
            "dataset_id", "object_path", "attr_name", (F.col("value") * 2).alias("value")
        )

    after, shown = what_if_round(t, frame(CHANGES, (20, 10, 8.0, False, 1)), twice, now())
    assert rows_of(after.value.where("dataset_id = 2"), "attr_id", "value") == [(10, 16.0), (11, 100.0)]
    assert rows_of(shown, "dataset_id", "attr_id", "value") == [(2, 10, 8.0), (2, 11, 100.0)]
    # What the later steps read is written once, not worked out for each of them.
    for state in (after.value, after.scenario_change):
        assert "Join" not in planned(state) and "Scan parquet" in planned(state)


def test_paths_too_many_to_broadcast_meet_results_in_a_shuffle(t, frame, monkeypatch):
    results = frame("dataset_id bigint, object_path string, attr_name string, value double", (2, "p", "a11", 5.0))
    assert "BroadcastHashJoin" in planned(op.with_attr_ids(t, results))
    monkeypatch.setattr(sizes, "is_small", lambda df: False)
    far = op.with_attr_ids(t, results)
    assert "SortMergeJoin" in planned(far) and "Broadcast" not in planned(far)
    assert rows_of(far, "dataset_id", "attr_id", "value") == [(2, 11, 5.0)]


def test_versioned_merge_works_its_batch_out_once(spark, tables, frame, monkeypatch):
    t = SampleTables(spark, "").replace(
        supplier=frame("s_suppkey bigint", (1,), (2,)),
        part=frame("p_partkey bigint, p_name string, p_brand string, p_type string", (10, "n", "b", "t"), (11, "m", "b", "t")),
        lineitem=frame(
            "l_suppkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string",
            (1, 10, 4.0, 100.0, "A"), (1, 11, 5.0, 110.0, "N"), (2, 11, 6.0, 120.0, "R"),
        ),
        dataset=tables(dataset=[dataset(1), dataset(2)]).dataset,
    )
    batches, merge = [], op.merge_calculated
    monkeypatch.setattr(op, "merge_calculated", lambda t, results, at: batches.append(planned(results)) or merge(t, results, at))
    got = stored.QUERIES["merge_calculated_versions"][0](t)
    assert rows_of(got, "dataset_id", "attr_id", "value") == [(1, 10, 4.0), (1, 11, 110.0), (2, 11, 5.0)]
    assert "Join" not in batches[0] and "Scan parquet" in batches[0]


def test_merge_stamps_all_calculated_datasets_and_refuses_unknown_ones(tables, frame):
    t = tables(dataset=[dataset(1), dataset(2)], external_attr=[(1, 10, "p", 900, "a")], value=[(1, 10, 1.0, False)])
    ddl = "dataset_id bigint, object_path string, attr_name string, value double"
    asked = frame("dataset_id bigint", (1,), (2,))
    merged = op.merge_calculated(t, frame(ddl, (1, "p", "a", 5.0)), now(), dataset_ids=asked)
    assert rows_of(merged.value, "dataset_id", "value") == [(1, 5.0)]
    assert merged.dataset.where(F.col("last_update") == now()).count() == 2
    with pytest.raises(Exception, match="no dataset 7"):
        op.merge_calculated(t, frame(ddl, (7, "p", "a", 5.0)), now())


def test_resolved_values_agree_above_and_below_the_limit(t, tables, monkeypatch):
    # A dataset and a scenario that come twice, once under another name, and a scenario on a base that does not exist.
    t = t.replace(
        dataset=t.dataset.union(tables(dataset=[dataset(2, name="again"), dataset(4)]).dataset),
        scenario=t.scenario.union(tables(scenario=[scenario(20, 1, 2), scenario(40, 99, 4)]).scenario),
        value=t.value.union(tables(value=[(4, 10, 1.0, True), (4, 11, 2.0, False)]).value),
        scenario_change=t.scenario_change.union(tables(scenario_change=[(40, 10, 3.0)]).scenario_change),
    )
    near = op.resolved_values(t)
    assert near.where("dataset_id = 2").count() == 8
    whole = sizes.cut_lineage
    monkeypatch.setattr(op, "measured", lambda df: (whole(df), False))
    monkeypatch.setattr(sizes, "is_small", lambda df: False)
    assert rows_of(op.resolved_values(t)) == rows_of(near)


def test_refresh_of_many_cells(t, frame, monkeypatch):
    changes = frame(CHANGES, (20, 10, 8.0, False, 1), (30, 11, None, True, 1))
    after = t.replace(scenario_change=op.apply_changes(t, changes))
    kept, cells = held(op.resolved_values(t)), op.affected_cells(after, changes)
    listed = op.affected_cells(after, changes, once=False)
    assert rows_of(listed.distinct()) == rows_of(cells)
    near = op.refresh_resolved(after, kept, listed.union(cells))
    monkeypatch.setattr(op, "is_small", lambda df: False)
    far = op.refresh_resolved(after, kept, listed.union(cells))
    assert far.columns == near.columns and rows_of(far) == rows_of(near)
    assert rows_of(far, *kept.columns) == rows_of(op.resolved_values(after))


def test_results_with_their_attributes_are_not_looked_up_again(t, frame):
    results = frame("dataset_id bigint, object_path string, attr_name string, value double", (2, "p", "a11", 5.0), (3, "p", "x", 1.0))
    found = op.with_attr_ids(t, results).select("dataset_id", "attr_id", "value")
    merged = op.merge_calculated(t, found, now(), dataset_ids=results.select("dataset_id"))
    usual = op.merge_calculated(t, results, now())
    assert rows_of(merged.value) == rows_of(usual.value) and rows_of(merged.dataset) == rows_of(usual.dataset)
