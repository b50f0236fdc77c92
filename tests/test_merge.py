from __future__ import annotations

import datetime

import pytest
from conftest import planned, rows_of
from pyspark.sql import functions as F

from leverwise.functions import sizes
from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import is_small, join_dimension
from leverwise.operators import merge as op
from leverwise.operators import registry, security
from leverwise.plans.registered.common import now
from leverwise.session import held
from leverwise.sources.schemas import BATCHES
from leverwise.sources.tables import as_input, incomplete_rows, seed_reference
from test_overlay import attribute, dataset, scenario, user

AT = datetime.datetime(2024, 1, 1)


def test_assign_ids_follow_the_order_without_gaps(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 3).alias("hot"))
    got = assign_ids(df, "new_id", ["hot", "k"], 100).orderBy("hot", "k").select("new_id")
    assert [r.new_id for r in got.collect()] == list(range(100, 5100))


def test_assign_ids_with_one_hot_leading_value(spark):
    df = spark.range(3000).select(F.lit(1).alias("same"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = assign_ids(df, "new_id", ["same", "id"], 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert rows_of(got.where("new_id <> id + 1")) == []


def test_assign_ids_of_nothing(spark, tables):
    assert assign_ids(spark.range(0), "new_id", ["id"], 5).columns == ["id", "new_id"]
    assert next_id(tables().dataset, "dataset_id") == 1


def test_upsert_inserts_updates_and_fills_defaults(tables, frame):
    t = tables(value=[(1, 10, 1.0, True), (1, 11, 2.0, True)])
    source = frame("dataset_id bigint, attr_id bigint, value double", (1, 11, 20.0), (2, 10, 30.0))
    got = op.upsert(t.value, source, ["dataset_id", "attr_id"], ["value"], "value", with_action=True)
    assert rows_of(got) == [(1, 10, 1.0, True, "keep"), (1, 11, 20.0, True, "U"), (2, 10, 30.0, False, "I")]


def test_duplicate_source_keys_fail(tables, frame):
    source = frame("dataset_id bigint, attr_id bigint, value double", (1, 11, 20.0), (1, 11, 30.0))
    with pytest.raises(Exception, match="duplicate key"):
        op.upsert(tables().value, source, ["dataset_id", "attr_id"], ["value"], "value").collect()


def test_patches_can_write_null(tables, frame):
    t = tables(scenario=[(1, 1, 1, 2, "s", 1, 5, True), (2, 1, 1, 3, "s", 1, 6, True)])
    got = op.patch_rows(t.scenario, frame("view_dataset_id bigint, editing_by bigint", (2, None)), ["view_dataset_id"])
    assert rows_of(got, "scenario_id", "editing_by") == [(1, None), (2, 6)]


def test_reconcile_three_ways(tables, frame):
    t = tables(access_group=[(1, 1, "one", 100), (2, 1, "two", 100), (3, 1, "three", 200)])
    source = frame(
        BATCHES["access_groups"].replace(" not null", ""), (1, 5, "renamed", 100), (3, 2, "n3", 100), (0, 2, "n0", 100)
    )
    scopes = frame("model_group_id bigint", (100,))
    got = op.reconcile(t.access_group, source, scopes, "access_group_id", "model_group_id", ["security_level", "ad_name"])
    assert rows_of(got) == [
        (1, 5, "renamed", 100, "U"), (2, 1, "two", 100, "D"), (3, 1, "three", 200, "keep"), (4, 2, "n0", 100, "I"),
        (5, 2, "n3", 100, "I"),
    ]
    assert rows_of(op.applied(got), "access_group_id") == [(1,), (3,), (4,), (5,)]


def test_an_empty_source_empties_its_scope_only(tables, frame):
    t = tables(super_user_group=[(1, "a", 100), (2, "b", 200)])
    source = frame(BATCHES["super_user_groups"].replace(" not null", ""))
    got = registry.reconcile_super_groups(t, source, frame("model_group_id bigint", (100,)))
    assert rows_of(op.applied(got)) == [(2, "b", 200)]


def model(model_id, version=4, group=1, rollback=None):
    return (model_id, f"f{version}", AT, True, version, group, rollback, None, None, None, False)


def test_new_version_and_rollback(tables, frame):
    t = tables(model=[model(1), model(2)])
    updated = registry.new_versions(t, frame("model_id bigint, filename string, version int", (1, "f5", 5)), now())
    columns = ("model_id", "version", "filename", "last_rollback", "rollback_filename")
    assert rows_of(updated, *columns) == [(1, 5, "f5", 4, "f4"), (2, 4, "f4", None, None)]
    back = registry.rollback_versions(t.replace(model=updated), frame("model_id bigint", (1,)))
    assert rows_of(back, *columns) == [(1, 4, "f4", 4, None), (2, 4, "f4", None, None)]


def test_update_models_touches_its_groups_only(tables, frame):
    t = tables(
        model_group=[(1, "g", False, "i", 1), (2, "h", False, "j", 1)], model=[model(1), model(2, group=2)],
        access_group=[(1, 1, "a", 1), (2, 1, "b", 2)], super_user_group=[(1, "a", 1), (2, "b", 2)],
    )
    done = registry.update_models(
        t, frame("model_group_id bigint, name string, instances int", (1, "renamed", 3)),
        frame("model_id bigint, filename string, version int, model_group_id bigint", (1, "f5", 5, 1)),
        frame(BATCHES["access_groups"].replace(" not null", ""), (9, 7, "new", 1)),
        frame(BATCHES["super_user_groups"].replace(" not null", ""), (1, "kept", 1)), now(),
    )
    assert rows_of(done.model_group, "name", "instances") == [("h", 1), ("renamed", 3)]
    assert rows_of(done.access_group) == [(2, 1, "b", 2), (3, 7, "new", 1)]
    assert rows_of(done.super_user_group) == [(1, "kept", 1), (2, "b", 2)]
    assert rows_of(done.model, "model_id", "version") == [(1, 5), (2, 4)]


def test_add_users_numbers_logins(tables, frame):
    t = tables(user=[user(4)])
    fresh = frame("login string, sec_level int, is_power_user boolean, is_admin_user boolean", ("b", 1, False, False), ("a", 2, True, False))
    assert rows_of(registry.add_users(t, fresh), "user_id", "login") == [(5, "a"), (6, "b")]


def test_group_access_level_is_null_without_a_grant(tables, frame):
    t = tables(model=[model(1), model(2, group=2)], access_group=[(1, 3, "a", 1), (2, 9, "b", 1), (3, 5, "a", 1)])
    got = security.group_access_level(t, frame("item string", ("a",)), frame("model_id bigint", (1,), (2,)))
    assert rows_of(got) == [(1, 5), (2, None)]


def test_model_group_details_needs_both_kinds(tables, frame):
    t = tables(
        model_group=[(1, "g", False, "i", 1), (2, "h", False, "j", 1)], model=[model(1), model(2, group=2)],
        access_group=[(1, 1, "a", 1), (2, 1, "b", 2)], super_user_group=[(7, "s", 1)],
    )
    got = security.model_group_details(t, frame("model_group_id bigint", (1,), (2,)))
    assert rows_of(got, "model_id", "grant_kind", "grant_id") == [(1, "access", 1), (1, "super", 7)]


def test_check_keys_reports_each_rule(tables):
    t = tables(
        attribute=[attribute(10)], dataset=[dataset(1), dataset(1)], value=[(1, 10, 1.0, False), (1, 99, 1.0, False)],
        scenario=[scenario(1, 1, 1), scenario(2, 1, 1)],
    )
    got = set(rows_of(op.check_keys(t, ["attribute", "dataset", "value", "scenario"])))
    assert ("dataset", "unique", "dataset_id", "1") in got
    assert ("value", "reference", "attr_id", "99") in got
    assert ("scenario", "unique", "view_dataset_id", "1") in got
    assert len(got) == 3


def test_typed_input(frame):
    text = frame("dataset_id string, object_path string, attr_name string, value string", ("1", "p", "a", "2.5"), ("2", None, "a", "1"))
    assert rows_of(incomplete_rows(text, BATCHES["calculated"]), "dataset_id") == [("2",)]
    assert rows_of(as_input(text.where("dataset_id = '1'"), BATCHES["calculated"])) == [(1, "p", "a", 2.5)]
    with pytest.raises(Exception, match="object_path is required"):
        as_input(text, BATCHES["calculated"]).collect()


def test_seed_rows(spark):
    seeds = seed_reference(spark)
    assert {name: df.count() for name, df in seeds.items()} == {
        "audit_category": 28, "unit_format": 35, "dataset_category": 4, "grouping": 0
    }
    assert rows_of(seed_reference(spark, "First")["grouping"]) == [(1, False, "First")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dimension_joins_agree_above_and_below_the_limit(spark, how, monkeypatch):
    monkeypatch.setattr(sizes, "PART_ROWS", 100)
    # A third of all facts has one key, some have none.
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 != 0, F.col("id"))
    facts = spark.range(3000).select(key.alias("k"), "id")
    dim = spark.range(0, 2000, 2).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    assert is_small(dim) and not is_small(dim, limit=1000)
    near = join_dimension(facts, dim, ["k"], "id", how)
    far = join_dimension(facts, dim, ["k"], "id", how, small=False)
    assert rows_of(near) == rows_of(far) == rows_of(facts.join(dim, "k", how))
    assert near.columns == far.columns
    assert "broadcast" in near._jdf.queryExecution().optimizedPlan().toString()
    # Only the hot keys are broadcast.
    assert "name" not in "".join(
        line for line in far._jdf.queryExecution().optimizedPlan().toString().split("\n") if "broadcast" in line
    )


def test_a_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sizes, "PART_ROWS", 500)
    facts = spark.range(4000).select(F.lit(1).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = join_dimension(facts, spark.range(3).select(F.col("id").alias("k")), ["k"], "id", small=False)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 4000


@pytest.mark.parametrize("with_action", [False, True])
def test_a_large_upsert_shuffles_each_side_once(tables, frame, spark, with_action, monkeypatch):
    cells = "dataset_id bigint, attr_id bigint, value double, is_calc_redundant boolean"
    target = frame(cells, (1, 1, 1.0, True), (1, 2, 2.0, True), (1, 2, 2.5, False), (None, 3, 3.0, True), (2, 1, None, None))
    source = frame("dataset_id bigint, attr_id bigint, value double", (1, 2, 9.0), (2, 1, 8.0), (None, 3, 7.0), (5, 5, None))
    args = (target, source, ["dataset_id", "attr_id"], ["value"], "value", with_action)
    near = op.upsert(*args)
    monkeypatch.setattr(op, "packed", lambda df: (df, False))
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = op.upsert(*args)
        assert planned(far).count("Exchange hashpartitioning") == 2
        assert rows_of(far) == rows_of(near) and far.columns == near.columns and far.count() == 7
        twice = op.upsert(target, source.union(source), *args[2:])
        with pytest.raises(Exception, match="duplicate key"):
            twice.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_rows_of_files_stay_in_place_when_many_keys_go(spark, monkeypatch):
    wide = spark.range(0, 90_000, numPartitions=3).select(
        (F.col("id") % 700).alias("a"), F.col("id").alias("b"), F.concat(F.lit("text "), "id").alias("c")
    )
    keys = wide.where("b % 3 = 0 or b % 8 > 5").select("a", "b").union(spark.createDataFrame([(None, 1), (1, None)], "a bigint, b bigint"))
    want = wide.where("not (b % 3 = 0 or b % 8 > 5)").union(spark.createDataFrame([(None, 1, "n")], wide.schema))
    stored = held(wide.union(spark.createDataFrame([(None, 1, "n")], wide.schema)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = op.without_keys(stored, keys, ["a", "b"])
        assert "Exchange hashpartitioning" not in planned(got) and got.columns == wide.columns
        assert rows_of(got) == rows_of(want)
        # Rows that are not read from files, and bitmaps too large to be sent.
        assert rows_of(op.without_keys(wide, keys, ["a", "b"])) == rows_of(want.where("a is not null"))
        assert op.without_keys(stored, keys.limit(0), ["a", "b"]).count() == 90_001
        monkeypatch.setattr(op, "BITMAP_BYTES", 10**9)
        assert rows_of(op.without_keys(stored, keys, ["a", "b"])) == rows_of(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_held_rows_leave_the_setting_as_it_was(spark, frame):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = frame("a bigint, b string", (1, None), (None, "x"), (1, None))
    assert rows_of(held(rows.groupBy("a", "b").count())) == rows_of(rows.groupBy("a", "b").count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
