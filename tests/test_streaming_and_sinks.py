from __future__ import annotations

from conftest import rows_of
from pyspark.sql import functions as F

from leverwise.operators.overlay import apply_changes, latest_changes
from leverwise.plans.registered.common import now
from leverwise.sources.sinks import append_facts, export_csv, overwrite_groups, read_groups, write_bucketed_groups, write_snapshot
from leverwise.sources.tables import load_tables
from leverwise.streaming.feeds import (
    append_facts_stream,
    append_new_facts_stream,
    apply_changes_stream,
    audit_rows,
    compact_changes,
    current_changes,
    read_facts,
    start_change_feed,
)
from test_overlay import scenario

FEED = "event_id bigint, scenario_id bigint, attr_id bigint, new_value double, is_revert boolean, user_id bigint"


def test_change_stream_over_several_batches_equals_one_batch(tables, frame, spark, tmp_path):
    t = tables(
        scenario=[scenario(1, 8, 9)], value=[(9, a, float(a), False) for a in range(6)],
        scenario_change=[(1, 0, 5.0), (1, 1, 6.0)],
    )
    files = [
        [(1, 1, 0, 7.0, False, 1), (2, 1, 0, 8.0, False, 1), (3, 1, 1, 0.0, True, 1)],
        [(4, 1, 2, 9.0, False, 1), (5, 1, 0, 1.0, True, 1)],
        [(6, 1, 1, 4.0, False, 2)],
    ]
    for number, rows in enumerate(files):
        frame(FEED, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={number}")
    root = f"{tmp_path}/out"
    order = ["event_id"]
    start_change_feed(t, frame(FEED), root, order)
    assert rows_of(current_changes(t, root, order)) == rows_of(t.scenario_change)

    def run():
        feed = spark.readStream.schema(FEED + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        apply_changes_stream(lambda: t, feed.drop("part"), root, now(), order).awaitTermination()

    run()
    together = latest_changes(frame(FEED, *[r for rows in files for r in rows]), ["event_id"]).drop("event_id")
    assert rows_of(current_changes(t, root, order)) == rows_of(apply_changes(t, together))
    assert rows_of(current_changes(t, root, order)) == [(1, 1, 4.0), (1, 2, 9.0)]
    logged = spark.read.parquet(f"{root}/log").count()
    run()  # nothing new: nothing counted twice
    assert spark.read.parquet(f"{root}/log").count() == logged == 5


def test_a_late_event_does_not_win(tables, frame, spark, tmp_path):
    t = tables(scenario=[scenario(1, 8, 9)], value=[(9, 1, 1.0, False)])
    later = tables(scenario=[scenario(1, 8, 9)], value=[(9, 1, 5.0, False)])
    root, order = f"{tmp_path}/out", ["event_id"]
    start_change_feed(t, frame(FEED), root, order)

    def run(rows, bundle, target, progress):
        frame(FEED, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(FEED).parquet(f"{tmp_path}/in")
        apply_changes_stream(lambda: bundle, feed, target, now(), order, progress=progress).awaitTermination()

    run([(20, 1, 1, 200.0, False, 1)], t, root, f"{root}/progress")
    compact_changes(t, root, f"{root}/2", order)
    run([(10, 1, 1, 100.0, False, 1)], later, f"{root}/2", f"{root}/progress")
    assert rows_of(current_changes(t, f"{root}/2", order)) == [(1, 1, 200.0)]
    # The log of the second run sees the values of its time.
    assert rows_of(spark.read.parquet(f"{root}/2/log"), "old_value", "new_value") == [(5.0, 100.0)]


def test_audit_stream_appends(frame, spark, tmp_path):
    events = frame("event_id bigint, ts timestamp_ntz, user_id bigint").schema
    rows = spark.range(20).select("id", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("id")).toDF(*events.names)
    rows.write.parquet(f"{tmp_path}/in")
    feed = audit_rows(spark.readStream.schema(events).parquet(f"{tmp_path}/in"))
    append_facts_stream(feed, f"{tmp_path}/audit", f"{tmp_path}/progress").awaitTermination()
    assert rows_of(spark.read.parquet(f"{tmp_path}/audit")) == rows_of(audit_rows(rows))


def test_overwrite_groups_rewrites_only_touched_folders(frame, spark, tmp_path):
    path = f"{tmp_path}/value"
    ddl = "dataset_id bigint, attr_id bigint, value double"
    write_bucketed_groups(frame(ddl, (0, 1, 1.0), (4, 1, 2.0), (1, 1, 3.0), (2, 1, 4.0)), path, "dataset_id", 4)
    before = {r.f for r in spark.read.parquet(path).where("bucket = 1").select(F.input_file_name().alias("f")).collect()}
    touched = frame("dataset_id bigint", (0,), (2,))
    overwrite_groups(frame(ddl, (0, 7, 9.0)), touched, path)
    held = load_tables(spark, str(tmp_path), ["value"]).value
    assert rows_of(held, "dataset_id", "attr_id", "value") == [(0, 7, 9.0), (1, 1, 3.0), (4, 1, 2.0)]
    assert "bucket" not in held.columns
    asked = read_groups(spark, path, frame("dataset_id bigint", (0,), (2,)))
    assert rows_of(asked) == [(0, 7, 9.0)]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:60]
    after = {r.f for r in spark.read.parquet(path).where("bucket = 1").select(F.input_file_name().alias("f")).collect()}
    assert before == after


def test_snapshots_appends_and_exports(frame, spark, tmp_path):
    df = frame("a bigint, b string", (2, "y"), (1, "x"))
    first = write_snapshot(df, f"{tmp_path}/t", 1, sort_by=["a"])
    second = write_snapshot(spark.read.parquet(first).where("a = 1"), f"{tmp_path}/t", 2)
    assert rows_of(spark.read.parquet(first)) == [(1, "x"), (2, "y")] and rows_of(spark.read.parquet(second)) == [(1, "x")]
    append_facts(df, second)
    assert spark.read.parquet(second).count() == 3
    export_csv(df, f"{tmp_path}/csv")
    assert rows_of(spark.read.option("header", True).csv(f"{tmp_path}/csv")) == [("1", "x"), ("2", "y")]


def test_a_feed_prepared_again_after_compaction_loses_nothing(tables, frame, spark, tmp_path):
    t = tables(scenario=[scenario(1, 8, 9)], value=[(9, a, 1.0, False) for a in range(4)], scenario_change=[(1, 3, 7.0)])
    order, progress = ["event_id"], f"{tmp_path}/progress"
    batches = [[(1, 1, 0, 1.5, False, 1), (2, 1, 1, 2.5, False, 1)], [(3, 1, 0, None, True, 1)], [(4, 1, 2, 4.5, False, 1), (0, 1, 1, 9.0, False, 1)]]
    roots = [f"{tmp_path}/{k}" for k in range(len(batches))]
    for number, rows in enumerate(batches):
        frame(FEED, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(FEED).parquet(f"{tmp_path}/in")
        start_change_feed(t, feed, roots[number], order)
        apply_changes_stream(lambda: t, feed, roots[number], now(), order, progress=progress).awaitTermination()
        start_change_feed(t, feed, roots[number], order)
        if number + 1 < len(batches):
            compact_changes(t, roots[number], roots[number + 1], order)
    together = latest_changes(frame(FEED, *[r for rows in batches for r in rows]), order).drop("event_id")
    got = rows_of(current_changes(t, roots[-1], order))
    assert got == rows_of(apply_changes(t, together)) == [(1, 1, 2.5), (1, 2, 4.5), (1, 3, 7.0)]


def test_entries_count_once_however_often_and_late_they_come(frame, spark, tmp_path):
    ddl = "audit_id bigint, audit_date timestamp_ntz, user_id bigint"
    day = [F.lit(f"2024-01-{d:02d} 10:00:00").cast("timestamp_ntz") for d in (1, 2, 9)]
    schema = frame(ddl).schema

    def entries(*ids):
        return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("audit_id")).select(
            F.col("audit_id").cast("bigint"), F.when(F.col("audit_id") < 10, day[0]).when(F.col("audit_id") < 20, day[1]).otherwise(day[2]).alias("audit_date"),
            (F.col("audit_id") * 2).cast("bigint").alias("user_id"),
        )

    for ids in ([1, 1, 11, 2], [1, 21, 11, 22], [2, 3, 3, 21, 23], [1, 2]):
        entries(*ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        append_new_facts_stream(feed, f"{tmp_path}/out", f"{tmp_path}/progress", ["audit_id"], "audit_date").awaitTermination()
    got = read_facts(spark, f"{tmp_path}/out", schema)
    assert rows_of(got) == rows_of(entries(1, 2, 3, 11, 21, 22, 23))
