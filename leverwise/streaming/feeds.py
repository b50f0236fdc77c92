"""Streams of scenario changes and audit entries, each micro-batch handled by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from leverwise.operators.overlay import apply_changes, change_log, latest_changes
from leverwise.session import cut_lineage
from leverwise.sources.tables import Tables

DELTA = ["scenario_id", "attr_id", "new_value", "is_revert", "user_id"]
# Numbers of the deltas that no micro-batch writes: an empty one, and what older deltas were folded into.
PREPARED, COMPACTED = -2, -1


def start_change_feed(t: Tables, feed: DataFrame, root: str, order: list[str]) -> None:
    """Prepare the delta folder, so it can be read before the first micro-batch.

    Only the folder of this preparation is written: a job may call it at every start, also on a compacted root.
    """
    fields = {f.name: f.dataType for f in feed.schema.fields}
    empty = t.scenario_change.limit(0).select(
        *[F.lit(None).cast(fields[c]).alias(c) for c in dict.fromkeys([*DELTA, *order])]
    )
    empty.write.mode("overwrite").parquet(f"{root}/delta/batch={PREPARED}")


def apply_changes_stream(
    tables: Callable[[], Tables], feed: DataFrame, root: str, now: Column, order: list[str],
    trigger: dict | None = None, progress: str | None = None,
) -> StreamingQuery:
    """Take in a stream of change rows (scenario_id, attr_id, new_value, is_revert, user_id, and the order).

    The last row of a key by ``order`` wins, in whatever micro-batch it comes; so the delta keeps the order. A
    micro-batch writes only its own delta and log folder, whatever the size of the change table, and a repeated
    micro-batch overwrites its first attempt instead of counting twice. ``tables`` is asked anew for each
    micro-batch, so its log sees the values of that time. ``current_changes`` reads the outcome.
    """

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        t = tables()
        delta = latest_changes(rows, order).select(*dict.fromkeys([*DELTA, *order]))
        delta.write.mode("overwrite").parquet(f"{root}/delta/batch={batch_id}")
        stored = t.scenario_change.sparkSession.read.parquet(f"{root}/delta/batch={batch_id}")
        change_log(t, stored, now).write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")

    return (
        feed.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", progress or f"{root}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _deltas(t: Tables, root: str) -> DataFrame:
    return t.scenario_change.sparkSession.read.parquet(f"{root}/delta")


def current_changes(t: Tables, root: str, order: list[str]) -> DataFrame:
    """The change table with all deltas so far: the last row of a key by ``order`` decides, then the micro-batch."""
    return apply_changes(t, latest_changes(_deltas(t, root), [*order, "batch"]))


def compact_changes(t: Tables, root: str, new_root: str, order: list[str]) -> None:
    """Fold all deltas into one, the last row of each key, as the first delta of a new root.

    Run it between two runs of the stream, and go on with the new root and the ``progress`` folder of the first one.
    Rows stay with their order, so a late event is still judged rightly.
    """
    last = latest_changes(_deltas(t, root), [*order, "batch"]).drop("batch")
    last.write.mode("errorifexists").parquet(f"{new_root}/delta/batch={COMPACTED}")


def append_facts_stream(feed: DataFrame, path: str, progress: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of audit entries to their history; the file sink writes each micro-batch once."""
    return (
        feed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def append_new_facts_stream(
    feed: DataFrame, path: str, progress: str, key: list[str], time: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream of entries to their history, each key once, however often and late an entry is delivered.

    A repeated entry has the time of the first one. The history is kept by day, and a micro-batch looks for its keys only
    in the days that it has entries of, whatever their age: nothing is lost to a watermark, and no state grows with the
    history. A repeated micro-batch overwrites its own first attempt and does not take that for history.
    """
    columns = feed.columns

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        fresh = cut_lineage(rows.dropDuplicates(key).withColumn("day", F.to_date(time)))
        days = [r.day for r in fresh.select("day").distinct().collect()]
        if not days:
            return
        if batch_id:
            history = _batches(spark, path, feed.schema).where(F.col("day").isin(days) & (F.col("batch") != batch_id))
            fresh = fresh.join(history.select(*key), key, "left_anti")
        fresh.select(*columns, "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")

    return (
        feed.writeStream.foreachBatch(one_batch).option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    parts = StructType([*schema.fields, StructField("batch", LongType()), StructField("day", DateType())])
    return spark.read.schema(parts).option("ignoreMissingFiles", "true").parquet(path)


def read_facts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The history that ``append_new_facts_stream`` has written."""
    return _batches(spark, path, schema).select(*schema.names)


def audit_rows(events: DataFrame) -> DataFrame:
    """Event rows as audit entries."""
    return events.select(
        F.col("event_id").alias("audit_id"), F.col("ts").alias("audit_date"),
        (F.col("event_id") % 7 + 1).alias("category"), (F.col("event_id") % 21 + 8).alias("sub_category"), "user_id",
    )
