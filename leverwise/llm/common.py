"""Shared by the operators of this package: staged tables, bounded Arrow batches, crc folds."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverwise.session import shared_dir

# What a Python worker gets at once: rows and bytes of one Arrow batch.
BATCH_ROWS = 2000
BATCH_BYTES = 16 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: cut lineage that survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next, made where it is missing; only one such thing is kept."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release(but: str | None = None) -> None:
    """Let go of what earlier operators left in this worker, and hand freed memory back to the machine."""
    for name in [n for n in _held if n != but]:
        del _held[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_arrow(
    df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None
) -> DataFrame:
    """``mapInArrow`` whose workers hold nothing after a task but what is ``kept`` under the name ``keeps``."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from work(batches)
        release(keeps)

    return df.mapInArrow(run, schema)


def tidied(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same work on groups of rows, whose workers hand freed memory back after each group."""

    def run(*groups: pa.Table) -> pa.Table:
        made = work(*groups)
        release()
        return made

    # Spark tells by the signature whether it passes a key.
    return {1: lambda rows: run(rows), 2: lambda left, right: run(left, right)}[work.__code__.co_argcount]


def ids_and_texts(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, whatever else the table holds."""
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *more)


def fold(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))
