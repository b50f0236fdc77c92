"""Writing tables. Nothing here reads a table it is about to truncate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverwise.functions.sizes import join_dimension
from leverwise.session import cut_lineage


def write_snapshot(df: DataFrame, root: str, version: int | str, sort_by: list[str] | None = None) -> str:
    """Write a whole table as a new version directory and return its path.

    Readers keep the former version until they switch. ``sort_by`` clusters rows inside each file, so
    Parquet min/max statistics can skip row groups.
    """
    path = f"{root}/version={version}"
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)
    return path


def append_facts(df: DataFrame, path: str) -> None:
    """Append rows to a history table."""
    df.write.mode("append").parquet(path)


def write_bucketed_groups(df: DataFrame, path: str, group_key: str, buckets: int) -> None:
    """Lay a fact table out in ``bucket`` folders of its group key; key and number are stored next to the table."""
    layout = df.sparkSession.createDataFrame([(group_key, buckets)], LAYOUT)
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}.layout")
    df.withColumn("bucket", _bucket(group_key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


LAYOUT = "group_key string, buckets int"


def _bucket(group_key: str, buckets: int) -> Column:
    return F.pmod(F.col(group_key), F.lit(buckets)).cast("int")


def _stored_layout(spark: SparkSession, path: str) -> tuple[str, int]:
    row = spark.read.schema(LAYOUT).parquet(f"{path}.layout").first()
    return row.group_key, row.buckets


def read_groups(spark: SparkSession, path: str, groups: DataFrame) -> DataFrame:
    """The rows of the given groups; only the folders they live in are read (their numbers go through the driver)."""
    key, buckets = _stored_layout(spark, path)
    ids = groups.select(key).distinct()
    folders = [r.bucket for r in ids.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
    held = spark.read.parquet(path).where(F.col("bucket").isin(folders)).drop("bucket")
    return join_dimension(held, ids, [key], next(c for c in held.columns if c != key), "left_semi")


def overwrite_groups(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Replace the rows of the ``touched`` groups by ``rows`` and rewrite only the folders these groups live in.

    A change to a few groups costs a few folders, not the table. The new rows are computed once, before any folder is
    touched. A folder that is left without a row gets one marking row of nulls in the same commit, which readers
    leave out; nothing is deleted afterwards.
    """
    spark = rows.sparkSession
    key, buckets = _stored_layout(spark, path)
    keys = touched.select(key).distinct()
    folders = [r.bucket for r in keys.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
    stored = spark.read.parquet(path).where(F.col("bucket").isin(folders) & F.col(key).isNotNull())
    untouched = stored.join(keys, key, "left_anti")
    output = cut_lineage(rows.withColumn("bucket", _bucket(key, buckets)).unionByName(untouched))
    filled = {r.bucket for r in output.select("bucket").distinct().collect()}
    marks = spark.createDataFrame([(b,) for b in folders if b not in filled], "bucket int")
    fields = [f for f in output.schema.fields if f.name != "bucket"]
    marked = output.unionByName(marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "bucket"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A spreadsheet-ready copy of an export frame."""
    df.write.mode("overwrite").option("header", True).csv(path)
