"""Tables kept in versions under one manifest.

Every table is laid out in buckets of its first key column; inside a bucket files are split by ranges of a second one.
A version is one manifest: for each file its table, bucket, number of rows and range of the second column. A write adds
files for the touched buckets only, and becomes visible, for all tables at once, when the next manifest appears; it is one
file, so it appears whole or not at all. A write that dies before that leaves some unused files and the old version.

Readers open one manifest and hand Spark only the files that can hold what is asked for. File names go through the
driver; rows never do. Files of former versions stay, so a reader in progress is not disturbed.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverwise.functions.sizes import join_dimension
from leverwise.session import cut_lineage
from leverwise.sources.schemas import KEYS, TABLES
from leverwise.sources.tables import Tables

MANIFEST = "table string, bucket int, file string, n_rows bigint, low bigint, high bigint, key string, split string, buckets int"
# Row of the manifest that describes the layout of a table instead of a file.
LAYOUT = -1
BUCKETS = 32
# Asked ids up to this number also become a filter of the scan.
PUSHED_IDS = 500


class Layout(NamedTuple):
    """Column that picks the bucket, column whose ranges split a bucket into files, number of buckets."""

    key: str
    split: str
    buckets: int


class Slice(NamedTuple):
    """All rows of the touched groups of a table; ``touched`` holds their keys."""

    rows: DataFrame
    touched: DataFrame


def default_layout(table: str, buckets: int = BUCKETS) -> Layout:
    """The first column of the table's key and the second one, or the first again."""
    key = KEYS.get(table, (TABLES[table].split()[0],))
    return Layout(key[0], key[1] if len(key) > 1 else key[0], buckets)


def _bucket(layout: Layout) -> Column:
    # By hash: neighbouring ids, which often arrive together, spread over the buckets.
    return F.pmod(F.xxhash64(F.col(layout.key)), F.lit(layout.buckets)).cast("int")


def _write_files(df: DataFrame, root: str, table: str, layout: Layout) -> DataFrame:
    """Write rows to new files; their lines of the manifest."""
    folder = f"data/{table}/write={uuid.uuid4().hex}"
    placed = df.withColumn("bucket", _bucket(layout))
    ranged = placed.repartitionByRange("bucket", layout.key, layout.split).sortWithinPartitions("bucket", layout.key, layout.split)
    ranged.write.partitionBy("bucket").parquet(f"{root}/{folder}")
    split = F.xxhash64(layout.split) if dict(df.dtypes)[layout.split] == "string" else F.col(layout.split).cast("bigint")
    written = df.sparkSession.read.schema(placed.schema).option("basePath", f"{root}/{folder}").parquet(f"{root}/{folder}")
    file = F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", r"(bucket=[^/]+/[^/]+)$", 1))
    counted = written.groupBy("bucket", F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("n_rows"), F.min(split).alias("low"), F.max(split).alias("high")
    )
    return counted.select("bucket", file.alias("file"), "n_rows", "low", "high", F.lit(table).alias("table"))


def _commit(manifest: DataFrame, root: str, version: int) -> None:
    """Make a version visible; fails if another writer has taken its number."""
    path = f"{root}/manifest/version={version}"
    manifest.select(*[part.split()[0] for part in MANIFEST.split(", ")]).coalesce(1).write.mode("errorifexists").parquet(path)


class Store:
    """One version of the tables below ``root``, the newest unless one is named."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root
        if version is None:
            version = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{root}/manifest").agg(F.max("version")).first()[0]
        self.version = version
        self.manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}")
        described = self.manifest.where(F.col("bucket") == LAYOUT).select("table", "key", "split", "buckets").collect()
        self.layouts = {r.table: Layout(r.key, r.split, r.buckets) for r in described}

    def files(self, table: str, groups: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
        """The files that can hold rows of the groups (values of the first column) and splits (of the second)."""
        layout = self.layouts[table]
        held = self.manifest.where((F.col("table") == table) & (F.col("bucket") != LAYOUT))
        if groups is not None:
            held = held.join(groups.select(_bucket(layout).alias("bucket")).distinct(), "bucket", "left_semi")
        if splits is not None:
            edges = splits.agg(F.min(layout.split).cast("bigint").alias("least"), F.max(layout.split).cast("bigint").alias("most")).first()
            held = held.where((F.col("high") >= F.lit(edges.least)) & (F.col("low") <= F.lit(edges.most)))
        return held

    def read(self, table: str, groups: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
        """A table, or its rows of the asked groups; only their files are opened."""
        layout = self.layouts[table]
        paths = sorted(f"{self.root}/{r.file}" for r in self.files(table, groups, splits).select("file").collect())
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        rows = self.spark.read.schema(TABLES[table]).parquet(*paths)
        if groups is None:
            return rows
        ids = groups.select(layout.key).distinct()
        few = [r[0] for r in ids.limit(PUSHED_IDS + 1).collect()]
        if len(few) <= PUSHED_IDS:
            return rows.where(F.col(layout.key).isin([i for i in few if i is not None]))
        return join_dimension(rows, ids, [layout.key], next(c for c in rows.columns if c != layout.key), "left_semi")

    def tables(self) -> Tables:
        """All tables of this version."""
        return Tables(**{name: self.read(name) for name in self.layouts})

    def for_datasets(self, datasets: DataFrame) -> Tables:
        """All tables, values and overrides cut to what questions about these datasets (dataset_id) can need.

        That is the datasets, the bases of their scenarios, and the scenarios that are viewed through any of these.
        """
        t = self.tables()
        asked = datasets.select(F.col("dataset_id").cast("bigint")).distinct()
        bases = t.scenario.join(asked.withColumnRenamed("dataset_id", "view_dataset_id"), "view_dataset_id", "left_semi")
        needed = cut_lineage(asked.union(bases.select("base_dataset_id")).distinct())
        views = t.scenario.join(needed.withColumnRenamed("dataset_id", "view_dataset_id"), "view_dataset_id", "left_semi")
        return t.replace(
            value=self.read("value", needed), scenario_change=self.read("scenario_change", views.select("scenario_id"))
        )

    def write(self, slices: dict[str, Slice]) -> Store:
        """Replace the touched groups of some tables, rewriting only the buckets they live in; the new version."""
        lines = self.manifest
        for table, part in slices.items():
            layout = self.layouts[table]
            keys = cut_lineage(part.touched.select(layout.key).distinct())
            old = self.files(table, keys)
            paths = sorted(f"{self.root}/{r.file}" for r in old.select("file").collect())
            rows = part.rows.select(*[f.split()[0] for f in TABLES[table].split(", ")])
            if paths:
                spread = next(c for c in rows.columns if c != layout.key)
                stored = self.spark.read.schema(TABLES[table]).parquet(*paths)
                rows = rows.unionByName(join_dimension(stored, keys, [layout.key], spread, "left_anti"))
            added = _write_files(rows, self.root, table, layout)
            gone = old.select("table", "file")
            lines = lines.join(gone, ["table", "file"], "left_anti").unionByName(added, allowMissingColumns=True)
        _commit(lines, self.root, self.version + 1)
        return Store(self.spark, self.root, self.version + 1)

    def changed(self, tables: dict[str, DataFrame]) -> dict[str, Slice]:
        """Of whole new tables, the groups in which rows differ from this version."""
        slices = {}
        for table, new in tables.items():
            old, key = self.read(table), self.layouts[table].key
            new = cut_lineage(new.select(*old.columns))
            # One pass over both: a row differs where it does not come as often as before.
            both = new.withColumn("_n", F.lit(1)).union(old.withColumn("_n", F.lit(-1)))
            changed = both.groupBy(*old.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
            touched = cut_lineage(changed.select(key).distinct())
            if not touched.isEmpty():
                slices[table] = Slice(new.join(touched, key, "left_semi"), touched)
        return slices


def create_store(frames: dict[str, DataFrame], root: str, layouts: dict[str, Layout] | None = None) -> Store:
    """Write tables as the first version of a new store."""
    spark = next(iter(frames.values())).sparkSession
    chosen = {name: (layouts or {}).get(name) or default_layout(name) for name in frames}
    described = [(name, LAYOUT, None, None, None, None, *(layout.key, layout.split, layout.buckets)) for name, layout in chosen.items()]
    lines = spark.createDataFrame(described, MANIFEST)
    for name, df in frames.items():
        lines = lines.unionByName(_write_files(df, root, name, chosen[name]), allowMissingColumns=True)
    _commit(lines, root, 0)
    return Store(spark, root, 0)
