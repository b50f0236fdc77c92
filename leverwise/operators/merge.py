"""Rewrites of keyed tables: upsert, patch, reconcile, and the checks that go with them.

Parquet tables take no MERGE or UPDATE, so each function returns the new rows. All are written as left,
semi and anti joins rather than one full outer join: a small batch is then broadcast by size and the large
table is not shuffled at all, and adaptive execution can split a hot key, which it cannot in a full outer join.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import BROADCAST_BYTES, by_shuffle, join_dimension, packed
from leverwise.sources.schemas import KEYS, REFERENCES, TABLES, UNIQUE
from leverwise.session import cut_lineage
from leverwise.sources.tables import Tables, complete_rows


def unique_by(df: DataFrame, key: list[str]) -> DataFrame:
    """The same rows; the job stops if a key occurs twice (as a MERGE would)."""
    others = [c for c in df.columns if c not in key]
    counted = df.groupBy(*key).agg(*[F.first(c).alias(c) for c in others], F.count("*").alias("_n"))
    text = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
    once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"duplicate key ({', '.join(key)}): "), text)).cast("boolean")
    )
    # As a filter, so the key stays as it is and a join by it needs no other shuffle.
    return counted.where(once).select(*df.columns)


def patch_rows(target: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Overwrite the columns that ``patches`` brings, on the rows it names; NULL is a value like any other."""
    changed = [c for c in patches.columns if c not in key]
    marked = unique_by(patches, key).select(
        *key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit")
    )
    hit = F.col("_hit").isNotNull()
    return target.join(marked, key, "left").select(
        *[
            F.when(hit, F.col(f"_new_{c}").cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in target.columns
        ]
    )


def missing_from(source: DataFrame, target: DataFrame, key: list[str], small: bool = False) -> DataFrame:
    """Source rows whose key the target lacks. The target is first cut to the keys of the source.

    A ``small`` source is broadcast for that, so the target stays where it is.
    """
    keys = source.select(*key)
    present = target.select(*key).join(F.broadcast(keys) if small else keys, key, "left_semi")
    return source.join(present, key, "left_anti")


def upsert(
    target: DataFrame, source: DataFrame, key: list[str], update: list[str], table: str, with_action: bool = False
) -> DataFrame:
    """Update ``update`` columns where the key matches, insert the other source rows with defaults."""
    source, small = packed(source)
    source = unique_by(source, key)
    if not small:
        return _upsert_large(target, source, key, update, table, with_action)
    marked = source.select(*key, *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    kept = target.join(F.broadcast(marked), key, "left").select(
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
          for c in target.columns],
        *([F.when(hit, "U").otherwise("keep").alias("action")] if with_action else []),
    )
    added = complete_rows(missing_from(source, target, key, small), table).select(*target.columns)
    if with_action:
        added = added.withColumn("action", F.lit("I"))
    return kept.unionByName(added)


def _upsert_large(
    target: DataFrame, source: DataFrame, key: list[str], update: list[str], table: str, with_action: bool
) -> DataFrame:
    """``upsert`` from a source too large to be broadcast: each side is shuffled once, for updates and inserts together.

    The source's keys are unique, so no key is hot in the full outer join unless the target repeats it.
    """
    row = complete_rows(source, table).select(*target.columns)
    marked = row.select(*key, F.struct(*[c for c in row.columns if c not in key]).alias("_new"))
    both = target.withColumn("_held", F.lit(True)).join(marked, key, "full_outer")
    hit, present = F.col("_new").isNotNull(), F.col("_held").isNotNull()

    def merged(c: str) -> Column:
        return F.when(hit if c in update else ~present, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)

    action = F.when(~present, "I").when(hit, "U").otherwise("keep").alias("action")
    return both.select(
        *[F.col(c) if c in key else merged(c) for c in target.columns], *([action] if with_action else [])
    )


def splice(table: DataFrame, slice_rows: DataFrame, touched: DataFrame, key: str | list[str]) -> DataFrame:
    """The table with all rows of the touched groups exchanged for ``slice_rows``."""
    key = [key] if isinstance(key, str) else key
    spread = next(c for c in ("attr_id", *table.columns) if c in table.columns and c not in key)
    kept = join_dimension(table, touched.select(*key).distinct(), key, spread, "left_anti").select(*table.columns)
    return kept.unionByName(slice_rows.select(*table.columns))


# Bytes of a bitmap and of its key.
BITMAP_BYTES = 4096 + 64


def without_keys(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not among ``keys``, which are too many to be broadcast.

    Wide rows read from Parquet files stay where they are: only their keys and places are shuffled, and the places found
    come back as bitmaps, one bit for each row. Other rows are shuffled whole.
    """
    try:
        placed = rows.select("*", F.xxhash64("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))
    except AnalysisException:
        return rows.join(by_shuffle(keys), key, "left_anti")
    place = ["_file", F.bitmap_bucket_number("_row").alias("_block")]
    position = F.bitmap_bit_position("_row").cast("int")
    found = placed.select(*key, "_file", "_row").join(by_shuffle(keys), key, "left_semi")
    marks = cut_lineage(found.groupBy(*place).agg(F.bitmap_construct_agg(position).alias("_marks")))
    files = rows.sparkSession.createDataFrame([(f,) for f in rows.inputFiles()], "path string")
    told_apart = files.select(F.xxhash64("path")).distinct().count() == files.count()
    if not told_apart or marks.count() * BITMAP_BYTES > BROADCAST_BYTES:
        return rows.join(by_shuffle(keys), key, "left_anti")
    byte = F.substring("_marks", F.shiftright(position, 3) + 1, F.lit(1))
    marked = F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), position.bitwiseAND(7)) == 1
    blocks = placed.withColumn("_block", place[1])
    kept = blocks.join(F.broadcast(marks), ["_file", "_block"], "left").where(F.col("_marks").isNull() | ~marked)
    # The key first, as a join by it would give the columns.
    return kept.select(*key, *[c for c in rows.columns if c not in key])


def reconcile(
    target: DataFrame, source: DataFrame, scopes: DataFrame, key: str, scope: str, update: list[str]
) -> DataFrame:
    """Three-way merge inside the given scopes, as rows with an ``action``.

    ``U`` updated, ``I`` inserted under a new id, ``D`` to be removed, ``keep`` outside every scope.
    Drop the ``D`` rows (``applied``) to get the new table.
    """
    source = unique_by(source.join(scopes, scope, "left_semi"), [key, scope])
    named = scopes.select(scope).distinct().withColumn("_scoped", F.lit(True))
    marked = source.select(key, scope, *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_hit"))
    hit, scoped = F.col("_hit").isNotNull(), F.col("_scoped").isNotNull()
    old = (
        target.join(named, scope, "left")
        .join(marked, [key, scope], "left")
        .select(
            *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
              for c in target.columns],
            F.when(hit, "U").when(scoped, "D").otherwise("keep").alias("action"),
        )
    )
    fresh = missing_from(source, target, [key, scope])
    numbered = assign_ids(
        fresh.withColumnRenamed(key, "_source_key"), key, [scope, "_source_key"], next_id(target, key)
    )
    return old.unionByName(numbered.select(*target.columns, F.lit("I").alias("action")))


def applied(reconciled: DataFrame) -> DataFrame:
    """The table a reconcile leaves behind."""
    return reconciled.where("action <> 'D'").drop("action")


def _as_text(columns: tuple[str, ...] | list[str]) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def check_keys(t: Tables, tables: list[str]) -> DataFrame:
    """Broken keys, unique columns, references and required values as rows (table, rule, columns, key).

    Required values and references of a table are checked in one pass over it: each row lists what it lacks
    and what it points at, and these lists shrink to distinct entries before they meet the referenced tables.
    """
    found: list[DataFrame] = []

    def finding(table: str, rule: str, column: Column, key: Column) -> list[Column]:
        return [
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), column.alias("columns"), key.alias("key")
        ]

    for table in tables:
        df = getattr(t, table)
        uniques = ([KEYS[table]] if table in KEYS else []) + [(c,) for name, c in UNIQUE if name == table]
        for columns in uniques:
            repeated = df.na.drop(subset=list(columns)).groupBy(*columns).count().where("count > 1")
            found.append(repeated.select(*finding(table, "unique", F.lit(",".join(columns)), _as_text(columns))))
        required = [part.split()[0] for part in TABLES[table].split(", ") if part.endswith("not null")]
        absent = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
        lacking = df.select(
            F.explode(F.filter(absent, lambda c: c.isNotNull())).alias("_column"),
            _as_text(KEYS.get(table, required)).alias("_key"),
        )
        found.append(lacking.select(*finding(table, "required", F.col("_column"), F.col("_key"))))
        references = [(c, other, o) for name, c, other, o in REFERENCES if name == table and other in tables]
        if references:
            pointers = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_id")) for c, _, _ in references])
            used = df.select(F.explode(pointers).alias("_p")).select("_p.*").where("_id is not null").distinct()
            known = None
            for column, other, other_column in references:
                ids = getattr(t, other).select(F.lit(column).alias("_column"), F.col(other_column).alias("_id"))
                known = ids if known is None else known.unionByName(ids)
            orphans = used.join(known, ["_column", "_id"], "left_anti")
            found.append(orphans.select(*finding(table, "reference", F.col("_column"), F.col("_id").cast("string"))))
    # Paired up level by level: the plan is analyzed anew at each union, so a long chain would be slow.
    while len(found) > 1:
        found = [a[0].unionByName(a[1]) if len(a) == 2 else a[0] for a in (found[i:i + 2] for i in range(0, len(found), 2))]
    return found[0]
