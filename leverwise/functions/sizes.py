"""Joining facts with request-sized and dimension frames: broadcast behind a measured size, else split at hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leverwise.session import cut_lineage, held

# A frame up to this size is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Above it, a key with more facts than this is split into parts of about this many.
PART_ROWS = 500_000


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the frame's measured size (rows counted, texts added up) is within the limit.

    The planner estimates a join as the product of its inputs, so a small frame made by a join never looks
    small to it, and the fact table on the other side would be shuffled for nothing.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    size = F.count("*") * F.lit(16 + 8 * len(df.columns))
    for name in texts:
        size = size + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    return df.agg(size.alias("bytes")).first().bytes <= limit


def by_shuffle(df: DataFrame) -> DataFrame:
    """The frame for a join in which it is not to pass through the driver, whatever the planner takes its size for.

    The planner sees the size of packed files: a few MB of them can be hundreds in memory, sent anew by every join.
    """
    return df.hint("merge")


def join_dimension(
    facts: DataFrame, dim: DataFrame, key: list[str], spread: str, how: str = "inner", small: bool | None = None
) -> DataFrame:
    """Join facts (left) with a frame of one or few rows per key (right); inner, left, left_semi or left_anti.

    A small frame is broadcast and the facts stay where they are. Otherwise both sides shuffle by the key. Keys with
    many facts are counted first and split by ``spread``, a fact column that varies within a key: one key may hold a
    third of all facts, and adaptive execution cannot split it where a later join needs the same partitioning. Only
    their rows of the frame are copied, once for each part; there are at most facts / PART_ROWS such keys. Where
    ``spread`` belongs to the key nothing can be split. ``small`` is given when the size is known already.
    """
    if is_small(dim) if small is None else small:
        return facts.join(F.broadcast(dim), key, how)
    if spread in key:
        return facts.join(dim, key, how)
    counted = facts.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > PART_ROWS)
    hot = cut_lineage(counted.select(*key, F.ceil(F.col("_n") / PART_ROWS).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    # Facts without a key match nothing and may go anywhere.
    no_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in key])
    turn = F.pmod(F.hash(spread), F.when(no_key, F.lit(1024)).otherwise(parts))
    salted = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", turn).drop("_parts")
    copies = dim.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(copies.drop("_parts"), [*key, "_salt"], how).drop("_salt")


def by_size(df: DataFrame, small: bool | None = None) -> DataFrame:
    """The frame for the right side of a join: broadcast if it is measured small, else to meet the other in a shuffle."""
    return F.broadcast(df) if (is_small(df) if small is None else small) else by_shuffle(df)


def packed(df: DataFrame) -> tuple[DataFrame, bool]:
    """As ``measured``, in packed files: for frames that may be a good part of the facts."""
    rows = held(df)
    return rows, is_small(rows)


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows, materialised once, and whether they are small enough to broadcast."""
    held = cut_lineage(df)
    return held, is_small(held)
