"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.session import cut_lineage

# monotonically_increasing_id() holds the partition number above these bits and the row number in them.
ROW_BITS = 33


def next_id(df: DataFrame, column: str) -> int:
    """One more than the highest id in use, 1 for an empty table."""
    return (df.agg(F.max(column).alias("top")).first().top or 0) + 1


def assign_ids(df: DataFrame, id_column: str, order_by: list[str], start: int) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... in the order of ``order_by`` (which must be unique).

    Rows are range-partitioned by the order, so each task numbers its own slice and only one count per
    partition reaches the driver. The ranges come from a sample, hence the checkpoint: both passes must
    see the same partitions, also after a lost executor.
    """
    ranged = cut_lineage(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by))
    numbered = ranged.select("*", F.monotonically_increasing_id().alias("_row"))
    partition = F.shiftright("_row", ROW_BITS)
    counts = {
        row.part: row.n
        for row in numbered.groupBy(partition.alias("part")).agg(F.count("*").alias("n")).collect()
    }
    offsets, total = [], start
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    if not offsets:
        return df.limit(0).withColumn(id_column, F.lit(None).cast("bigint"))
    first = F.element_at(F.lit(offsets), (partition + 1).cast("int"))
    in_partition = F.col("_row") - F.shiftleft(partition, ROW_BITS)
    return numbered.withColumn(id_column, (first + in_partition).cast("bigint")).drop("_row")
