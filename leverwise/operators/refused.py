"""Rows that a batch cannot use: kept with the rule they break, and replayed when what they lacked has come.

All operators share one table of refused rows, so one reader sees what is open whatever it was meant for. The row itself
is JSON and comes back with the schema of its batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.sources.tables import Tables

REFUSED = "batch string not null, target string not null, rule string not null, payload string not null"
UNKNOWN_PATH, UNKNOWN_END = "unknown external path", "unknown edge end"


def refuse(rows: DataFrame, batch: str | Column, target: str, rule: str) -> DataFrame:
    """The rows as refused rows of a batch; ``target`` names what they were meant for."""
    batch = F.lit(batch) if isinstance(batch, str) else batch
    kept = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(batch.alias("batch"), F.lit(target).alias("target"), F.lit(rule).alias("rule"), kept.alias("payload"))


def refused_rows(refused: DataFrame, target: str, schema: str) -> DataFrame:
    """The rows that were meant for a target, as they came, to be given to its operator once more."""
    own = refused.where(F.col("target") == target)
    return own.select(F.from_json("payload", schema.replace(" not null", "")).alias("row")).select("row.*")


def unknown_paths(t: Tables, rows: DataFrame, scope_by_model: bool = False) -> DataFrame:
    """Batch rows whose external path (object_path, attr_name) names no attribute; an import leaves these out."""
    key = ["object_path", "attr_name", *(["model_id"] if scope_by_model else [])]
    return rows.join(t.external_attr.select(*key).distinct(), key, "left_anti").select(*rows.columns)


def unknown_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of imported trees that lack a node at either end, or whose tree has no nodes at all."""
    named = nodes.select("structure_name", F.col("node_id").alias("_id")).distinct()
    found = edges.join(
        named.withColumnRenamed("_id", "parent_id").withColumn("_parent", F.lit(True)), ["structure_name", "parent_id"], "left"
    ).join(named.withColumnRenamed("_id", "child_id").withColumn("_child", F.lit(True)), ["structure_name", "child_id"], "left")
    return found.where("_parent is null or _child is null").select(*edges.columns)
