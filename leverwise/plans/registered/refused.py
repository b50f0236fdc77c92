"""Queries on refused rows: results that come before the attributes they are for, and edges before their nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.operators import overlay as op
from leverwise.operators.merge import splice
from leverwise.operators.refused import UNKNOWN_END, UNKNOWN_PATH, refuse, refused_rows, unknown_ends, unknown_paths
from leverwise.plans.registered.common import now
from leverwise.plans.registered.overlay import MERGED_SQL
from leverwise.session import shared_dir
from leverwise.sources.schemas import BATCHES

RESULTS, EDGES = "dataset_id bigint, object_path string, attr_name string, value double", BATCHES["structure_edges"]


def _before(t):
    """The tables at a time when every third attribute had no external path yet."""
    return t.replace(external_attr=t.external_attr.where("attr_id % 3 <> 0"))


def _refused_results(t) -> DataFrame:
    """Results that name an unknown path at that time, in the shared table of refused rows."""
    root = f"{shared_dir(t.value.sparkSession)}/refused-{uuid.uuid4().hex}"
    refuse(unknown_paths(_before(t), t.calculated), "first", "value", UNKNOWN_PATH).write.parquet(root)
    return t.value.sparkSession.read.parquet(root)


def _listed_results(t) -> DataFrame:
    refused = _refused_results(t)
    rules = refused.select("batch", "target", "rule").distinct()
    return refused_rows(refused, "value", RESULTS).join(rules)


def _replayed_results(t) -> DataFrame:
    """Merged with the paths known at that time; what was refused is merged in once all paths are there."""
    refused = _refused_results(t)
    early = op.merge_calculated(_before(t), t.calculated, now())
    t = t.replace(value=splice(t.value, early.value, early.touched, "dataset_id"), dataset=early.dataset)
    late = op.merge_calculated(t, refused_rows(refused, "value", RESULTS), now())
    stamps = late.dataset.select("dataset_id", "last_update")
    return splice(t.value, late.value, late.touched, "dataset_id").join(stamps, "dataset_id")


def _listed_edges(t) -> DataFrame:
    known = t.new_node.where("node_id % 5 <> 0")
    refused = refuse(unknown_ends(known, t.new_edge), "first", "vdt_edge", UNKNOWN_END)
    return refused_rows(refused, "vdt_edge", EDGES)


QUERIES = {
    "merge_calculated_refused": (
        _listed_results,
        f"""
        select c.*, 'first' as batch, 'value' as target, '{UNKNOWN_PATH}' as rule from {{calculated}} c
        where (object_path, attr_name) not in (select (object_path, attr_name) from {{external_attr}} where attr_id % 3 <> 0)""",
    ),
    "merge_calculated_replayed": (_replayed_results, MERGED_SQL),
    "import_structure_refused": (
        _listed_edges,
        """
        with known as (select structure_name, node_id from {new_node} where node_id % 5 <> 0)
        select e.* from {new_edge} e
        where (structure_name, parent_id) not in (select (structure_name, node_id) from known)
           or (structure_name, child_id) not in (select (structure_name, node_id) from known)""",
    ),
}
