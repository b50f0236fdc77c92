"""Driver trees and the calculation graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import by_shuffle, is_small, join_dimension
from leverwise.operators.merge import splice
from leverwise.operators.overlay import cut_to
from leverwise.session import cut_lineage
from leverwise.sources.tables import Tables

# Steps of a graph walk planned in one job.
STEPS_PER_BLOCK = 4


class StructureTables(NamedTuple):
    """Tree tables after an import."""

    vdt_structure: DataFrame
    vdt_node: DataFrame
    vdt_edge: DataFrame


def tree_edges(t: Tables, structure_ids: DataFrame) -> DataFrame:
    """Edges of the chosen trees."""
    return t.vdt_edge.join(structure_ids, "vdt_structure_id", "left_semi").select(
        "vdt_structure_id", "parent_id", "child_id"
    )


def tree_structures(t: Tables) -> DataFrame:
    """All trees."""
    return t.vdt_structure.select("vdt_id", "name")


def import_structure(t: Tables, structures: DataFrame, nodes: DataFrame, edges: DataFrame) -> StructureTables:
    """Find or create the named trees and replace their nodes and edges.

    Nodes and edges name their tree in ``structure_name``; edge ends are external node ids and become the
    new ids of the nodes. Edges with an unknown end are left out.
    """
    names = structures.select("name").distinct()
    numbered = assign_ids(
        names.join(t.vdt_structure, "name", "left_anti"), "vdt_id", ["name"], next_id(t.vdt_structure, "vdt_id")
    )
    structure = t.vdt_structure.unionByName(numbered.select("vdt_id", "name"))
    targets = (
        structure.join(names, "name", "left_semi")
        .groupBy(F.col("name").alias("structure_name"))
        .agg(F.min("vdt_id").alias("vdt_structure_id"))
    )
    small = is_small(targets)
    new_nodes = assign_ids(
        join_dimension(nodes, targets, ["structure_name"], "node_id", small=small), "vdt_node_id",
        ["vdt_structure_id", "node_id", "attribute_id", "name"], next_id(t.vdt_node, "vdt_node_id"),
    )
    ends = new_nodes.select("vdt_structure_id", "node_id", "vdt_node_id")
    linked = (
        join_dimension(edges, targets, ["structure_name"], "child_id", small=small)
        .select("vdt_structure_id", F.col("parent_id").alias("_parent"), F.col("child_id").alias("_child"))
        .join(
            ends.withColumnsRenamed({"node_id": "_parent", "vdt_node_id": "parent_id"}), ["vdt_structure_id", "_parent"]
        )
        .join(ends.withColumnsRenamed({"node_id": "_child", "vdt_node_id": "child_id"}), ["vdt_structure_id", "_child"])
    )
    new_edges = assign_ids(
        linked.select("vdt_structure_id", "parent_id", "child_id"), "vdt_edge_id",
        ["vdt_structure_id", "parent_id", "child_id"], next_id(t.vdt_edge, "vdt_edge_id"),
    )
    touched = targets.select("vdt_structure_id")
    return StructureTables(
        structure,
        splice(t.vdt_node, new_nodes, touched, "vdt_structure_id"),
        splice(t.vdt_edge, new_edges, touched, "vdt_structure_id"),
    )


def reachable_nodes(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node at or below each root, once.

    A frontier walk, a block of steps per job. Pairs are made distinct at every step and dropped if an earlier
    block saw them, so shared branches are walked once and cycles end. Each block is checkpointed; the plan
    stays flat however deep the graph is. The edges meet the frontier in a shuffle, once for each block.
    """
    links = by_shuffle(edges.select(F.col("parent_id").alias("node"), "child_id"))
    frontier = cut_lineage(roots.select("root", F.col("root").alias("node")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        step, steps = frontier, None
        for number in range(1, STEPS_PER_BLOCK + 1):
            step = step.join(links, "node").select("root", F.col("child_id").alias("node")).distinct()
            numbered = step.withColumn("step", F.lit(number))
            steps = numbered if steps is None else steps.unionByName(numbered)
        first = steps.groupBy("root", "node").agg(F.min("step").alias("step"))
        fresh = cut_lineage(first.join(by_shuffle(seen), ["root", "node"], "left_anti"))
        seen = seen.unionByName(fresh.drop("step"))
        frontier = fresh.where(F.col("step") == STEPS_PER_BLOCK).drop("step")
    return seen


def descendants(t: Tables, requests: DataFrame, structure_ids: DataFrame | None = None) -> DataFrame:
    """Tree edges below attributes, with the child node and its flag in the scenario's view dataset.

    ``requests``: (attr_id, scenario_id). The walk runs once per distinct attribute node, not per scenario.
    An attribute with several nodes starts at each of them unless ``structure_ids`` picks trees.
    """
    nodes, edges = t.vdt_node, t.vdt_edge
    if structure_ids is not None:
        nodes = nodes.join(structure_ids, "vdt_structure_id", "left_semi")
    starts = nodes.select(F.col("attribute_id").alias("attr_id"), F.col("vdt_node_id").alias("root"))
    asked = requests.select("attr_id", "scenario_id").distinct().join(by_shuffle(starts), "attr_id")
    below = reachable_nodes(edges, asked.select("root").distinct())
    known = by_shuffle(t.attribute.select(F.col("attr_id").alias("attribute_id")))
    children = by_shuffle(t.vdt_node.join(known, "attribute_id", "left_semi").withColumnRenamed("vdt_node_id", "child_id"))
    # Both sides are distinct, so their join is.
    branch = (
        below.join(by_shuffle(edges.select(F.col("parent_id").alias("node"), "child_id").distinct()), "node")
        .join(children, "child_id")
        .select(
            "root", F.col("child_id").alias("vdt_node_id"), "child_id", F.col("node").alias("parent_id"),
            "attribute_id", "name", "vdt_structure_id",
        )
    )
    views = t.scenario.select("scenario_id", F.col("view_dataset_id").alias("dataset_id"))
    viewed = asked.join(by_shuffle(views), "scenario_id")
    flags = cut_to(t.value.select("dataset_id", "attr_id", "is_calc_redundant"), viewed, "dataset_id")
    flags = flags.withColumnRenamed("attr_id", "attribute_id")
    return (
        viewed
        .join(by_shuffle(branch), "root")
        .join(by_shuffle(flags), ["dataset_id", "attribute_id"])
        .select(
            "attr_id", "scenario_id", "vdt_node_id", "child_id", "parent_id", "attribute_id", "name",
            "vdt_structure_id", "is_calc_redundant",
        )
        .distinct()
    )


def dependencies(t: Tables, models: DataFrame) -> DataFrame:
    """Calculation edges of the models whose target attribute exists."""
    known = t.attribute.select(F.col("attr_id").alias("depends_on_attr_id"))
    return (
        t.attribute_dependency.join(models, "model_id", "left_semi")
        .join(known, "depends_on_attr_id", "left_semi")
        .select("model_id", "attr_id", "depends_on_attr_id")
    )


def replace_dependencies(t: Tables, rows: DataFrame, deps: DataFrame) -> DataFrame:
    """The dependency table after a model import: edges of imported attributes are exchanged, self-edges dropped.

    ``rows`` (model_id, object_path, attr_name) lists the imported attributes; ``deps`` holds external ids.
    The removal looks at the attribute only, whichever model the edge belongs to.
    """
    paths = by_shuffle(t.external_attr)
    imported = (
        rows.select("model_id", "object_path", "attr_name")
        .join(paths, ["model_id", "object_path", "attr_name"])
        .select("attr_id")
    )
    ids = paths.where("ext_attr_id is not null").select("model_id", "ext_attr_id", "attr_id")
    added = (
        deps.join(ids, ["model_id", "ext_attr_id"])
        .join(
            ids.withColumnsRenamed({"ext_attr_id": "depends_on_ext_attr_id", "attr_id": "depends_on_attr_id"}),
            ["model_id", "depends_on_ext_attr_id"],
        )
        .where("attr_id <> depends_on_attr_id")
    )
    return splice(t.attribute_dependency, added, imported, "attr_id")
