"""Category trees and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.functions.expressions import is_usable_path, path_levels
from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import join_dimension, measured
from leverwise.operators.overlay import base_views, with_override, with_stored
from leverwise.operators.security import may_see, with_level
from leverwise.session import cut_lineage
from leverwise.sources.tables import Tables

# Doublings of the known part of all paths in one job: two reach four levels, four sixteen.
DOUBLINGS = 2

# Template and renderer of screens.
SCREEN_TEMPLATE = "DrillDownTemplate"
SCREEN_RENDERER = "LeverDashboard"


def category_paths(t: Tables, groupings: DataFrame | None = None, one_grouping: bool = False) -> DataFrame:
    """Every category reachable from a root, with the ids and names from the root down to itself.

    ``groupings`` (grouping_id) picks the roots. With ``one_grouping`` a child must be in its parent's grouping.

    Paths grow by doubling: each category holds the steps up to some ancestor, and takes over what that ancestor holds.
    A job makes DOUBLINGS of these and is materialised once, so a tree of any depth takes about log(depth) jobs.
    Categories whose ancestors have no root (cycles, unknown parents) do not appear.
    """
    step = F.struct("category_id", "parent_category_id", "category_name")
    held = t.category.select(
        "category_id", "grouping_id", "parent_category_id", "category_name", F.array(step).alias("path"),
        F.col("parent_category_id").alias("above"), F.col("grouping_id").alias("root_grouping"),
    )
    done = -1
    while True:
        for _ in range(DOUBLINGS):
            upper = held.select(
                F.col("category_id").alias("above"), F.col("path").alias("_path"), F.col("above").alias("_above"),
                F.col("root_grouping").alias("_grouping"), F.col("grouping_id").alias("_own"),
            )
            grown = held.where("above is not null").join(upper, "above")
            if one_grouping:
                grown = grown.where("grouping_id = _own")
            grown = grown.select(
                "category_id", "grouping_id", "parent_category_id", "category_name", F.concat("_path", "path").alias("path"),
                F.col("_above").alias("above"), F.col("_grouping").alias("root_grouping"),
            )
            held = held.where("above is null").unionByName(grown)
        held = cut_lineage(held)
        count = held.agg(F.count_if(F.col("above").isNull()).alias("done"), F.count("*").alias("n")).first()
        # Depths follow on each other: where no path ended, those that are left never will.
        if count.done in (count.n, done):
            break
        done = count.done
    found = held.where("above is null")
    if groupings is not None:
        asked = groupings.select(F.col("grouping_id").alias("root_grouping")).distinct()
        found = found.join(asked, "root_grouping", "left_semi")
    return found.select(
        "category_id", "grouping_id", "parent_category_id", "category_name", "path", F.size("path").alias("level")
    )


def grouping_named(t: Tables, name: str) -> DataFrame:
    """Id of a grouping."""
    return t.grouping.where(F.col("grouping_name") == name).select("grouping_id")


def category_tree(t: Tables, groupings: DataFrame | None = None) -> DataFrame:
    """Categories with their level, root = 1."""
    return category_paths(t, groupings).select(
        "grouping_id", "category_id", "level", "parent_category_id", "category_name"
    )


def category_ancestors(t: Tables, groupings: DataFrame | None = None) -> DataFrame:
    """Each category with every ancestor's level and name, itself included."""
    return category_paths(t, groupings).select(
        "grouping_id", "category_id", F.posexplode("path").alias("_pos", "_step")
    ).select(
        "grouping_id", "category_id", (F.col("_pos") + 1).alias("level"),
        F.col("_step.parent_category_id").alias("parent_category_id"),
        F.col("_step.category_name").alias("category_name"),
    )


def category_level_columns(t: Tables, groupings: DataFrame | None = None, levels: int = 3) -> DataFrame:
    """Names of the first levels above (or at) each category as columns L1, L2, ...

    The walk keeps the path, so the pivot is reading its elements and needs no aggregation.
    """
    names = F.transform("path", lambda step: step["category_name"])
    return (
        category_paths(t, groupings)
        .join(t.grouping.select("grouping_id", "grouping_name"), "grouping_id")
        .select(
            "grouping_id", "grouping_name", "category_id",
            *[F.get(names, F.lit(i)).alias(f"L{i + 1}") for i in range(levels)],
        )
    )


def screen_data(t: Tables, requests: DataFrame, grouping_name: str) -> DataFrame:
    """Levers and KPIs below a screen (first-level category), with shown value, base value and override.

    ``requests``: (screen, dataset_id, user_id). A dataset without scenario is its own base. Both sides need
    a stored value.
    """
    grouping = grouping_named(t, grouping_name)
    columns = category_level_columns(t, grouping).select("category_id", "L1", "L2", "L3")
    shown = (
        t.attribute_category.join(grouping, "grouping_id", "left_semi")
        .select("attr_id", "category_id")
        .join(columns, "category_id")
        .join(t.attribute.where("is_lever or is_kpi").select("attr_id", "sec_level"), "attr_id")
        .select("attr_id", "sec_level", F.col("L1").alias("screen"), "L2", "L3")
    )
    views = t.scenario.select(F.col("view_dataset_id").alias("dataset_id"), "scenario_id")
    bases = t.scenario.groupBy(F.col("view_dataset_id").alias("dataset_id")).agg(
        F.min("base_dataset_id").alias("base_dataset_id")
    )
    asked = (
        with_level(t, requests)
        .join(bases, "dataset_id", "left")
        .withColumn("base_dataset_id", F.coalesce("base_dataset_id", "dataset_id"))
        .join(views, "dataset_id", "left")
        .join(base_views(t), "base_dataset_id", "left")
    )
    # Materialised and measured once; the cuts below have no more ids than this.
    asked, small = measured(asked)
    cells = join_dimension(t.value.drop("is_calc_redundant"), asked, ["dataset_id"], "attr_id", small=small)
    cells = join_dimension(cells, shown, ["attr_id", "screen"], "dataset_id").where(may_see())
    cells = with_stored(cells, t, "base_dataset_id", "base_stored", how="inner", asked=asked, small=small)
    cells = with_override(cells, t, "scenario_id", "override_value", asked, small)
    cells = with_override(cells, t, "base_scenario_id", "base_override", asked, small)
    return cells.drop("sec_level").join(t.attribute, "attr_id").select(
        "screen", "dataset_id", "user_id",
        F.coalesce("L2", F.lit("Summary")).alias("tab_name"), F.coalesce("L3", F.lit("Summary")).alias("panel"),
        F.lit(SCREEN_TEMPLATE).alias("template"),
        F.lit(f'{{"groupings":["{grouping_name}"]}}').alias("config"),
        "attr_id", F.col("attr_name").alias("label"), F.col("attr_name").alias("attribute"),
        F.col("unit").alias("attribute_unit"), F.col("sec_level").alias("attribute_sec_level"),
        F.col("is_cost").alias("attribute_is_cost"), F.col("is_lever").alias("attribute_is_lever"),
        F.col("is_aggregate").alias("attribute_is_aggregate"), F.col("is_kpi").alias("attribute_is_kpi"),
        F.col("is_calculated").alias("attribute_is_calculated"),
        F.coalesce("override_value", "value").alias("value"),
        F.coalesce("base_override", "base_stored").alias("base_value"), "override_value",
    )


def screens(t: Tables, groupings: DataFrame) -> DataFrame:
    """Root categories of the groupings, one screen each."""
    return t.category.where("parent_category_id is null").join(groupings, "grouping_id", "left_semi").select(
        F.col("category_name").alias("screen"), F.lit(SCREEN_RENDERER).alias("renderer")
    )


def category_filters(t: Tables) -> DataFrame:
    """All categories with their grouping."""
    return t.category.join(t.grouping, "grouping_id").select(
        "grouping_name", "category_name", "category_id", "parent_category_id", "grouping_id", "is_filter"
    )


def categories_of(t: Tables, attr_ids: DataFrame) -> DataFrame:
    """Categories of the attributes; the grouping's name comes through the category."""
    names = category_filters(t).drop("grouping_id", "parent_category_id")
    return t.attribute_category.join(attr_ids, "attr_id", "left_semi").join(names, "category_id").select(
        "attr_id", "grouping_id", "category_id", "category_name", "grouping_name", "is_filter"
    )


def attributes_in(t: Tables, category_ids: DataFrame) -> DataFrame:
    """KPIs and levers in the categories, once per category they are in."""
    return (
        t.attribute_category.join(category_ids, "category_id", "left_semi")
        .join(t.attribute.where("is_kpi or is_lever"), "attr_id")
        .select("attr_id", F.col("attr_name").alias("attribute"))
    )


def filter_groupings(t: Tables) -> DataFrame:
    """Groupings usable as a filter."""
    return t.grouping.where("is_filter").select("grouping_id", "grouping_name")


def rejected_paths(categories: DataFrame) -> DataFrame:
    """The rows whose path cannot be used: NULL, empty, or with a stray ``~`` at the end."""
    return categories.where(~is_usable_path(F.col("category_path")))


def explode_paths(categories: DataFrame, max_name_len: int | None = None) -> DataFrame:
    """One row per level of each usable category path; the last level carries the external id.

    Kept columns: everything but the path and its id. ``rejected_paths`` gives the rows left out here. Names are
    whole unless ``max_name_len`` cuts them, as older deliveries did at 30 characters.
    """
    others = [c for c in categories.columns if c not in ("ext_category_id", "category_path")]
    levels = path_levels(F.col("category_path"), max_name_len)
    return (
        categories.where(is_usable_path(F.col("category_path")))
        .select(*others, "ext_category_id", levels.alias("names"))
        .select(*others, "ext_category_id", "names", F.posexplode("names").alias("_pos", "category_name"))
        .select(
            *others, (F.col("_pos") + 1).alias("level"), "category_name",
            F.when(F.col("_pos") + 1 == F.size("names"), F.col("ext_category_id")).alias("ext_category_id"),
            F.slice("names", F.lit(1), F.col("_pos") + 1).alias("path"),
        )
    )


def add_groupings(t: Tables, categories: DataFrame) -> DataFrame:
    """The grouping table with the batch's unknown groupings added as filters."""
    fresh = (
        categories.select("grouping_name").where("grouping_name is not null").distinct()
        .join(t.grouping, "grouping_name", "left_anti")
    )
    numbered = assign_ids(fresh, "grouping_id", ["grouping_name"], next_id(t.grouping, "grouping_id"))
    return t.grouping.unionByName(numbered.select("grouping_id", F.lit(True).alias("is_filter"), "grouping_name"))


def resolve_categories(
    t: Tables, categories: DataFrame, max_name_len: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Find or create every category on the batch's paths: (grouping, category, id map).

    A category is known by its grouping and the names from the root down, so all levels resolve in one pass
    without a loop over levels. The id map has the batch's other columns, ext_category_id and category_id;
    it may point at inner levels. Equal siblings in the stored table count as the one with the lowest id.
    """
    grouping = add_groupings(t, categories)
    t = t.replace(grouping=grouping)
    levels = explode_paths(
        categories.join(grouping.select("grouping_name", "grouping_id"), "grouping_name"), max_name_len
    )
    names = F.transform("path", lambda step: step["category_name"])
    # Read three times below, so it is written once.
    stored = cut_lineage(
        category_paths(t, one_grouping=True)
        .groupBy("grouping_id", names.alias("path"))
        .agg(F.min("category_id").alias("category_id"))
    )
    fresh = levels.select("grouping_id", "path").distinct().join(stored, ["grouping_id", "path"], "left_anti")
    numbered = assign_ids(fresh, "category_id", ["grouping_id", "path"], next_id(t.category, "category_id"))
    known = stored.unionByName(numbered)
    parents = known.select("grouping_id", F.col("path").alias("_above"), F.col("category_id").alias("parent_category_id"))
    added = (
        numbered.withColumn("_above", F.slice("path", F.lit(1), F.size("path") - 1))
        .join(parents, ["grouping_id", "_above"], "left")
        .select("category_id", F.element_at("path", -1).alias("category_name"), "parent_category_id", "grouping_id")
    )
    others = [c for c in categories.columns if c not in ("ext_category_id", "category_path", "grouping_name")]
    id_map = (
        levels.where("ext_category_id is not null")
        .join(known, ["grouping_id", "path"])
        .select(*others, "ext_category_id", "category_id", "grouping_id")
    )
    return grouping, t.category.unionByName(added), id_map
