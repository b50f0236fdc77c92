"""Datasets seen through scenarios: sparse overrides laid over stored values.

Fact joins always include the dataset (or scenario) and the attribute, so one hot dataset or attribute
spreads over many tasks. Wide attribute columns come in last, after the fact joins moved narrow rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverwise.functions.expressions import external_path, relative_change
from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import by_size, is_small, join_dimension, measured, packed
from leverwise.operators.merge import missing_from, unique_by, upsert, without_keys
from leverwise.operators.security import may_see, with_level
from leverwise.session import cut_lineage
from leverwise.sources.tables import Tables, complete_rows

VIEW_ATTRIBUTES = {
    "attr_name": "attribute",
    "unit": "attribute_unit",
    "sec_level": "attribute_sec_level",
    "is_cost": "attribute_is_cost",
    "is_lever": "attribute_is_lever",
    "is_aggregate": "attribute_is_aggregate",
    "is_kpi": "attribute_is_kpi",
    "is_calculated": "attribute_is_calculated",
    "is_non_driver": "attribute_is_non_driver",
}
VIEW_COLUMNS = [
    "attr_id", *list(VIEW_ATTRIBUTES.values()), "attribute_is_calc_redundant", "value", "base_value", "override_value",
]


class NewDataset(NamedTuple):
    """Rows to append after a copy."""

    dataset: DataFrame
    value: DataFrame
    scenario: DataFrame


class MergeResult(NamedTuple):
    """All value rows of the datasets a batch touched, the touched ids, and the dataset table."""

    value: DataFrame
    touched: DataFrame
    dataset: DataFrame


def own_views(t: Tables) -> DataFrame:
    """Scenario and base of a dataset that is the view of a scenario."""
    return t.scenario.select(F.col("view_dataset_id").alias("dataset_id"), "scenario_id", "base_dataset_id")


def base_views(t: Tables) -> DataFrame:
    """Scenario a base dataset is itself the view of."""
    return t.scenario.select(
        F.col("view_dataset_id").alias("base_dataset_id"), F.col("scenario_id").alias("base_scenario_id")
    )


def cut_to(facts: DataFrame, asked: DataFrame | None, key: str, small: bool | None = None) -> DataFrame:
    """The facts of the asked ids only; all facts if none are given. ``small`` is given if the size is known already."""
    if asked is None:
        return facts
    ids = asked.select(key).where(F.col(key).isNotNull()).distinct()
    return join_dimension(facts, ids, [key], "attr_id", "left_semi", small=small)


def with_override(
    cells: DataFrame, t: Tables, scenario: str, name: str, asked: DataFrame | None = None, small: bool | None = None
) -> DataFrame:
    """Add the override a scenario column puts on the attribute, NULL where there is none.

    ``asked`` holds the scenarios that occur, in a column of the same name; only their overrides take part.
    """
    changes = t.scenario_change.select(
        F.col("scenario_id").alias(scenario), "attr_id", F.col("new_value").alias(name)
    )
    changes = cut_to(changes, asked, scenario, small)
    return cells.join(changes, [scenario, "attr_id"], "left")


def with_stored(
    cells: DataFrame, t: Tables, dataset: str, name: str, how: str = "left", asked: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add the stored value a dataset column has for the attribute; ``asked`` as for ``with_override``."""
    stored = t.value.select(F.col("dataset_id").alias(dataset), "attr_id", F.col("value").alias(name))
    stored = cut_to(stored, asked, dataset, small)
    return cells.join(stored, [dataset, "attr_id"], how)


def scenario_heads(t: Tables, datasets: DataFrame | None = None) -> DataFrame:
    """Each dataset with the scenario viewed through it and the base side of that scenario.

    ``base_lane`` is the base's scenario as a join key. A base is the view of scenarios or of none, so within
    one base 0 is free for "none".
    """
    named = t.dataset.select("dataset_id", F.col("dataset_name").alias("dataset"))
    if datasets is not None:
        named = named.join(datasets.select("dataset_id").distinct(), "dataset_id", "left_semi")
    heads = named.join(own_views(t), "dataset_id", "left").join(base_views(t), "base_dataset_id", "left")
    return heads.withColumn("base_lane", F.coalesce("base_scenario_id", F.lit(0)))


BASE_KEY = ["base_dataset_id", "base_lane", "attr_id"]


def _base_cells(
    t: Tables, heads: DataFrame, small: bool, attributes: DataFrame | None, few: bool
) -> tuple[DataFrame, DataFrame]:
    """What the base datasets hold, and the overrides of their own scenarios.

    Only datasets that serve as a base take part. Both are behind one key, so rows that look them up are shuffled once
    for both.
    """
    # No more rows than heads, so small if these are.
    bases = heads.where("base_dataset_id is not null").select("base_dataset_id", "base_scenario_id", "base_lane").distinct()
    value = t.value.select(F.col("dataset_id").alias("base_dataset_id"), "attr_id", F.col("value").alias("stored"))
    changes = t.scenario_change.select(
        F.col("scenario_id").alias("base_scenario_id"), "attr_id", F.col("new_value").alias("changed")
    )
    stored = join_dimension(
        value, bases.select("base_dataset_id", "base_lane"), ["base_dataset_id"], "attr_id", small=small
    )
    changed = join_dimension(changes, bases, ["base_scenario_id"], "attr_id", small=small)
    if attributes is not None:
        stored = join_dimension(stored, attributes, ["attr_id"], "base_dataset_id", "left_semi", small=few)
        changed = join_dimension(changed, attributes, ["attr_id"], "base_dataset_id", "left_semi", small=few)
    return stored.select(*BASE_KEY, "stored"), changed.select(*BASE_KEY, "changed")


def resolved_values(
    t: Tables, datasets: DataFrame | None = None, attributes: DataFrame | None = None
) -> DataFrame:
    """Every stored value as its scenario shows it, next to what its base shows.

    ``datasets`` and ``attributes`` restrict the facts before any fact join.
    """
    heads = scenario_heads(t, datasets)
    # Materialised and measured once; no later cut has more ids than what is asked.
    heads, small = measured(heads)
    few = False
    value = t.value
    if attributes is not None:
        attributes, few = measured(attributes.select("attr_id").distinct())
        value = join_dimension(value, attributes, ["attr_id"], "dataset_id", "left_semi", small=few)
    bases = _base_cells(t, heads, small, attributes, few)
    return _shown(t, value, heads, small, bases, None if datasets is None else heads)


def _shown(
    t: Tables, value: DataFrame, heads: DataFrame, small: bool, bases: tuple[DataFrame, DataFrame], asked: DataFrame | None
) -> DataFrame:
    """The resolved values of these value rows, next to what their bases show.

    Rows of datasets that no scenario is viewed through have nothing to look up and skip these joins. Where the heads are
    small, what they say of a dataset is not carried through the shuffles but added from a broadcast behind each.
    """
    described = [c for c in heads.columns if c != "dataset_id"]
    # A dataset has one head unless its row or that of its scenario comes more than once.
    heads = heads.withColumn("_head", F.row_number().over(Window.partitionBy("dataset_id").orderBy(*described)))
    viewed = F.col("scenario_id").isNotNull() | F.col("base_dataset_id").isNotNull()

    def described_by(rows: DataFrame, *names: str) -> DataFrame:
        absent = [c for c in names if c not in rows.columns]
        return rows.join(F.broadcast(heads.select("dataset_id", "_head", *absent)), ["dataset_id", "_head"]) if absent else rows

    def headed(those: Column | bool, *names: str) -> DataFrame:
        ids = heads.where(those).select("dataset_id", "_head", *(names if small else described))
        return join_dimension(value, ids, ["dataset_id"], "attr_id", small=small)

    own = ["dataset_id", "_head", *([] if small else described), "attr_id", "value", "is_calc_redundant"]
    cells = with_override(headed(viewed, "scenario_id"), t, "scenario_id", "override_value", asked, small)
    cells = described_by(cells, "base_dataset_id", "base_lane")
    for found in bases:
        cells = cells.join(found, BASE_KEY, "left")
    nothing = F.lit(None).cast("double")
    cells = cells.select(*own, "override_value", F.coalesce("changed", "stored").alias("base_shown")).unionByName(
        headed(~viewed).select(*own, nothing.alias("override_value"), nothing.alias("base_shown"))
    )
    cells = described_by(cells.join(by_size(t.attribute), "attr_id"), "dataset", "scenario_id")
    return cells.select(
        "dataset_id", "scenario_id", "dataset", "attr_id",
        *[F.col(old).alias(new) for old, new in VIEW_ATTRIBUTES.items()],
        F.col("is_calc_redundant").alias("attribute_is_calc_redundant"),
        F.coalesce("override_value", "value").alias("value"),
        F.coalesce("base_shown", "value").alias("base_value"),
        "override_value",
    )


def affected_cells(
    t: Tables, overrides: DataFrame | None = None, values: DataFrame | None = None, scenarios: DataFrame | None = None,
    once: bool = True,
) -> DataFrame:
    """(dataset_id, attr_id) of all cells of the resolved values that a change can show in, once each unless not asked.

    ``overrides``: (scenario_id, attr_id) set, changed or reverted; ``values``: (dataset_id, attr_id) written or removed;
    ``scenarios``: (scenario_id) whose base or view is another one now, given once with the tables of before and once
    with those of after. A change shows in its own cell and in that of every dataset it is the base of.
    """
    key = ["dataset_id", "attr_id"]
    views = t.scenario.select("scenario_id", F.col("view_dataset_id").alias("dataset_id"))
    found = t.value.limit(0).select(*key)
    if overrides is not None:
        found = found.union(overrides.select("scenario_id", "attr_id").join(views, "scenario_id").select(*key))
    if values is not None:
        found = found.union(values.select(*key))
    above = t.scenario.select(F.col("base_dataset_id").alias("dataset_id"), "view_dataset_id")
    shown = found.union(found.join(above, "dataset_id").select(F.col("view_dataset_id").alias("dataset_id"), "attr_id"))
    if scenarios is not None:
        moved = views.join(scenarios, "scenario_id", "left_semi").select("dataset_id").distinct()
        relinked = cut_to(t.value.select(*key), moved, "dataset_id")
        # A scenario that is the view of another one's base shows there too.
        shown = shown.union(relinked).union(
            relinked.join(above, "dataset_id").select(F.col("view_dataset_id").alias("dataset_id"), "attr_id")
        )
    return shown.distinct() if once else shown


def refresh_resolved(t: Tables, kept: DataFrame, cells: DataFrame) -> DataFrame:
    """Kept resolved values with the affected cells resolved anew from the tables ``t``; all others as they are.

    Cells may be listed more than once. Few of them are materialised; many are worked out for each of the two joins, which
    takes less disk than to keep them where ``affected_cells`` lists them from tables that are written already.
    """
    key = ["dataset_id", "attr_id"]
    cells = cells.select(*key)
    small = is_small(cells)
    cells = cut_lineage(cells) if small else cells
    others = kept.join(F.broadcast(cells), key, "left_anti") if small else without_keys(kept, cells, key)
    return others.unionByName(resolved_cells(t, cells, small).select(*kept.columns))


def resolved_cells(t: Tables, cells: DataFrame, small: bool | None = None) -> DataFrame:
    """The resolved values of chosen cells (dataset_id, attr_id).

    Of few cells only their own and their bases' values take part; of many all values of these bases, as cutting them
    would shuffle more than it saves. ``small`` is given if the cells are materialised and measured already. The values
    are cut to the cells before any other join, so the wide rows of the result are not shuffled for that.
    """
    key = ["dataset_id", "attr_id"]
    if small is None:
        cells, small = packed(cells.select(*key))
    based = t
    if small:
        bases = t.scenario.select(F.col("view_dataset_id").alias("dataset_id"), "base_dataset_id")
        below = cells.join(bases, "dataset_id").select(F.col("base_dataset_id").alias("dataset_id"), "attr_id")
        below, few = measured(below.distinct())
        based = t.replace(value=t.value.join(by_size(below, few), key, "left_semi"))
    heads, little = measured(scenario_heads(t, cells))
    own = t.value.join(by_size(cells, small), key, "left_semi")
    return _shown(t, own, heads, little, _base_cells(based, heads, little, None, False), heads)


def calc_inputs(t: Tables, scope_by_model: bool = False) -> DataFrame:
    """Input of the external calculator: shown values of plain attributes, overrides of calculated ones."""
    paths = t.external_attr.select("attr_id", "object_path", "attr_name", F.col("model_id").alias("path_model"))
    views = t.scenario.select("scenario_id", F.col("view_dataset_id").alias("dataset_id"))
    heads = t.dataset.select("dataset_id", "model_id").join(views, "dataset_id", "left")

    few = is_small(paths)

    def paths_where(kind: str) -> DataFrame:
        kinds = by_size(t.attribute.where(kind).select("attr_id"), few)
        return by_size(paths.join(kinds, "attr_id", "left_semi"), few)

    cells = join_dimension(t.value, heads, ["dataset_id"], "attr_id")
    # Values that no scenario shows have no override and skip that join.
    stored = cells.where("scenario_id is null").withColumn("new_value", F.lit(None).cast("double"))
    seen = with_override(cells.where("scenario_id is not null"), t, "scenario_id", "new_value")
    plain = seen.unionByName(stored).join(paths_where("not is_calculated"), "attr_id")
    if scope_by_model:
        plain = plain.where("model_id = path_model")
    forced = join_dimension(t.scenario_change, views, ["scenario_id"], "attr_id").join(
        paths_where("is_calculated"), "attr_id"
    )
    columns = ["dataset_id", "object_path", "attr_name"]
    return plain.select(
        *columns, F.coalesce("new_value", "value").alias("value"), F.lit(0).alias("is_override")
    ).unionByName(forced.select(*columns, F.col("new_value").alias("value"), F.lit(1).alias("is_override")))


def _seen_by(t: Tables, rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Overlay rows for each (dataset, user) request, as far as the user's level reaches."""
    asked = with_level(t, requests.select("dataset_id", "user_id"))
    return join_dimension(rows, asked, ["dataset_id"], "attr_id").where(may_see("attribute_sec_level"))


def values_for(t: Tables, requests: DataFrame, attr_ids: DataFrame) -> DataFrame:
    """Overlay rows of chosen attributes for each (dataset, user)."""
    rows = resolved_values(t, datasets=requests, attributes=attr_ids)
    return _seen_by(t, rows, requests).select("dataset_id", "user_id", *VIEW_COLUMNS)


def assumptions(t: Tables, requests: DataFrame) -> DataFrame:
    """Overlay rows of the attributes a scenario overrides, per (dataset, scenario, user) request."""
    overridden = t.scenario_change.select(F.col("scenario_id").alias("asked_scenario_id"), "attr_id")
    asked = with_level(t, requests.select("dataset_id", "user_id", F.col("scenario_id").alias("asked_scenario_id")))
    overridden = cut_to(overridden, asked, "asked_scenario_id")
    return (
        join_dimension(resolved_values(t, datasets=requests), asked, ["dataset_id"], "attr_id")
        .where(may_see("attribute_sec_level"))
        .join(overridden, ["asked_scenario_id", "attr_id"], "left_semi")
        .select("dataset_id", F.col("asked_scenario_id").alias("scenario_id"), "user_id", *VIEW_COLUMNS)
    )


def search_values(
    t: Tables, requests: DataFrame, text: str, pattern: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Levers (no KPIs) whose own or category name contains ``text``, by name.

    With ``pattern`` the text may hold SQL wildcards. Attributes without a category do not appear.
    """

    def matches(column: str) -> Column:
        name = F.collate(column, "UTF8_LCASE") if ignore_case else F.col(column)
        return name.like(f"%{text}%") if pattern else name.contains(text)

    found = (
        t.attribute_category.select("attr_id", "category_id")
        .join(t.category.select("category_id", "category_name"), "category_id")
        .join(t.attribute.where("is_lever and not is_kpi").select("attr_id", "attr_name"), "attr_id")
        .where(matches("category_name") | matches("attr_name"))
        .select("attr_id")
    )
    rows = resolved_values(t, datasets=requests, attributes=found)
    return (
        _seen_by(t, rows, requests).select("dataset_id", "user_id", *VIEW_COLUMNS).distinct().orderBy("attribute")
    )


def export_attributes(t: Tables, requests: DataFrame, attr_ids: DataFrame) -> DataFrame:
    """Base value and override of chosen attributes, shaped for a spreadsheet."""
    rows = _seen_by(t, resolved_values(t, datasets=requests, attributes=attr_ids), requests)
    paths = t.external_attr.select("attr_id", "object_path")
    return join_dimension(rows, paths, ["attr_id"], "dataset_id").select(
        "dataset_id", "user_id", "attr_id", "attribute", F.col("attribute_unit").alias("unit"),
        F.col("attribute_is_cost").alias("is_cost"), F.col("attribute_is_lever").alias("is_lever"),
        F.col("attribute_is_aggregate").alias("is_aggregate"), F.col("attribute_is_kpi").alias("is_kpi"),
        F.col("base_value").alias("baseline_value"), F.col("override_value").alias("scenario_value"),
        external_path(F.col("object_path"), F.col("attribute")).alias("attribute_path"),
    )


def compare_datasets(t: Tables, requests: DataFrame, mask_changes: bool = False) -> DataFrame:
    """Actual, target and what-if of the attributes on a driver tree, one row per tree node.

    ``requests``: (dataset_id, benchmark_id, structure_id, user_id). Actual and target are stored values.
    Values above the user's level are NULL; the change columns are too with ``mask_changes``.
    """
    asked = (
        with_level(t, requests)
        .join(t.dataset.select("dataset_id"), "dataset_id", "left_semi")
        .join(own_views(t), "dataset_id", "left")
    )
    nodes = t.vdt_node.select(
        F.col("attribute_id").alias("attr_id"), F.col("vdt_structure_id").alias("structure_id"),
        F.col("vdt_node_id").alias("node_id"), F.col("name").alias("node_name"),
    )
    asked, small = measured(asked)
    cells = join_dimension(t.value, asked, ["dataset_id"], "attr_id", small=small).join(nodes, ["attr_id", "structure_id"])
    cells = with_override(cells, t, "scenario_id", "override_value", asked, small)
    cells = with_stored(cells, t, "base_dataset_id", "base_stored", asked=asked, small=small)
    cells = with_stored(cells, t, "benchmark_id", "target_stored", asked=asked, small=small)
    cells = cells.join(t.attribute, "attr_id").join(
        t.unit_format.select("unit", F.col("unit").alias("value_unit"), F.col("format").alias("value_format")),
        "unit", "left",
    )
    actual, whatif = F.coalesce("base_stored", "value"), F.coalesce("override_value", "value")
    target_change = relative_change(F.col("target_stored"), actual)
    whatif_change = relative_change(whatif, actual)
    return cells.select(
        "dataset_id", "benchmark_id", "structure_id", "user_id", "attr_id", "value_format", "value_unit", "is_kpi",
        "is_lever", "is_calculated", "is_non_driver", "is_calc_redundant",
        F.when(may_see(), actual).alias("actual"),
        F.when(may_see(), F.col("target_stored")).alias("target"),
        (F.when(may_see(), target_change) if mask_changes else target_change).alias("target_change"),
        (F.when(may_see(), whatif_change) if mask_changes else whatif_change).alias("whatif_change"),
        F.when(may_see(), whatif).alias("whatif"),
        "override_value", F.lit(1).alias("increase_is_good"), "node_id", "node_name",
    )


def copy_dataset(t: Tables, requests: DataFrame, now: Column) -> NewDataset:
    """Write what a base dataset shows into a new dataset, and open a scenario on it.

    ``requests``: (base_dataset_id, dataset_name, description, user_id, category_id, is_public,
    model_version); the first, second and fourth column together are unique.
    """
    order = ["base_dataset_id", "dataset_name", "user_id"]
    known = requests.join(
        t.dataset.select(F.col("dataset_id").alias("base_dataset_id"), "model_id"), "base_dataset_id"
    )
    first_dataset = next_id(t.dataset, "dataset_id")
    copies = assign_ids(known, "dataset_id", order, first_dataset)
    views = t.scenario.select("scenario_id", F.col("view_dataset_id").alias("base_dataset_id"))
    sources = copies.select("base_dataset_id", "dataset_id").join(views, "base_dataset_id", "left")
    cells = join_dimension(
        t.value.select(F.col("dataset_id").alias("base_dataset_id"), "attr_id", "value"), sources,
        ["base_dataset_id"], "attr_id",
    )
    shown = with_override(cells, t, "scenario_id", "new_value", sources).select(
        "dataset_id", "attr_id", F.coalesce("new_value", "value").alias("value")
    )
    first_scenario = next_id(t.scenario, "scenario_id") - first_dataset
    stamped = copies.select(
        "*", F.lit("user").alias("origin"), now.alias("last_update"), now.alias("created"),
        (F.col("dataset_id") + first_scenario).alias("scenario_id"), F.col("dataset_id").alias("view_dataset_id"),
        F.col("dataset_name").alias("scenario_name"), F.col("user_id").alias("created_by"),
    )
    return NewDataset(
        complete_rows(stamped, "dataset"), complete_rows(shown, "value"), complete_rows(stamped, "scenario")
    )


def latest_changes(feed: DataFrame, order: list[str]) -> DataFrame:
    """The last change of each scenario and attribute; partly combined before the shuffle."""
    payload = [c for c in feed.columns if c not in ("scenario_id", "attr_id")]
    return (
        feed.groupBy("scenario_id", "attr_id")
        .agg(F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("_last"))
        .select("scenario_id", "attr_id", *[f"_last.{c}" for c in payload])
    )


CHANGE_KEY = ["scenario_id", "attr_id"]


def apply_changes(t: Tables, changes: DataFrame) -> DataFrame:
    """The change table after inserting, replacing or reverting overrides.

    ``changes``: (scenario_id, attr_id, new_value, is_revert), one row per scenario and attribute.
    """
    changes, small = measured(unique_by(changes.select(*CHANGE_KEY, "new_value", "is_revert"), CHANGE_KEY))
    reverted = F.coalesce("is_revert", F.lit(False))
    given = F.when(reverted, F.col("new_value")).otherwise(
        F.coalesce("new_value", F.raise_error(F.lit("new_value is required")).cast("double"))
    )
    marked = changes.select(*CHANGE_KEY, given.alias("_given"), reverted.alias("_revert"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    kept = (
        t.scenario_change.join(F.broadcast(marked) if small else marked, CHANGE_KEY, "left")
        .where(~hit | ~F.col("_revert"))
        .select(*CHANGE_KEY, F.when(hit, F.col("_given")).otherwise(F.col("new_value")).alias("new_value"))
    )
    added = missing_from(marked.where("not _revert"), t.scenario_change, CHANGE_KEY, small)
    return kept.unionByName(added.select(*CHANGE_KEY, F.col("_given").alias("new_value")))


def change_log(t: Tables, changes: DataFrame, now: Column) -> DataFrame:
    """Log rows of a batch of changes (scenario_id, attr_id, new_value, user_id).

    The old value is the stored one of the view dataset, not the former override. A change to an attribute
    without a stored value is not logged.
    """
    views = t.scenario.select("scenario_id", F.col("view_dataset_id").alias("dataset_id"))
    asked = changes.select(*CHANGE_KEY, "new_value", "user_id").join(views, "scenario_id")
    stored = t.value.select("dataset_id", "attr_id", F.col("value").alias("old_value"))
    return join_dimension(stored, asked, ["dataset_id", "attr_id"], "attr_id").select(
        "scenario_id", "attr_id", "user_id", now.alias("change_date"), "old_value", "new_value"
    )


def mark_redundant(t: Tables, scenarios: DataFrame, marks: DataFrame) -> DataFrame:
    """All value rows of the scenarios' view datasets, redundant exactly where marked (scenario_id, attr_id)."""
    views = t.scenario.select("scenario_id", F.col("view_dataset_id").alias("dataset_id"))
    asked = views.join(scenarios, "scenario_id", "left_semi")
    marked = (
        marks.join(asked, "scenario_id").select("dataset_id", "attr_id").distinct().withColumn("_marked", F.lit(True))
    )
    return (
        join_dimension(t.value.drop("is_calc_redundant"), asked, ["dataset_id"], "attr_id", "left_semi")
        .join(marked, ["dataset_id", "attr_id"], "left")
        .select("dataset_id", "attr_id", "value", F.col("_marked").isNotNull().alias("is_calc_redundant"))
    )


def overridden_calculated(t: Tables, scenarios: DataFrame) -> DataFrame:
    """Calculated attributes that carry an override."""
    return (
        t.scenario_change.where("new_value is not null")
        .join(scenarios, "scenario_id", "left_semi")
        .join(t.attribute.where("is_calculated"), "attr_id", "left_semi")
        .select("scenario_id", "attr_id")
    )


def base_of(t: Tables, view_dataset_ids: DataFrame) -> DataFrame:
    """Base dataset of each view dataset, the lowest if several scenarios share the view."""
    return (
        t.scenario.join(view_dataset_ids, "view_dataset_id", "left_semi")
        .groupBy("view_dataset_id")
        .agg(F.min("base_dataset_id").alias("base_dataset_id"))
    )


def with_attr_ids(t: Tables, rows: DataFrame, scope_by_model: bool = False) -> DataFrame:
    """Batch rows with the attribute their external path names. Models are ignored unless scoped."""
    paths = t.external_attr.select("object_path", "attr_name", "attr_id", *(["model_id"] if scope_by_model else []))
    key = ["object_path", "attr_name", *(["model_id"] if scope_by_model else [])]
    return rows.join(by_size(paths), key)


def merge_calculated(
    t: Tables, results: DataFrame, now: Column, scope_by_model: bool = False, dataset_ids: DataFrame | None = None
) -> MergeResult:
    """Upsert calculated values (dataset_id, object_path, attr_name, value) and stamp their datasets.

    Rows that ``with_attr_ids`` has given their attribute already (dataset_id, attr_id, value) are taken as they are.
    ``dataset_ids`` are the datasets that were calculated; they are stamped even if no value came back, and values of
    others are left out. Without them the datasets of the results count. A dataset that does not exist stops the job.
    """
    touched = (results if dataset_ids is None else dataset_ids).select("dataset_id").distinct()
    known = t.dataset.select("dataset_id", F.lit(True).alias("_known"))
    missing = F.raise_error(F.concat(F.lit("no dataset "), F.col("dataset_id").cast("string"))).cast("bigint")
    touched = cut_lineage(touched.join(known, "dataset_id", "left").select(
        F.when(F.col("_known").isNull(), missing).otherwise(F.col("dataset_id")).alias("dataset_id")
    ))
    named = "attr_id" not in results.columns
    if dataset_ids is not None:
        results = join_dimension(results, touched, ["dataset_id"], "attr_name" if named else "attr_id", "left_semi")
    if named and scope_by_model:
        results = results.join(t.dataset.select("dataset_id", "model_id"), "dataset_id")
    source = (with_attr_ids(t, results, scope_by_model) if named else results).select("dataset_id", "attr_id", "value")
    present = join_dimension(t.value, touched, ["dataset_id"], "attr_id", "left_semi")
    stamped = t.dataset.join(touched.withColumn("_hit", F.lit(True)), "dataset_id", "left").select(
        *[F.when(F.col("_hit").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "last_update" else F.col(c)
          for c in t.dataset.columns]
    )
    return MergeResult(upsert(present, source, ["dataset_id", "attr_id"], ["value"], "value"), touched, stamped)
