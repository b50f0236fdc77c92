"""The whole import of model structures, as one plan over the table bundle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from leverwise.operators.graph import replace_dependencies
from leverwise.operators.hierarchy import resolve_categories
from leverwise.operators.ingest import (
    reload_model_datasets,
    replace_attribute_categories,
    set_top_of_tree,
    upsert_attributes,
)
from leverwise.operators.merge import splice
from leverwise.sources.tables import Tables
from leverwise.sources.versions import Slice, Store

# Tables an import may change.
CHANGED = (
    "grouping", "category", "attribute", "external_attr", "attribute_category", "attribute_dependency", "dataset",
    "value", "model",
)


class Batch(NamedTuple):
    """One delivery; every frame has the model_id it is for."""

    imports: DataFrame
    rows: DataFrame
    dependencies: DataFrame
    categories: DataFrame
    links: DataFrame


class ModelImport(NamedTuple):
    """The bundle after the import, and the part of the value table that is new."""

    tables: Tables
    value: DataFrame
    touched: DataFrame
    actions: DataFrame


def import_model(
    t: Tables, batch: Batch, now: Column, scope_by_model: bool = False, legacy_full_replace: bool = False
) -> ModelImport:
    """Categories, attributes, links, dependencies, values, model stamp: each step sees the tables of the former.

    Nothing is written here; a failed job leaves the stored tables as they are.
    """
    grouping, category, id_map = resolve_categories(t, batch.categories)
    t = t.replace(grouping=grouping, category=category)
    merged = upsert_attributes(t, batch.rows)
    t = t.replace(attribute=merged.attribute, external_attr=merged.external_attr)
    t = t.replace(
        attribute_category=replace_attribute_categories(
            t, batch.rows, batch.links, id_map, scope_by_model, legacy_full_replace
        ),
        attribute_dependency=replace_dependencies(t, batch.rows, batch.dependencies),
    )
    loaded = reload_model_datasets(t, batch.imports, batch.rows, now, scope_by_model)
    t = t.replace(
        dataset=loaded.dataset,
        value=splice(t.value, loaded.value, loaded.touched, "dataset_id"),
        model=set_top_of_tree(t, batch.imports),
    )
    return ModelImport(t, loaded.value, loaded.touched, merged.actions)


def write_import(imported: ModelImport, store: Store) -> Store:
    """Write what the import changed as the next version of a store; the new version.

    Of the value table only the touched datasets are written, of the others the groups in which rows differ. All of it
    becomes visible at once, and a write that fails leaves the version before it.
    """
    others = {name: getattr(imported.tables, name) for name in CHANGED if name != "value"}
    slices = store.changed(others)
    return store.write(slices | {"value": Slice(imported.value, imported.touched)})
