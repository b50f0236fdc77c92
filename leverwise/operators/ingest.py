"""Steps of a model import. Every batch frame carries the model_id it belongs to, so one job imports many models."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.functions.expressions import external_path, external_path_or_blank, type_flags
from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import by_shuffle, join_dimension
from leverwise.operators.merge import patch_rows, splice, unique_by
from leverwise.operators.overlay import with_attr_ids
from leverwise.sources.tables import Tables, complete_rows

FLAGS = ["is_cost", "is_lever", "is_calculated", "is_aggregate", "is_kpi"]


class AttributeMerge(NamedTuple):
    """Attribute and path tables after an upsert, and what happened to each batch row."""

    attribute: DataFrame
    external_attr: DataFrame
    actions: DataFrame


class DatasetReload(NamedTuple):
    """Dataset table, the reloaded value rows, and the ids of their datasets with the model."""

    dataset: DataFrame
    value: DataFrame
    touched: DataFrame


def decode_types(rows: DataFrame) -> DataFrame:
    """Batch rows with flags instead of the type code, default unit and default level."""
    return rows.select(
        *[c for c in rows.columns if c not in ("type", "display_unit", "sec_level")],
        F.coalesce("display_unit", F.lit("#")).alias("unit"),
        F.coalesce("sec_level", F.lit(1)).alias("sec_level"),
        *[flag.alias(name) for name, flag in type_flags(F.col("type")).items()],
    )


def upsert_attributes(t: Tables, rows: DataFrame) -> AttributeMerge:
    """Match batch rows by (model, path, name): refresh unit, level and flags, or add attribute and path."""
    paths = t.external_attr.select("model_id", "object_path", "attr_name", "attr_id")
    source = decode_types(rows).join(by_shuffle(paths), ["model_id", "object_path", "attr_name"], "left")
    known = source.where("attr_id is not null")
    fresh = assign_ids(
        source.where("attr_id is null").drop("attr_id"), "attr_id",
        ["model_id", "object_path", "attr_name", "ext_attr_id"], next_id(t.attribute, "attr_id"),
    )
    refreshed = patch_rows(t.attribute, known.select("attr_id", "unit", "sec_level", *FLAGS), ["attr_id"])
    path_columns = ["model_id", "attr_id", "object_path", "ext_attr_id", "attr_name"]
    return AttributeMerge(
        refreshed.unionByName(complete_rows(fresh, "attribute")),
        t.external_attr.unionByName(fresh.select(*path_columns)),
        known.select(*path_columns, F.lit("UPDATE").alias("action")).unionByName(
            fresh.select(*path_columns, F.lit("INSERT").alias("action"))
        ),
    )


def replace_attribute_categories(
    t: Tables, rows: DataFrame, links: DataFrame, id_map: DataFrame,
    scope_by_model: bool = False, legacy_full_replace: bool = False,
) -> DataFrame:
    """The attribute-category table with the links of imported attributes exchanged.

    ``links`` (model_id, ext_attr_id, ext_category_id) meet ``id_map`` within their import. Attributes are
    found by external id in any model unless scoped. ``legacy_full_replace`` drops every old link as soon as
    the batch maps a category, and none otherwise.
    """
    places = id_map.select("model_id", "ext_category_id", "category_id")
    mapped = links.join(by_shuffle(places), ["model_id", "ext_category_id"])
    key = ["ext_attr_id", *(["model_id"] if scope_by_model else [])]
    added = (
        t.external_attr.select("attr_id", *key)
        .join(by_shuffle(mapped.select(*key, "category_id")), key)
        .join(by_shuffle(t.category.select("category_id", "grouping_id")), "category_id")
        .select("attr_id", "grouping_id", "category_id")
    )
    if legacy_full_replace:
        return added if not id_map.isEmpty() else t.attribute_category.unionByName(added)
    listed = rows.select("model_id", "object_path", "attr_name").join(
        by_shuffle(t.external_attr), ["model_id", "object_path", "attr_name"]
    )
    touched = listed.select("attr_id").unionByName(added.select("attr_id"))
    return splice(t.attribute_category, added, touched, "attr_id")


# Names of the data sets that hold a model's file.
MODEL_DATA = "Model Data - "
DEBUG_FILE = "_debug"
DEBUG_NAME = MODEL_DATA + DEBUG_FILE


def _stored_filename(filename: Column) -> Column:
    return F.when(filename.startswith("_"), F.lit(DEBUG_FILE)).otherwise(filename)


def reload_model_datasets(
    t: Tables, imports: DataFrame, rows: DataFrame, now: Column, scope_by_model: bool = False
) -> DatasetReload:
    """Find or create the data set of each imported file and load its values anew.

    Values go to every attribute of that path, whichever model it belongs to, unless scoped. Of several files that all
    go to the debug data set the one of the highest model id counts, as the last of several deliveries would.
    """
    named = imports.select(
        "model_id", F.concat(F.lit(MODEL_DATA), _stored_filename(F.col("filename"))).alias("dataset_name")
    )
    debug = F.col("dataset_name") == DEBUG_NAME
    last = named.where(debug).groupBy("dataset_name").agg(F.max("model_id").alias("model_id"))
    named = unique_by(named.where(~debug).unionByName(last), ["dataset_name"])
    known = (
        t.dataset.where("origin = 'model'")
        .join(named, "dataset_name", "left_semi")
        .groupBy("dataset_name")
        .agg(F.min("dataset_id").alias("dataset_id"))
    )
    fresh = assign_ids(
        named.join(known, "dataset_name", "left_anti"), "dataset_id", ["dataset_name"],
        next_id(t.dataset, "dataset_id"),
    )
    category = t.dataset_category.where("category_name = 'Scenario'").agg(F.min("category_id")).scalar()
    found = named.join(known, "dataset_name").select("dataset_id", "model_id")
    dataset = patch_rows(t.dataset, found, ["dataset_id"]).unionByName(
        complete_rows(
            fresh.select(
                "*", F.lit("model").alias("origin"), category.alias("category_id"), now.alias("last_update"),
                now.alias("created"),
            ),
            "dataset",
        )
    )
    touched = found.unionByName(fresh.select("dataset_id", "model_id"))
    paths = t.replace(external_attr=by_shuffle(t.external_attr))
    values = join_dimension(with_attr_ids(paths, rows, scope_by_model), touched, ["model_id"], "attr_id")
    return DatasetReload(dataset, complete_rows(values, "value"), touched)


def set_top_of_tree(t: Tables, imports: DataFrame) -> DataFrame:
    """The model table with the file name and the top attribute (given by external id) of each import."""
    named = t.external_attr.withColumnRenamed("ext_attr_id", "top_ext_attr_id").join(
        imports, ["model_id", "top_ext_attr_id"], "left_semi"
    )
    ids = named.groupBy("model_id", "top_ext_attr_id").agg(F.min("attr_id").alias("top_of_tree_attr_id"))
    patches = imports.join(ids, ["model_id", "top_ext_attr_id"], "left").select(
        "model_id", _stored_filename(F.col("filename")).alias("filename"), "top_of_tree_attr_id"
    )
    return patch_rows(t.model, patches, ["model_id"])


def external_id_map(t: Tables) -> DataFrame:
    """External path of every attribute."""
    return t.external_attr.select(
        external_path(F.col("object_path"), F.col("attr_name")).alias("full_path"), "attr_id", F.lit("").alias("link")
    )


def attributes_by_path(t: Tables, paths: DataFrame, models: DataFrame) -> DataFrame:
    """Attribute ids of full paths in the models."""
    full = external_path_or_blank(F.col("object_path"), F.col("attr_name")).alias("path")
    return (
        t.external_attr.join(models, "model_id", "left_semi")
        .select("model_id", "attr_id", full)
        .join(paths, "path", "left_semi")
    )
