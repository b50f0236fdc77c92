"""Sensitivity and attribution runs: reading them and importing new ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.functions.ids import assign_ids, next_id
from leverwise.functions.sizes import join_dimension, measured
from leverwise.operators.merge import splice, unique_by
from leverwise.operators.overlay import with_attr_ids, with_override, with_stored
from leverwise.operators.security import may_see, with_level
from leverwise.session import cut_lineage
from leverwise.sources.tables import Tables, complete_rows

# Fixed value: dimension list shown with every run.
RUN_GROUPINGS = "Location,Activity,Equipment,Accountability,Cost Type,Product"


class RunImport(NamedTuple):
    """After an import: all run headers, the detail rows of the imported runs, their ids, and refused runs."""

    headers: DataFrame
    details: DataFrame
    touched: DataFrame
    rejected: DataFrame


def sensitivity_impacts(t: Tables, requests: DataFrame) -> DataFrame:
    """Impact of raising and lowering each visible attribute, per (dataset_id, user_id)."""
    runs = with_level(t, requests).join(t.sensitivity.select("sensitivity_id", "dataset_id"), "dataset_id")
    return (
        join_dimension(t.sensitivity_value, runs, ["sensitivity_id"], "attr_id")
        .join(t.attribute, "attr_id")
        .where(may_see())
        .select(
            "dataset_id", "user_id", "sensitivity_id", "attr_id", F.col("attr_name").alias("attribute"), "is_cost",
            F.col("is_lever").alias("attribute_is_lever"), F.col("is_kpi").alias("attribute_is_kpi"),
            "impact_of_decrease", "impact_of_increase",
        )
    )


def attribution_impacts(t: Tables, requests: DataFrame) -> DataFrame:
    """Impact of each visible attribute on the target, with shown scenario and stored benchmark values.

    ``requests``: (base_dataset_id, benchmark_dataset_id, user_id).
    """
    pair = ["base_dataset_id", "benchmark_dataset_id"]
    views = t.scenario.select(F.col("view_dataset_id").alias("base_dataset_id"), "scenario_id")
    # The scenario comes with the run, so the facts need no join on a key that most of them may lack.
    runs = with_level(t, requests).join(t.attribution.select("attribution_id", *pair), pair)
    runs = runs.join(views, "base_dataset_id", "left")
    visible = t.attribute.select("attr_id", "sec_level")
    cells = join_dimension(t.attribution_value, runs, ["attribution_id"], "attr_id")
    cells = cells.join(visible, "attr_id").where(may_see())
    cells = with_stored(cells, t, "base_dataset_id", "base_stored", asked=runs)
    cells = with_stored(cells, t, "benchmark_dataset_id", "benchmark_value", asked=runs)
    # The scenario belongs to the stored scenario value: where that is missing there is no overlay either.
    cells = with_override(cells, t, "scenario_id", "changed", runs)
    cells = cells.withColumn("new_value", F.when(F.col("base_stored").isNotNull(), F.col("changed")))
    return (
        cells.drop("sec_level")
        .join(t.attribute, "attr_id")
        .join(t.unit_format, "unit", "left")
        .select(
            *pair, "user_id", "attribution_id", "attr_id", F.col("attr_name").alias("attribute"), "is_cost",
            F.col("is_lever").alias("attribute_is_lever"), F.col("is_kpi").alias("attribute_is_kpi"), "format",
            "impact_on_target", F.coalesce("new_value", "base_stored").alias("scenario_value"), "benchmark_value",
        )
    )


def _summary(t: Tables, runs: DataFrame, columns: list[str]) -> DataFrame:
    targets = t.attribute.select(F.col("attr_id").alias("target_attr_id"), "attr_name", "unit")
    return (
        runs.join(targets, "target_attr_id", "left")
        .join(t.unit_format, "unit", "left")
        .select(
            "attr_name", F.lit(RUN_GROUPINGS).alias("groupings"), *columns, "target_attr_id", "target_base_value",
            "last_update", F.col("format").alias("attribute_format"),
        )
    )


def sensitivity_summary(t: Tables, dataset_ids: DataFrame) -> DataFrame:
    """Sensitivity runs of the datasets with target name and format."""
    runs = t.sensitivity.join(dataset_ids, "dataset_id", "left_semi")
    return _summary(t, runs, ["dataset_id", "sensitivity_id", "percent_change"])


def attribution_summary(t: Tables, pairs: DataFrame) -> DataFrame:
    """Attribution runs of the (base, benchmark) pairs with target name and format."""
    runs = t.attribution.join(pairs, ["base_dataset_id", "benchmark_dataset_id"], "left_semi")
    return _summary(t, runs, ["base_dataset_id", "benchmark_dataset_id", "is_cumulative"])


def _import_runs(
    t: Tables, runs: DataFrame, rows: DataFrame, now: Column, table: str, id_column: str, header_key: list[str],
    scope_by_model: bool,
) -> RunImport:
    """Find or create the run headers, replace their detail rows, refresh target value and date.

    A run whose target path is unknown is refused as a whole. An existing header keeps everything but its
    target value and date.
    """
    stored = getattr(t, table)
    columns, target = runs.columns, ["target_path", "target_attr"]
    if scope_by_model:
        target = [*target, "model_id"]
        models = t.dataset.select(F.col("dataset_id").alias(header_key[0]), "model_id")
        runs = runs.join(models, header_key[0], "left")
        rows = rows.join(runs.select("run_id", "model_id"), "run_id")
    paths = t.external_attr.select(
        F.col("object_path").alias("target_path"), F.col("attr_name").alias("target_attr"), "model_id", "attr_id"
    ).join(runs, target, "left_semi")
    targets = paths.groupBy(*target).agg(F.min("attr_id").alias("target_attr_id"))
    aimed = runs.join(targets, target, "left")
    rejected = aimed.where("target_attr_id is null").select(*columns)
    # Headers are few and read several times below.
    accepted = cut_lineage(unique_by(aimed.where("target_attr_id is not null"), header_key))
    known = cut_lineage(
        stored.join(accepted, header_key, "left_semi").groupBy(*header_key).agg(F.min(id_column).alias(id_column))
    )
    fresh = assign_ids(accepted.join(known, header_key, "left_anti"), id_column, header_key, next_id(stored, id_column))
    found = accepted.join(known, header_key)
    refreshed = found.select(id_column, F.col("target_base_value").alias("_target_value"))
    headers = (
        stored.join(refreshed, id_column, "left")
        .select(
            *[
                F.coalesce("_target_value", "target_base_value").alias(c) if c == "target_base_value"
                else F.when(F.col("_target_value").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "last_update"
                else F.col(c)
                for c in stored.columns
            ]
        )
        .unionByName(complete_rows(fresh.withColumn("last_update", now), table))
    )
    numbered, small = measured(found.select("run_id", id_column).unionByName(fresh.select("run_id", id_column)))
    details = join_dimension(with_attr_ids(t, rows, scope_by_model), numbered, ["run_id"], "attr_id", small=small)
    detail_table = f"{table}_value"
    return RunImport(
        headers, complete_rows(details, detail_table), numbered.select(id_column), rejected
    )


def import_sensitivity(
    t: Tables, runs: DataFrame, rows: DataFrame, now: Column, scope_by_model: bool = False
) -> RunImport:
    """Import sensitivity runs; a run is known by dataset and target. Its percentage is kept when known.

    With ``scope_by_model`` paths name attributes of the dataset's model only.
    """
    key = ["dataset_id", "target_attr_id"]
    return _import_runs(t, runs, rows, now, "sensitivity", "sensitivity_id", key, scope_by_model)


def import_attribution(
    t: Tables, runs: DataFrame, rows: DataFrame, now: Column, scope_by_model: bool = False
) -> RunImport:
    """Import attribution runs; a run is known by base, benchmark, target and kind. Scoped by the base's model."""
    key = ["base_dataset_id", "benchmark_dataset_id", "target_attr_id", "is_cumulative"]
    return _import_runs(t, runs, rows, now, "attribution", "attribution_id", key, scope_by_model)


def with_details(stored: DataFrame, imported: RunImport, id_column: str) -> DataFrame:
    """The detail table after an import."""
    return splice(stored, imported.details, imported.touched, id_column)
