"""Models, versions, grants and users, maintained in bulk."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.functions.ids import assign_ids, next_id
from leverwise.operators.merge import applied, patch_rows, reconcile, unique_by, upsert
from leverwise.sources.tables import Tables, complete_rows


class Registration(NamedTuple):
    """Rows to append for newly registered models."""

    model_group: DataFrame
    model: DataFrame
    access_group: DataFrame
    super_user_group: DataFrame


class ModelUpdate(NamedTuple):
    """Tables after a model update."""

    model_group: DataFrame
    model: DataFrame
    access_group: DataFrame
    super_user_group: DataFrame


def model_list(t: Tables, active_only: bool = False) -> DataFrame:
    """Models with their group."""
    models = t.model.where("is_active") if active_only else t.model
    return models.join(t.model_group, "model_group_id").select(
        "model_group_id", F.col("name").alias("model_group_name"), "model_id", "filename", "file_date", "version",
        "upload_complete", "identifier", "instances",
    )


def group_identifiers(t: Tables, groups: DataFrame) -> DataFrame:
    """Identifier of each model group."""
    return t.model_group.join(groups, "model_group_id", "left_semi").select("model_group_id", "identifier")


def register_models(
    t: Tables, models: DataFrame, access: DataFrame, supers: DataFrame, now: Column
) -> Registration:
    """New model groups with one model each, and their grants.

    ``models``: (request_id, model_group_name, instances, identifier, filename, version, model_id), where a
    NULL model_id asks for a new one; ``access`` and ``supers`` point at the request.
    """
    models = unique_by(models, ["request_id"])
    grouped = assign_ids(models, "model_group_id", ["request_id"], next_id(t.model_group, "model_group_id"))
    taken = max(next_id(t.model, "model_id"), next_id(models, "model_id"))
    fresh = assign_ids(
        grouped.where("model_id is null").drop("model_id"), "model_id", ["request_id"], taken
    )
    placed = grouped.where("model_id is not null").unionByName(fresh)
    groups = placed.select(
        "model_group_id", F.col("model_group_name").alias("name"), F.lit(False).alias("is_offline"), "identifier",
        "instances",
    )
    rows = complete_rows(
        placed.select("*", now.alias("file_date"), F.lit(True).alias("is_active")), "model"
    )
    owner = placed.select("request_id", "model_group_id")
    granted = assign_ids(
        access.join(owner, "request_id"), "access_group_id", ["request_id", "ad_name", "security_level"],
        next_id(t.access_group, "access_group_id"),
    )
    raised = assign_ids(
        supers.join(owner, "request_id"), "super_user_group_id", ["request_id", "ad_name"],
        next_id(t.super_user_group, "super_user_group_id"),
    )
    return Registration(
        groups, rows, complete_rows(granted, "access_group"), complete_rows(raised, "super_user_group")
    )


def new_versions(
    t: Tables, updates: DataFrame, now: Column, key: str = "model_id", keep_rollback: bool = True
) -> DataFrame:
    """The model table with new files and versions; the former file becomes the rollback copy.

    ``updates``: (key, filename, version), and model_group_id if the model moves. ``key`` may be the model or
    its group (every model of the group is updated then).
    """
    moved = key == "model_id" and "model_group_id" in updates.columns
    marked = unique_by(updates, [key]).select(
        key, F.col("filename").alias("_file"), F.col("version").alias("_version"), F.lit(True).alias("_hit"),
        *([F.col("model_group_id").alias("_group")] if moved else []),
    )
    hit = F.col("_hit").isNotNull()
    changed: dict[str, Column] = {
        "filename": F.col("_file"), "file_date": now, "is_active": F.lit(True), "version": F.col("_version"),
    }
    if moved:
        changed["model_group_id"] = F.col("_group")
    if keep_rollback:
        changed["rollback_filename"] = F.col("filename")
        changed["rollback_file_date"] = F.col("file_date")
        changed["last_rollback"] = F.col("_version") - 1
    return t.model.join(marked, key, "left").select(
        *[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in t.model.columns]
    )


def rollback_versions(t: Tables, model_ids: DataFrame) -> DataFrame:
    """The model table with the models one version back, on their rollback copy."""
    hit = F.col("_hit").isNotNull()
    changed = {
        "version": F.col("version") - 1, "filename": F.col("rollback_filename"),
        "file_date": F.col("rollback_file_date"), "rollback_filename": F.lit(None), "rollback_file_date": F.lit(None),
    }
    marked = model_ids.select("model_id").distinct().withColumn("_hit", F.lit(True))
    return t.model.join(marked, "model_id", "left").select(
        *[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in t.model.columns]
    )


def previous_versions(t: Tables, groups: DataFrame) -> DataFrame:
    """Versions the models of the groups can go back to."""
    return (
        t.model.join(groups, "model_group_id", "left_semi")
        .where("version > last_rollback")
        .select(
            "model_group_id", "model_id", F.col("last_rollback").alias("model_rollback_version"),
            F.col("rollback_filename").alias("model_rollback_filename"),
            F.date_format("rollback_file_date", "yyyy-MM-dd HH:mm:ss").alias("model_rollback_file_date"),
        )
    )


def reconcile_access_groups(t: Tables, source: DataFrame, scopes: DataFrame) -> DataFrame:
    """Access grants of the scoped model groups made equal to the source, with actions."""
    return reconcile(
        t.access_group, source, scopes, "access_group_id", "model_group_id", ["security_level", "ad_name"]
    )


def reconcile_super_groups(t: Tables, source: DataFrame, scopes: DataFrame) -> DataFrame:
    """Super-user grants of the scoped model groups made equal to the source, with actions."""
    return reconcile(t.super_user_group, source, scopes, "super_user_group_id", "model_group_id", ["ad_name"])


def update_models(
    t: Tables, groups: DataFrame, versions: DataFrame, access: DataFrame, supers: DataFrame, now: Column
) -> ModelUpdate:
    """Rename groups (model_group_id, name, instances), bump versions, and reconcile the grants of these groups."""
    scopes = groups.select("model_group_id")
    return ModelUpdate(
        patch_rows(t.model_group, groups, ["model_group_id"]),
        new_versions(t, versions, now),
        applied(reconcile_access_groups(t, access, scopes)),
        applied(reconcile_super_groups(t, supers, scopes)),
    )


def upsert_users(t: Tables, users: DataFrame) -> DataFrame:
    """The user table: roles and level of known users replaced, unknown users added whole."""
    return upsert(t.user, users, ["user_id"], ["sec_level", "is_power_user", "is_admin_user"], "user")


def add_users(t: Tables, users: DataFrame) -> DataFrame:
    """New user rows with new ids, in the order of their logins."""
    return complete_rows(assign_ids(unique_by(users, ["login"]), "user_id", ["login"], next_id(t.user, "user_id")), "user")


def set_user_roles(t: Tables, roles: DataFrame) -> DataFrame:
    """The user table with level and roles (user_id, sec_level, is_power_user, is_admin_user) replaced."""
    return patch_rows(t.user, roles.select("user_id", "sec_level", "is_power_user", "is_admin_user"), ["user_id"])


def flag_ready(t: Tables, model_ids: DataFrame) -> DataFrame:
    """The model table with uploads marked complete."""
    ready = model_ids.select("model_id").distinct().withColumn("upload_complete", F.lit(True))
    return patch_rows(t.model, ready, ["model_id"])
