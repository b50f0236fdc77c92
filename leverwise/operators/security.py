"""Who may see what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.sources.tables import Tables


def with_level(t: Tables, requests: DataFrame) -> DataFrame:
    """Requests plus the security level of their user. An unknown user or a NULL level sees nothing."""
    levels = t.user.select("user_id", F.col("sec_level").alias("user_level"))
    return requests.join(levels, "user_id", "left")


def may_see(attribute_level: str = "sec_level"):
    """The visibility predicate; NULL counts as no."""
    return F.col("user_level") >= F.col(attribute_level)


def visible_attributes(t: Tables, user_id: int) -> DataFrame:
    """Attributes one user may see."""
    level = t.user.where(F.col("user_id") == user_id).select("sec_level").scalar()
    return t.attribute.where(F.col("sec_level") <= level).select("attr_id", "attr_name")


def visible_by_level(t: Tables, users: DataFrame | None = None) -> DataFrame:
    """Attributes visible at each security level in use: the answer for all users, or all given ones, at once.

    Users with one level see the same attributes, so the answer is keyed by level and users look theirs up
    through ``user.sec_level``. The few level codes in use travel to the attributes as one array, so there
    is no inequality join; every attribute lists the codes at or above its own.
    """
    asked = t.user if users is None else t.user.join(users.select("user_id"), "user_id", "left_semi")
    held = asked.agg(F.collect_set("sec_level").alias("levels")).scalar()
    listed = t.attribute.select(F.explode(held).alias("user_level"), "sec_level", "attr_id", "attr_name")
    return listed.where(may_see()).drop("sec_level")


def group_access_level(t: Tables, group_names: DataFrame, models: DataFrame) -> DataFrame:
    """Highest level the named groups hold on each model; NULL when none does.

    Grants shrink to one row per model group before they meet the models.
    """
    best = (
        t.access_group.join(group_names.select(F.col("item").alias("ad_name")), "ad_name", "left_semi")
        .groupBy("model_group_id")
        .agg(F.max("security_level").alias("access_level"))
    )
    asked = t.model.select("model_id", "model_group_id").join(models, "model_id", "left_semi")
    return asked.join(best, "model_group_id", "left").select("model_id", "access_level")


def is_super_group(t: Tables, group_names: DataFrame, models: DataFrame) -> DataFrame:
    """Whether any named group is a super group of the model's group."""
    held = (
        t.super_user_group.join(group_names.select(F.col("item").alias("ad_name")), "ad_name", "left_semi")
        .select("model_group_id")
        .distinct()
        .withColumn("_held", F.lit(True))
    )
    asked = t.model.select("model_id", "model_group_id").join(models, "model_id", "left_semi")
    return asked.join(held, "model_group_id", "left").select(
        "model_id", F.col("_held").isNotNull().alias("is_super_user_group")
    )


def access_groups(t: Tables) -> DataFrame:
    """Distinct group names that hold a grant."""
    return t.access_group.select("ad_name").distinct()


def model_groups(t: Tables, group_names: DataFrame | None = None) -> DataFrame:
    """Active, uploaded models the named groups can reach, by group; all granted models without names (admin)."""
    granted = t.access_group
    if group_names is not None:
        granted = granted.join(group_names.select(F.col("item").alias("ad_name")), "ad_name", "left_semi")
    return (
        t.model.where("is_active and upload_complete")
        .join(granted.select("model_group_id").distinct(), "model_group_id", "left_semi")
        .join(t.model_group, "model_group_id")
        .select(
            "model_group_id", F.col("name").alias("model_group_name"), "model_id", "filename",
            F.col("version").alias("model_version"), "identifier", "instances",
        )
        .orderBy("model_group_id")
    )


def model_group_details(t: Tables, groups: DataFrame) -> DataFrame:
    """Active models of the groups with their grants, one row per model and grant.

    Access grants and super-user grants are listed below each other (``grant_kind``), not paired: the pairs
    would grow with the product of both. A group without either kind has no rows.
    """
    access = t.access_group.select(
        "model_group_id", F.lit("access").alias("grant_kind"), F.col("access_group_id").alias("grant_id"),
        "security_level", "ad_name",
    )
    supers = t.super_user_group.select(
        "model_group_id", F.lit("super").alias("grant_kind"), F.col("super_user_group_id").alias("grant_id"),
        F.lit(None).cast("int").alias("security_level"), "ad_name",
    )
    wanted = (
        t.model_group.join(groups, "model_group_id", "left_semi")
        .join(access.select("model_group_id").distinct(), "model_group_id", "left_semi")
        .join(supers.select("model_group_id").distinct(), "model_group_id", "left_semi")
    )
    return (
        wanted.join(t.model.where("is_active"), "model_group_id")
        .join(access.unionByName(supers), "model_group_id")
        .select(
            "model_group_id", F.col("name").alias("model_group_name"), "instances", "identifier", "model_id",
            "filename", "file_date", "version", "is_active", "grant_kind", "grant_id", "security_level", "ad_name",
        )
    )
