"""The dataset catalogue and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.functions.sizes import join_dimension, measured
from leverwise.operators.merge import patch_rows
from leverwise.sources.tables import Tables

CATALOGUE_COLUMNS = [
    "dataset_id", "dataset_name", "category_name", "top_value", "top_format", "locked_by", "locked_by_user_id",
    "base_dataset_name", "base_dataset_id", "owned_by", "owned_by_id", "last_update", "description", "scenario_id",
    "is_public", "is_whatif", "access_level", "is_active", "model_version",
]


def catalogue_rows(t: Tables) -> DataFrame:
    """Every dataset that is not deleted and has its top-of-tree value, whoever looks.

    The value table is cut to top-of-tree attributes before it meets the datasets.
    """
    scenario = t.scenario.select(
        F.col("view_dataset_id").alias("dataset_id"), "scenario_id", "base_dataset_id", "created_by", "editing_by",
        F.col("is_public").alias("scenario_public"),
    )
    base = t.dataset.select(
        F.col("dataset_id").alias("base_dataset_id"), F.col("dataset_name").alias("base_dataset_name")
    )
    lock = t.user.select(F.col("user_id").alias("editing_by"), F.col("login").alias("lock_login"))
    owner = t.user.select(F.col("user_id").alias("created_by"), F.col("login").alias("owner_login"))
    model = t.model.select("model_id", "is_active", F.col("top_of_tree_attr_id").alias("attr_id"))
    heads = t.dataset.where("not deleted").join(model, "model_id").join(scenario, "dataset_id", "left")
    top_attrs = t.model.select(F.col("top_of_tree_attr_id").alias("attr_id"))
    tops = t.value.select("dataset_id", "attr_id", F.col("value").alias("top_value")).join(
        top_attrs, "attr_id", "left_semi"
    )
    units = t.attribute.select("attr_id", "unit")
    formats = t.unit_format.select("unit", F.col("format").alias("top_format"))
    active = F.col("is_active")
    return (
        heads.join(tops, ["dataset_id", "attr_id"])
        .join(base, "base_dataset_id", "left")
        .join(lock.withColumn("lock_id", F.col("editing_by")), "editing_by", "left")
        .join(owner.withColumn("owner_id", F.col("created_by")), "created_by", "left")
        .join(units, "attr_id", "left")
        .join(formats, "unit", "left")
        .join(t.dataset_category, "category_id", "left")
        .select(
            "dataset_id", "dataset_name", "category_name", "top_value", "top_format",
            F.when(active, F.col("lock_login")).alias("locked_by"),
            F.when(active, F.col("lock_id")).alias("locked_by_user_id"),
            "base_dataset_name",
            F.when(F.col("base_dataset_name").isNotNull(), F.col("base_dataset_id")).alias("base_dataset_id"),
            F.coalesce("owner_login", F.lit("System")).alias("owned_by"), F.col("owner_id").alias("owned_by_id"),
            "last_update", "description", "scenario_id",
            F.coalesce("scenario_public", F.lit(True)).alias("is_public"),
            F.when(F.col("scenario_id").isNull(), 0).otherwise(1).alias("is_whatif"),
            F.when(F.coalesce("scenario_public", F.lit(True)), "Public").otherwise("Private").alias("access_level"),
            "is_active", "model_version", "created_by",
        )
    )


def _open_to(user: Column, power: Column) -> Column:
    return F.col("is_public") | power | (F.col("created_by") == user)


def list_datasets(t: Tables, user_id: int) -> DataFrame:
    """The catalogue one user sees: public rows, own rows, and private rows for a power user."""
    power = t.user.where(F.col("user_id") == user_id).select("is_power_user").scalar()
    return catalogue_rows(t).where(_open_to(F.lit(user_id), power)).select(*CATALOGUE_COLUMNS)


def list_requested(t: Tables, requests: DataFrame) -> DataFrame:
    """Catalogue rows for (dataset_id, user_id) requests, as far as open to the user; only asked datasets take part."""
    power = t.user.select("user_id", F.col("is_power_user").alias("_power"))
    asked, small = measured(requests.select("dataset_id", "user_id").join(power, "user_id", "left"))
    ids = asked.select("dataset_id").distinct()
    dataset = join_dimension(t.dataset, ids, ["dataset_id"], "model_id", "left_semi", small=small)
    return (
        catalogue_rows(t.replace(dataset=dataset))
        .join(asked, "dataset_id")
        .where(_open_to(F.col("user_id"), F.col("_power")))
        .select("user_id", *CATALOGUE_COLUMNS)
    )


def name_status(names: DataFrame, rows: DataFrame, column: str, ignore_case: bool = False) -> DataFrame:
    """For each name 'True' if exactly one row bears it, else 'False'.

    With ``ignore_case`` names also equal each other across case and trailing blanks.
    """

    def key(name: str) -> Column:
        return (F.collate(name, "UTF8_LCASE_RTRIM") if ignore_case else F.col(name)).alias("_key")

    counts = rows.groupBy(key(column)).agg(F.count("*").alias("_n"))
    return names.select("name", key("name")).join(counts, "_key", "left").select(
        "name", F.when(F.col("_n") == 1, "True").otherwise("False").alias("is_unique")
    )


def create_status(t: Tables, requests: DataFrame) -> DataFrame:
    """Two checks per request (request_id, dataset_name, scenario_name, user_id): 0 if exactly one is found, else 1.

    The dataset name counts only if the user has a scenario of that name.
    """
    named = t.scenario.groupBy(
        F.col("created_by").alias("user_id"), F.col("scenario_name").alias("_name")
    ).agg(F.count("*").alias("_owned"))
    datasets = t.dataset.groupBy("dataset_name").agg(F.count("*").alias("_n"))

    def status(df: DataFrame, kind: str, single: Column) -> DataFrame:
        return df.select(
            "request_id", F.lit(kind).alias("checked"), F.when(single, 0).otherwise(1).alias("status")
        )

    with_dataset = requests.join(datasets, "dataset_name", "left").join(
        named.withColumnRenamed("_name", "dataset_name"), ["user_id", "dataset_name"], "left"
    )
    with_scenario = requests.join(
        named.withColumnRenamed("_name", "scenario_name"), ["user_id", "scenario_name"], "left"
    )
    return status(with_dataset, "dataset", (F.col("_n") == 1) & F.col("_owned").isNotNull()).unionByName(
        status(with_scenario, "scenario", F.col("_owned") == 1)
    )


def datasets_by_id(t: Tables, ids: DataFrame) -> DataFrame:
    """Names of the datasets."""
    return t.dataset.join(ids, "dataset_id", "left_semi").select("dataset_id", "dataset_name")


def dataset_categories(t: Tables) -> DataFrame:
    """The dataset category lookup."""
    return t.dataset_category.select("category_id", "category_name")


def models_of_datasets(t: Tables, ids: DataFrame) -> DataFrame:
    """Model and model group of each dataset."""
    groups = t.model_group.select("model_group_id", F.col("name").alias("model_group"))
    return (
        t.dataset.join(ids, "dataset_id", "left_semi")
        .select("dataset_id", "model_id")
        .join(t.model, "model_id")
        .join(groups, "model_group_id")
        .select("dataset_id", "model_id", "filename", "file_date", "model_group", "version")
    )


def unit_formats(t: Tables) -> DataFrame:
    """Display format of each unit."""
    return t.unit_format.select("unit", "format")


def soft_delete(t: Tables, ids: DataFrame) -> DataFrame:
    """The dataset table with the datasets marked deleted."""
    return patch_rows(t.dataset, ids.select("dataset_id").distinct().withColumn("deleted", F.lit(True)), ["dataset_id"])


def set_locks(t: Tables, locks: DataFrame) -> DataFrame:
    """The scenario table with lock owners (view_dataset_id, editing_by) set; NULL unlocks."""
    return patch_rows(t.scenario, locks.select("view_dataset_id", "editing_by"), ["view_dataset_id"])


def update_datasets(t: Tables, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, scenario) after renaming datasets and changing the publicity of their scenarios.

    ``patches``: (dataset_id, dataset_name, description, category_id, is_public).
    """
    publicity = patches.select(F.col("dataset_id").alias("view_dataset_id"), "is_public")
    return (
        patch_rows(t.dataset, patches.drop("is_public"), ["dataset_id"]),
        patch_rows(t.scenario, publicity, ["view_dataset_id"]),
    )


def audit_by_category(t: Tables) -> DataFrame:
    """Audit entries per category pair, with the names of both."""
    main = t.audit_category.select(F.col("audit_category_id").alias("category"), F.col("name").alias("category_name"))
    sub = t.audit_category.select(
        F.col("audit_category_id").alias("sub_category"), F.col("name").alias("sub_category_name")
    )
    counted = t.audit_entry.groupBy("category", "sub_category").agg(
        F.count("*").alias("entries"), F.max("audit_date").alias("last_entry")
    )
    return counted.join(main, "category").join(sub, "sub_category", "left").select(
        "category", "category_name", "sub_category", "sub_category_name", "entries", "last_entry"
    )
