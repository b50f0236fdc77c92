"""The bundle of model tables, and how frames get into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leverwise.sources.schemas import (
    AUDIT_CATEGORIES,
    DATASET_CATEGORIES,
    DEFAULTS,
    TABLES,
    UNIT_FORMATS,
)


class Tables:
    """Named DataFrames, read as attributes: ``t.value``, ``t.scenario`` ..."""

    def __init__(self, **frames: DataFrame):
        self._frames = frames

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["_frames"][name]
        except KeyError:
            raise AttributeError(f"no table {name!r}") from None

    def replace(self, **frames: DataFrame) -> Tables:
        """The same bundle with some tables exchanged."""
        return Tables(**{**self._frames, **frames})


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> Tables:
    """Scan the Parquet tables below ``path`` with their declared schemas (no inference).

    Folder columns of a bucketed layout are left out, and so are the rows that mark an emptied folder.
    """

    def scan(name: str) -> DataFrame:
        fields = _fields(TABLES[name])
        held = spark.read.schema(TABLES[name]).parquet(f"{path}/{name}").select(*[f.name for f in fields])
        required = [f.name for f in fields if not f.nullable]
        return held.where(F.col(required[0]).isNotNull()) if required else held

    return Tables(**{name: scan(name) for name in names or list(TABLES)})


def _fields(schema: str | StructType):
    return (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields


def as_input(df: DataFrame, schema: str | StructType) -> DataFrame:
    """A batch with exactly the declared columns and types; a missing required value stops the job."""
    columns = []
    for field in _fields(schema):
        column = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            column = F.coalesce(column, F.raise_error(F.lit(f"{field.name} is required")).cast(field.dataType))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def incomplete_rows(df: DataFrame, schema: str | StructType) -> DataFrame:
    """The rows of a batch that lack a required value."""
    missing = F.lit(False)
    for field in _fields(schema):
        if not field.nullable:
            missing = missing | F.col(field.name).isNull()
    return df.where(missing)


def complete_rows(df: DataFrame, table: str) -> DataFrame:
    """New rows in the column order of ``table``; absent columns get their default, else NULL."""
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in _fields(TABLES[table]):
        column = F.col(field.name) if field.name in df.columns else F.lit(defaults.get(field.name))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def seed_reference(spark: SparkSession, first_grouping: str | None = None) -> dict[str, DataFrame]:
    """The lookup rows every installation starts with; with a name also the first grouping, which is no filter."""
    named = [] if first_grouping is None else [(1, False, first_grouping)]
    return {
        "grouping": spark.createDataFrame(named, TABLES["grouping"]),
        "audit_category": spark.createDataFrame(
            list(enumerate(AUDIT_CATEGORIES, start=1)), TABLES["audit_category"]
        ),
        "unit_format": spark.createDataFrame(list(UNIT_FORMATS.items()), TABLES["unit_format"]),
        "dataset_category": spark.createDataFrame(
            list(enumerate(DATASET_CATEGORIES, start=1)), TABLES["dataset_category"]
        ),
    }
