from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leverwise.session import build_session
from leverwise.sources.schemas import TABLES
from leverwise.sources.tables import Tables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """``tables(value=[(1, 10, 5.0, False)], ...)``: a bundle with all tables, empty unless given."""

    def make(**rows) -> Tables:
        return Tables(**{name: spark.createDataFrame(rows.get(name, []), ddl) for name, ddl in TABLES.items()})

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("a bigint, b string", (1, "x"), ...)``."""
    return lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)


def planned(df):
    """The plan a frame would be run by."""
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
