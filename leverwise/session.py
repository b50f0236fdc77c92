"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leverwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Taken from the session; made up only for local runs."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="leverwise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


# With it Spark removes the shuffles of a query when that ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def held(df: DataFrame) -> DataFrame:
    """The rows in packed files of the shared folder; the shuffles that made them are removed at once.

    For frames that may be a good part of the facts: a checkpoint is not packed and takes several times the disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/held-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of the executors that made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
