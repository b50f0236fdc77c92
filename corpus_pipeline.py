"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverwise.llm import decontaminate, minhash, packing, pii, toxicity
from leverwise.llm.common import new_folder, prepare, read_table


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones outside the held-out fold."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of nothing else go."""
    return _with_length(decontaminate.remove_passages(docs, read_table(spark, sf_dir, "benchmark")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain and disguised, are masked."""
    return _with_length(pii.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# A trained model and token ids cannot be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; each result is written as Parquet and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
