"""Connected components of a graph held as a table, by alternating large-star and small-star steps.

Both steps only take minima per key and join them back; no neighbourhood is gathered into one row, so a node with
many links is an ordinary skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.llm.common import stage


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _directed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(tied.union(least.select("a", F.col("m").alias("b"))))


def _mark(edges: DataFrame) -> tuple:
    """What two equal sets of edges have in common."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Null ends are ignored. Ends when a round changes nothing, after about log(longest chain) rounds.
    """
    edges = stage(_directed(links.select("a", "b").where("a is not null and b is not null")), "edges")
    before = _mark(edges)
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
