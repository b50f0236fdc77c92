"""Near-duplicate vectors by Euclidean p-stable hashing (operator 3).

Vectors of one label and length are compared. Equal vectors form one node. Normalised vectors are projected on random
Gaussian directions, shifted and cut into cells; sixteen cells make the key of a table, and there are 56 tables. On the
unit sphere a cosine of 0.98 is a distance of 0.2, an eighth of a cell; such a pair shares no key with a probability of
about 1e-5, and two orthogonal vectors share a given key with 6e-7. Members of a bucket are compared exactly, block by
block. A pair is counted in the first table that holds it, so links are counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.llm.common import map_arrow, stage
from leverwise.llm.components import components
from leverwise.llm.text import constants, mix

COSINE = 0.98
CELL = 1.6
CELLS = 16
TABLES = 56
SEED = 17
# Vectors of a bucket in one block, and rows of a block that are multiplied at once.
BLOCK = 4096
STRIPE = 256

_U = np.uint64
NODES = "vec_id long, label long, f1 long, f2 long, size int, vector binary, codes binary"


@lru_cache(maxsize=8)
def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng([SEED, size])
    return made.standard_normal((size, TABLES * CELLS)), made.uniform(0, CELL, TABLES * CELLS)


def table_codes(vectors: np.ndarray) -> np.ndarray:
    """One 32-bit key for each table of each (unnormalised) row."""
    directions, shift = _directions(vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ directions + shift) / CELL).astype(np.int64).view(np.uint64)
    keys = (cells.reshape(len(vectors), TABLES, CELLS) * constants(CELLS, 23)).sum(axis=2, dtype=np.uint64)
    return (mix(keys) >> _U(32)).astype(np.uint32)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors get a fingerprint, their bytes and their keys; the others nulls."""
    for batch in batches:
        n = batch.num_rows
        rows: list[np.ndarray | None] = []
        for label, value, name in zip(batch.column(1), batch.column(2), batch.column(0), strict=True):
            if not (label.is_valid and value.is_valid and name.is_valid) or value.values.null_count or not len(value):
                rows.append(None)
                continue
            vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            largest = float(np.abs(vector).max())
            if not (np.isfinite(largest) and largest > 0):
                rows.append(None)
                continue
            # Squares of very large or small components would overflow or vanish; a power of two changes no direction.
            exponent = int(np.frexp(largest)[1])
            rows.append(np.ldexp(vector, -exponent) if abs(exponent) > 300 else vector)
        f1, f2, size = [None] * n, [None] * n, [None] * n
        data, codes = [None] * n, [None] * n
        lengths = np.array([0 if r is None else len(r) for r in rows])
        for width in np.unique(lengths[lengths > 0]).tolist():
            some = np.flatnonzero(lengths == width)
            table = np.stack([rows[i] for i in some]) + 0.0
            bits = mix(table.view(np.uint64))
            one = mix((bits * constants(width, 29)).sum(axis=1, dtype=np.uint64)).view(np.int64)
            two = mix((bits * constants(width, 31)).sum(axis=1, dtype=np.uint64)).view(np.int64)
            keys = table_codes(table)
            for k, i in enumerate(some.tolist()):
                f1[i], f2[i], size[i] = int(one[k]), int(two[k]), width
                data[i], codes[i] = table[k].tobytes(), keys[k].tobytes()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        made = [pa.array(v, k) for v, k in zip((f1, f2, size, data, codes), kinds, strict=True)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *made],
            names=["vec_id", "label", "f1", "f2", "size", "vector", "codes"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32).reshape(n, TABLES)
        where = mix(batch.column("label").to_numpy().view(np.uint64) * _U(3) + batch.column("size").to_numpy().astype(_U))
        table = np.arange(TABLES, dtype=np.uint64)[None, :]
        bucket = mix(mix(codes.astype(np.uint64) * _U(64) + table) ^ where[:, None])
        yield pa.record_batch(
            [pa.array(bucket.view(np.int64).reshape(-1)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)),
             pa.array(np.repeat(batch.column("node").to_numpy(), TABLES))],
            names=["bucket", "number", "node"],
        )


def _compared(rows: pa.Table) -> pa.RecordBatch:
    """Links of one pair of blocks: (node, weight of its partners) and at most one joining link for each merge."""
    node, label, size, weight, block = (
        rows.column(c).to_numpy() for c in ("node", "label", "size", "weight", "block")
    )
    number = rows.column("number")[0].as_py()
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint32).reshape(len(node), TABLES)
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    data = rows.column("vector").to_pylist()
    total = np.zeros(len(node), np.int64)
    group = np.arange(len(node))
    a, b = [], []
    for width in np.unique(size).tolist():
        same = size == width
        one, two = np.flatnonzero(same & (block == i)), np.flatnonzero(same & (block == j))
        if not len(one) or not len(two):
            continue
        right = np.frombuffer(b"".join([data[k] for k in two]), np.float64).reshape(len(two), width)
        right_norm = np.linalg.norm(right, axis=1)
        for low in range(0, len(one), STRIPE):
            some = one[low : low + STRIPE]
            left = np.frombuffer(b"".join([data[k] for k in some]), np.float64).reshape(len(some), width)
            near = left @ right.T / (np.linalg.norm(left, axis=1)[:, None] * right_norm[None, :]) >= COSINE
            near &= label[some][:, None] == label[two][None, :]
            if i == j:
                near &= some[:, None] < two[None, :]
            for p, partners in zip(some, near, strict=True):
                q = two[partners]
                if not len(q):
                    continue
                q = q[(codes[q, number] == codes[p, number]) & ~(codes[q, :number] == codes[p, :number]).any(axis=1)]
                total[p] += weight[q].sum()
                total[q] += weight[p]
                apart = np.unique(group[q])
                for g in apart[apart != group[p]]:
                    a.append(node[p])
                    b.append(node[q[group[q] == g][0]])
                    group[group == g] = group[p]
    counted = np.flatnonzero(total)
    return pa.record_batch(
        [pa.array(np.concatenate([node[counted], np.array(a, np.int64)])),
         pa.array(np.concatenate([total[counted], np.zeros(len(a), np.int64)])),
         pa.array([None] * len(counted) + b, pa.int64())],
        names=["node", "weight", "other"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, i, j), and a pair of blocks never spans two tasks."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high == low:
                continue
            key = tuple(keys[:, low])
            if held and key != last:
                yield _compared(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield _compared(pa.Table.from_batches(held))


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """Per row of ``embeddings``: vec_id, n_links, component_id, kept.

    A vector without label, that is null, empty or zero, or that holds a null or non-finite component links with
    nothing; so does a row without id (its component_id is null and it is kept). Rows that repeat an id are vectors of
    their own but share a component. Vectors of different lengths never link. Other columns are ignored.
    """
    own = embeddings.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
    every = stage(map_arrow(own, NODES, _prepare), "vectors")
    key = ["label", "f1", "f2", "size"]
    usable = every.where("f1 is not null")
    nodes = stage(
        usable.groupBy(*key).agg(
            F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector"),
            F.first("codes").alias("codes"),
        ),
        "nodes",
    )
    keys = map_arrow(nodes.select("node", "label", "size", "codes"), "bucket long, number int, node long", _keys)
    shared = keys.groupBy("bucket", "number").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"),
                                                  F.count("*").alias("n")).where("n > 1").drop("n")
    placed = keys.join(shared, ["bucket", "number"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    )
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = copies.select(
        "bucket", "number", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
        "node",
    )
    rows = keyed.join(nodes, "node").select(
        "bucket", "i", "j", "number", "block", "node", "label", "size", "weight", "vector", "codes"
    )
    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stage(map_arrow(ordered, "node long, weight long, other long", _blocks), "found")
    counts = found.where("other is null").groupBy("node").agg(F.sum("weight").alias("near"))
    tied = usable.join(nodes.select(*key, "node"), key).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    links = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    classes = nodes.select(*key, "node", "weight").join(counts, "node", "left").select(
        *key, (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")
    )
    grouped = components(links.union(tied.where("a <> b")))
    out = every.join(classes, key, "left").join(grouped, every.vec_id == grouped.node, "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
