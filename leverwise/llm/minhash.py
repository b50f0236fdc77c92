"""Near-duplicate documents by HyperMinHash sketches (operator 1).

Each distinct set of word shingles becomes one node; documents with equal sets share it. A node's sketch has 128
buckets; a bucket keeps the leading-zero count and ten mantissa bits of its smallest hash, sixteen bits in all. Empty
buckets borrow from a filled one in a fixed random order, for banding only. Nodes that share a band of four registers
are candidates. In every band one pivot meets all other members: such a pair is first judged by the collision-corrected
estimate of its Jaccard similarity, with five standard errors of slack, then on the full sets. Members that this leaves
in different components are compared block by block, sketches first: a pair is judged in the first band that it shares,
and only members with a plausible partner in another component go on to the comparison of full sets. So a group of near
copies costs about one comparison for each member, and no pairs of a group are listed.

A pair at the threshold shares no band with a probability of about 5e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverwise.functions.sizes import is_small
from leverwise.llm.common import ids_and_texts, map_arrow, stage
from leverwise.llm.components import components
from leverwise.llm.text import SPACED, constants, mix, shingle_sets, words_of

SHINGLE = 5
PERCENT = 75
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS_PER_BAND = 4
BANDS = BUCKETS // ROWS_PER_BAND
# Members of a band, shingles and bytes of text of these, that make one block; and shingles that are multiplied at once.
BLOCK = 512
BLOCK_SHINGLES = 200_000
BLOCK_BYTES = 2 * 1024 * 1024
COLUMNS = 4096
SLACK = 5.0

_U = np.uint64
_FACTORS = constants(SHINGLE, 11)
_BORROW = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + _U(5)).reshape(BUCKETS, BUCKETS), axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each sorted set of hashes; 0 marks an empty bucket.

    The bucket is the top seven bits of a hash. Of the other bits, read as a fraction, a register holds one plus the
    number of leading zeros (upper six bits) and the mantissa after the leading one (lower ten).
    """
    table = np.zeros((len(sets), BUCKETS), np.uint16)
    if not sets:
        return table
    sizes = np.array([len(s) for s in sets])
    hashes = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)
    place = row * BUCKETS + bucket
    first = np.ones(len(hashes), bool)
    first[1:] = place[1:] != place[:-1]
    fraction = (hashes[first] << _U(BUCKET_BITS)) >> _U(11)
    exponent = np.frexp(fraction.astype(np.float64))[1]
    zeros = np.where(fraction == 0, 53, 53 - exponent)
    after = (fraction << (zeros + 12).astype(np.uint64)) >> _U(64 - MANTISSA_BITS)
    table.reshape(-1)[place[first]] = ((zeros + 1) << MANTISSA_BITS) | after.astype(np.int64)
    return table


def densified(table: np.ndarray) -> np.ndarray:
    """Empty buckets filled from the first filled one in their own random order; rows without any stay empty."""
    out = table.copy()
    todo = np.flatnonzero((table == 0).any(axis=1) & (table != 0).any(axis=1))
    for step in range(BUCKETS):
        if not len(todo):
            break
        part = out[todo]
        out[todo] = np.where(part == 0, table[todo][:, _BORROW[:, step]], part)
        todo = todo[(out[todo] == 0).any(axis=1)]
    return out


def band_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    full = densified(table).astype(np.uint64).reshape(len(table), BANDS, ROWS_PER_BAND)
    packed = np.zeros(full.shape[:2], np.uint64)
    for j in range(ROWS_PER_BAND):
        packed = (packed << _U(16)) | full[:, :, j]
    return mix(mix(packed) + np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two disjoint sets of n and m hashes are expected to have in common by chance.

    In a bucket with rates a and b the two minima lie in one cell (zeros z, mantissa) of width 2^-(z+1+10) with density
    a b exp(-(a+b)x); the integral over the cells of equal z is in closed form.
    """
    a, b = n / BUCKETS, m / BUCKETS
    rate = np.maximum(a + b, 1e-12)[:, None]
    low = 2.0 ** -np.arange(1, 54)[None, :]
    mass = np.exp(-rate * low) - np.exp(-rate * 2 * low)
    return BUCKETS * (a * b) / rate[:, 0] * (mass * low * 2.0**-MANTISSA_BITS).sum(axis=1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate from raw registers, corrected for chance collisions, and its standard error at the threshold."""
    filled = ((x != 0) | (y != 0)).sum(axis=-1)
    same = ((x == y) & (x != 0)).sum(axis=-1)
    chance = expected_collisions(n.astype(float), m.astype(float))
    found = (same - chance) / np.maximum(filled - chance, 1e-9)
    t = PERCENT / 100
    return found, np.sqrt(t * (1 - t) / np.maximum(filled, 1))


def plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only for pairs whose estimate is far below the threshold or whose sizes rule it out."""
    found, error = estimate(x, y, n, m)
    sizes = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    return sizes & (found >= PERCENT / 100 - SLACK * error)


SKETCH = "doc_id long, n_shingles long, n_bytes long, f1 long, f2 long, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for low, high, _, offsets, words in words_of(batch.column(1), SPACED):
            sets = shingle_sets(words, SHINGLE, _FACTORS)
            table = registers(sets)
            prints = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s), initial=_U(0)))) for s in sets]
            yield pa.record_batch(
                [
                    ids.slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(np.array([p[0] for p in prints], np.uint64).view(np.int64)),
                    pa.array(np.array([p[1] for p in prints], np.uint64).view(np.int64)),
                    pa.array([r.tobytes() for r in table], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "n_bytes", "f1", "f2", "sketch"],
            )


def sketches(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, number of distinct shingles, bytes of text, 128-bit fingerprint of the set, registers."""
    return map_arrow(ids_and_texts(documents), SKETCH, _sketch)


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_table(batch.column(1))).view(np.int64)
        yield pa.record_batch(
            [pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))],
            names=["band", "node"],
        )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep plausible pairs (a, b, sketch and size of both)."""
    for batch in batches:
        x, y = _table(batch.column("x")), _table(batch.column("y"))
        keep = plausible(x, y, batch.column("n").to_numpy(), batch.column("m").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for *_, words in words_of(texts, SPACED):
        yield from shingle_sets(words, SHINGLE, _FACTORS)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs of texts (a, b, x, y) whose full shingle sets are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for row, (one, two) in enumerate(zip(_sets(batch.column("x")), _sets(batch.column("y")), strict=True)):
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep[row] = both > 0 and 100 * both >= PERCENT * (len(one) + len(two) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given ids; the ids are broadcast where their measured size allows it."""
    return texts.join(F.broadcast(ids) if is_small(ids, 16 * 1024 * 1024) else ids, "node", "left_semi")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("m"))
    likely = stage(map_arrow(pairs.join(left, "a").join(right, "b"), "a long, b long", _judge), "likely")
    ids = stage(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), "ids")
    own = _only(texts, ids)
    joined = likely.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(
        own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b"
    )
    return stage(map_arrow(joined.select("a", "b", "x", "y"), "a long, b long", _confirm), "links")


def _links_within(rows: pa.Table) -> pa.RecordBatch:
    """Links that join components of one pair of blocks, at most one for each merge.

    Intersections of all sets come from products of 0/1 matrices over the shingles that occur more than once.
    """
    node, component, block = (rows.column(c).to_numpy().copy() for c in ("node", "component", "block"))
    sets = [s for chunk in rows.column("text").chunks for s in _sets(chunk)]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    one = np.flatnonzero(block == rows.column("i")[0].as_py())
    two = np.flatnonzero(block == rows.column("j")[0].as_py())
    both = np.zeros((len(one), len(two)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        first, last = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[first:last], column[first:last] - low] = 1
        both += part[one] @ part[two].T
    union = size[one][:, None] + size[two][None, :] - both
    linked = (both > 0) & (100 * both >= PERCENT * union) & (component[one][:, None] != component[two][None, :])
    a, b = [], []
    for x, y in np.argwhere(linked):
        p, q = one[x], two[y]
        if component[p] != component[q]:
            a.append(max(node[p], node[q]))
            b.append(min(node[p], node[q]))
            component[component == component[q]] = component[p]
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _likely_within(rows: pa.Table) -> pa.RecordBatch:
    """Members of one pair of blocks that have a plausible partner in another component and share no earlier band."""
    node, component, block, n = (rows.column(c).to_numpy() for c in ("node", "component", "block", "n_shingles"))
    table = _table(rows.column("sketch").combine_chunks())
    keys = band_keys(table).view(np.int64)
    same = keys == rows.column("band")[0].as_py()
    number = int(same.sum(axis=0).argmax())
    there = same[:, number]
    one = np.flatnonzero(there & (block == rows.column("i")[0].as_py()))
    two = np.flatnonzero(there & (block == rows.column("j")[0].as_py()))
    likely = np.zeros(len(node), bool)
    for x in one.tolist():
        others = two[component[two] != component[x]]
        others = others[~(keys[others, :number] == keys[x, :number]).any(axis=1)]
        if len(others):
            own = np.full(len(others), n[x])
            close = others[plausible(np.broadcast_to(table[x], (len(others), BUCKETS)), table[others], own, n[others])]
            likely[close] = True
            likely[x] |= len(close) > 0
    return pa.record_batch(
        [pa.array(c[likely], pa.int64()) for c in (rows.column("band").to_numpy(), node, component)], names=["band", "node", "component"]
    )


def _per_pair(work: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """Apply the work to the rows of each pair of blocks.

    Rows come sorted by (band, i, j), and a pair of blocks never spans two tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                key = tuple(keys[:, low])
                if held and key != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
                last = key
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _in_blocks(members: DataFrame) -> DataFrame:
    """Rows (band, i, j, block, node, component) of every pair of blocks that has to be compared.

    The largest component of a band is only compared with the rest, not with itself. Both are cut into blocks of bounded
    size (members, shingles, bytes of text), and every pair of blocks that needs it is one unit of work.
    """
    per = members.groupBy("band", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.sum("n_bytes").alias("bytes")
    )
    band = per.groupBy("band").agg(
        F.count("*").alias("components"), F.max(F.struct("n", "component", "weight", "bytes")).alias("top"),
        F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("bytes").alias("bytes"),
    ).where("components > 1")

    def parts(n: Column, weight: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, weight / BLOCK_SHINGLES, size / BLOCK_BYTES)).cast("int")

    few = [F.col(c) - F.col(f"top.{c}") for c in ("n", "weight", "bytes")]
    band = band.select(
        "band", F.col("top.component").alias("largest"),
        parts(*(F.col(f"top.{c}") for c in ("n", "weight", "bytes"))).alias("many"), parts(*few).alias("few"),
    )
    inside = F.col("component") == F.col("largest")
    turn = F.xxhash64("node")
    placed = members.join(band, "band").withColumn(
        "block", F.when(inside, F.col("few") + F.pmod(turn, "many")).otherwise(F.pmod(turn, "few")).cast("int")
    )
    others = F.sequence(F.lit(0), F.when(inside, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))
    copies = placed.withColumn("other", F.explode(others))
    return stage(copies.select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
        "component",
    ), "blocks")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _remaining_links(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components among the members (band, node, component) of each band."""
    sized = members.join(nodes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_bytes").alias("n_bytes")), "node")
    sketched = _in_blocks(sized.withColumn("n_bytes", F.lit(0))).join(nodes.select("node", "sketch", "n_shingles"), "node")
    triple = "band long, node long, component long"
    likely = stage(
        map_arrow(
            _ordered(sketched.select("band", "i", "j", "block", "node", "component", "n_shingles", "sketch")), triple, _per_pair(_likely_within)
        ).distinct(), "likely",
    )
    keyed = _in_blocks(likely.join(sized.drop("component"), ["band", "node"]))
    own = _only(texts, keyed.select("node").distinct())
    rows = keyed.join(own, "node").select("band", "i", "j", "block", "node", "component", "text")
    return stage(map_arrow(_ordered(rows), "a long, b long", _per_pair(_links_within)), "links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id, kept.

    A null, empty or blank text has no shingles and is linked with nothing. Equal texts are linked. Rows that repeat
    an id count as one document: they are in one component. A row without id is linked with nothing: its component_id
    is null and it is kept. Other columns are ignored. An empty table gives no rows.
    """
    sketched = stage(sketches(documents), "sketches")
    key = ["f1", "f2", "n_shingles"]
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    nodes = stage(
        known.groupBy(*key).agg(
            F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.max("n_bytes").alias("n_bytes")
        ), "nodes"
    )
    classes = nodes.select(*key, "node")
    tied = known.join(classes, key).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    bands = map_arrow(nodes.select("node", "sketch"), "band long, node long", _bands)
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stage(bands.join(shared, "band").distinct(), "bands")
    texts = ids_and_texts(documents).select(F.col("doc_id").alias("node"), "text").where("node is not null")
    pivots = members.groupBy("band").agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node")).alias("first"))
    met = stage(members.join(pivots.select("band", F.col("first.node").alias("pivot")), "band"), "pivots")
    rest = met.where("node <> pivot")
    star = rest.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    links = _verified(star, nodes, texts)
    found = stage(components(links), "components")
    open_members = rest.select("band", "node").join(found, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component")
    )
    more = _remaining_links(open_members, nodes, texts)
    every = components(links.union(more).union(tied))
    out = sketched.join(every, sketched.doc_id == every.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with all columns: one for each component, and all rows without id.

    Of rows that repeat a kept id the one with the least text (by hash, then by content) stays.
    """
    kept = stage(near_duplicates(documents).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    named = documents.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    turn = "_".join(["turn", *documents.columns])
    first = named.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    return first.select(documents.columns).union(documents.where("doc_id is null"))
