"""Prefix trie of conversations (operator 13).

Turns become ids of a dictionary. The rebuilt conversations, as sequences of ids, are sorted into range shards; equal
sequences stand next to each other in the order of their conversations. A shard is one ternary search tree, balanced by
inserting medians first; one walk over its entries, children before parents, adds up members, leaves and savings.

Only nodes on the paths of a shard's first and last sequence can also occur in other shards. These boundary nodes are
merged apart, sixty-four neighbouring shards at a time, until one group holds all: what no longer lies at the edge of a
group is closed. Conversations that end at a boundary node travel as joined pieces in order and are hashed as a stream.

One conversation is one array of ids and has to fit into a task's memory; nothing else grows with a group of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverwise.functions.sizes import is_small
from leverwise.llm.common import map_arrow, stage

# Turns and conversations of one shard.
SHARD = 500_000
# Neighbouring shards whose boundary nodes are merged at once.
FANOUT = 64
# Conversations whose ids travel in one piece.
PIECE = 50_000
# A conversation shares its first turns with the one whose id is the next lower multiple; they are at most HEADS - 1.
FAMILY = 5
HEADS = 9

_NOTHING = hashlib.sha256(b"").hexdigest()
NODE, BOUNDARY, ENDS = 0, 1, 2
PARTS = (
    "kind int, shard int, place int, key binary, parent binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
)
_PARTS = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), ("place", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()),
     *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                 "saved_tokens", "bytes")), ("ends", pa.string())]
)
# Where a boundary node lies: on the path of the shard's first sequence, of its last one, or of both.
FIRST, LAST = 1, 2


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_bytes): role and text of a turn are represented by their SHA-256."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.col("conv_id").cast("bigint"), "turn", F.unhex(F.sha2(said, 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).where("conv_id is not null")


def _encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the turns of each conversation in order, as ids of the dictionary, and their bytes."""
    known = turns.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"))
    dictionary = stage(known.withColumn("id", F.monotonically_increasing_id()), "turns")
    placed = turns.drop("n_bytes").join(dictionary, "digest")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "n_bytes")))
    held = placed.groupBy("conv_id").agg(ordered.alias("held"))
    return held.select("conv_id", F.col("held.id").alias("ids"), F.col("held.n_bytes").alias("sizes"))


def _rebuilt(own: DataFrame) -> DataFrame:
    """(ids, sizes, conv_id): the first turns come from the conversation at the head of the family."""
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("head"), F.col("ids").alias("head_ids"), F.col("sizes").alias("head_sizes")
    )
    count = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    joined = own.withColumn("head", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "head", "left")

    def spliced(name: str) -> Column:
        before = F.coalesce(F.slice(f"head_{name}", F.lit(1), count), F.array().cast("array<bigint>"))
        return F.concat(before, F.slice(name, count + 1, F.greatest(F.size(name) - count, F.lit(0)))).alias(name)

    return joined.select(spliced("ids"), spliced("sizes"), "conv_id")


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before both its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


class TernaryTree:
    """Sequences of ids; entry 0 is the root of the trie, every other entry one prefix.

    ``less`` and ``more`` lead to entries with the same prefix before them, ``below`` to those one id longer.
    """

    def __init__(self) -> None:
        self.id, self.bytes, self.up, self.depth = [0], [0], [-1], [0]
        self.less, self.more, self.below = [-1], [-1], [-1]

    def _new(self, turn: int, size: int, up: int) -> int:
        self.id.append(turn)
        self.bytes.append(size)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        for links in (self.less, self.more, self.below):
            links.append(-1)
        return len(self.id) - 1

    def add(self, ids: list[int], sizes: list[int]) -> int:
        """The entry of the sequence; it and its prefixes are made where they are missing."""
        node, known = 0, self.id
        for turn, size in zip(ids, sizes, strict=True):
            links, at = self.below, node
            while (following := links[at]) >= 0:
                at = following
                if turn == known[at]:
                    break
                links = self.less if turn < known[at] else self.more
            else:
                following = links[at] = self._new(turn, size, node)
            node = following
        return node

    def path(self, node: int) -> list[int]:
        """Entries from the root to the node."""
        found = [node]
        while found[-1]:
            found.append(self.up[found[-1]])
        return found[::-1]


def _shard(number: int, rows: list[tuple[list[int], list[int], int]]) -> Iterator[dict]:
    """Nodes and boundary nodes of the sorted rows (ids, sizes, conv_id) of one shard."""
    starts = [i for i, row in enumerate(rows) if not i or row[0] != rows[i - 1][0]]
    tree = TernaryTree()
    at = {}
    for k in medians(len(starts)):
        at[k] = tree.add(*rows[starts[k]][:2])
    size = len(tree.id)
    members, least, ends = [0] * size, [None] * size, {}
    for k, (begin, end) in enumerate(zip(starts, [*starts[1:], len(rows)], strict=True)):
        ends[at[k]] = [row[2] for row in rows[begin:end]]
        members[at[k]], least[at[k]] = end - begin, rows[begin][2]
    place, keys = [0] * size, {0: b""}
    for flag, k in ((FIRST, 0), (LAST, len(starts) - 1)):
        for node in tree.path(at[k]):
            place[node] |= flag
            if node:
                keys[node] = hashlib.sha256(keys[tree.up[node]] + tree.id[node].to_bytes(8, "big")).digest()
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    # Entries are made after the prefixes they extend: from the last to the first, children come before parents.
    for node in range(size - 1, -1, -1):
        up = tree.up[node]
        if not place[node]:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * tree.bytes[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
    for node in range(size):
        up, edge = tree.up[node], place[node] > 0
        own = ends.get(node, [])
        if edge:
            for low in range(0, len(own), PIECE):
                text = ",".join(map(str, own[low : low + PIECE]))
                yield {"kind": ENDS, "shard": number, "place": low // PIECE, "key": keys[node], "ends": text}
        inside = not edge and not place[up]
        yield {
            "kind": BOUNDARY if edge else NODE, "shard": number, "place": place[node], "key": keys.get(node),
            "parent": keys[up] if up >= 0 and not inside else None, "conv_id": least[node], "depth": tree.depth[node],
            "parent_conv_id": least[up] if inside else None, "n_convs": members[node], "n_children": children[node],
            "n_leaves": leaves[node], "saved_tokens": saved[node], "bytes": tree.bytes[node],
            "ends": None if edge else hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(),
        }


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[list[int], list[int], int]] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "conv_id")), strict=True)
    if rows:
        yield from _in_batches(_shard(TaskContext.get().partitionId(), rows), _PARTS)


def _merged(final: bool) -> Callable[[pa.Table], pa.Table]:
    """One group of neighbouring shards as one: sums of equal boundary nodes; what has left the edge is closed."""

    def work(rows: pa.Table) -> pa.Table:
        listed = rows.to_pylist()
        low, high = (f(r["shard"] for r in listed) for f in (min, max))
        number = listed[0]["shard"] // FANOUT
        nodes: dict[bytes, dict] = {}
        for row in listed:
            edge = row["place"] & ((FIRST if row["shard"] == low else 0) | (LAST if row["shard"] == high else 0))
            held = nodes.setdefault(row["key"], row | {"place": 0, "shard": number})
            held["place"] |= edge
            if held is not row and "merged" in held:
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    held[name] += row[name]
                held["conv_id"] = min(held["conv_id"], row["conv_id"])
            held["merged"] = True
        for held in sorted(nodes.values(), key=lambda r: -r["depth"]):
            if held["place"] and not final:
                continue
            held["kind"] = NODE
            held["n_leaves"] = held["n_leaves"] or 1
            held["saved_tokens"] += (held["n_convs"] - 1) * held["bytes"]
            if held["parent"] is not None:
                up = nodes[held["parent"]]
                up["n_children"] += 1
                up["n_leaves"] += held["n_leaves"]
                up["saved_tokens"] += held["saved_tokens"]
        return pa.Table.from_pylist([{k: v for k, v in r.items() if k != "merged"} for r in nodes.values()], _PARTS)

    return work


def _closed(boundary: DataFrame, shards: int) -> DataFrame:
    """All boundary nodes with their final counts, by rounds of merging neighbours."""
    done = None
    while True:
        final = shards <= FANOUT
        group = F.floor(F.col("shard") / FANOUT).alias("group")
        merged = stage(boundary.groupBy(group).applyInArrow(_merged(final), PARTS), "boundary")
        nodes = merged.where(F.col("kind") == NODE)
        done = nodes if done is None else done.union(nodes)
        if final:
            return done
        boundary, shards = merged.where(F.col("kind") == BOUNDARY), -(-shards // FANOUT)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, shard and place: one hash for each key, whatever the length of what it joins."""

    def rows() -> Iterator[dict]:
        key, made = None, None
        for batch in batches:
            for own, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if own == key:
                    made.update(b",")
                else:
                    if key is not None:
                        yield {"key": key, "hash": made.hexdigest()}
                    key, made = own, hashlib.sha256()
                made.update(text.encode())
        if key is not None:
            yield {"key": key, "hash": made.hexdigest()}

    yield from _in_batches(rows(), pa.schema([("key", pa.binary()), ("hash", pa.string())]))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first; turns that agree there by the SHA-256 of role and text. Null role or text
    is empty. Rows that repeat are turns of their own. Rows without conv_id belong to no conversation. Remainders of
    negative ids are those of SQL: the head of -3 is 0. Other columns are ignored. An empty table gives no rows.
    """
    own = stage(_encoded(stage(_turns(conversations), "digests")), "own")
    sequences = stage(_rebuilt(own), "sequences")
    spark = conversations.sparkSession
    total = sequences.agg(F.sum(F.size("ids") + F.lit(1)).alias("n")).first().n or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    ordered = sequences.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    made = stage(map_arrow(ordered, PARTS, _shards), "shards")
    highest = made.agg(F.max("shard").alias("n")).first().n or 0
    closed = stage(_closed(made.where(F.col("kind") == BOUNDARY), highest + 1), "closed")
    pieces = made.where(F.col("kind") == ENDS).select("key", "shard", "place", "ends")
    sorted_pieces = pieces.repartition("key").sortWithinPartitions("key", "shard", "place")
    hashes = stage(map_arrow(sorted_pieces, "key binary, hash string", _hashes), "ends")
    small = is_small(closed)
    mark = F.broadcast if small else (lambda df: df)
    edge = closed.drop("ends").join(mark(hashes), "key", "left")
    edge = edge.withColumn("ends", F.coalesce("hash", F.lit(_NOTHING))).drop("hash")
    nodes = made.where(F.col("kind") == NODE)
    parents = closed.select(F.col("key").alias("parent"), F.col("conv_id").alias("of_parent"))
    joined = nodes.unionByName(edge).join(mark(parents), "parent", "left")
    return joined.select(
        "conv_id", "depth", F.coalesce("of_parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )
