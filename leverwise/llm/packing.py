"""Best-fit packing of documents into sequences by linear grouping (operator 6).

Documents of one length are alike, so the packing is planned on the counts of the 1,024 possible lengths and never on
documents. Lengths above an eighth of a sequence are sorted and cut into groups of equal cardinality; each counts as the
longest of its group. The few sizes that remain are packed by linear programming over configurations (columns found by
a knapsack), rounded down. Actual lengths then take the places of their groups, and everything left, above all the small
documents, goes best-fit, longest first, into the smallest gap that holds it, a whole run of equal sequences at a time.

The plan lists, for each length, ranges of ranks and the sequences and offsets they go to. It holds a few thousand rows
whatever the number of documents. Each task numbers its own documents within each length, a running sum over the tasks
makes these numbers global, and the plan turns a number into a place.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leverwise.llm.chunks import encoder
from leverwise.llm.common import ids_and_texts, map_arrow, stage

FILE = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
# Lengths above this part of a sequence are large.
SMALL_PART = 8
GROUPS = 48
# The linear program ends when no configuration can better its value by more than this part.
GAP = 5e-4
STEPS = 5000
# Parts of the configurations that are tried.
PARTS = (1.0, 0.98, 0.96, 0.94, 0.9, 0.85, 0.8, 0.7, 0.6)


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits (each size any number of times) and how often each size is taken."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    size = np.array(sizes)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(size <= room)
        if len(fits):
            value = best[room - size[fits]] + worth[fits]
            k = int(np.argmax(value))
            if value[k] > best[room] + 1e-12:
                best[room], taken[room] = value[k], fits[k]
    used, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            used[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), used


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(whole number of sequences, how often each size) from the linear program over all configurations.

    A simplex method whose entering column is the configuration of the highest worth at the current prices.
    """
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ np.array(demand, float)
    for _ in range(STEPS):
        worth, column = _best_configuration(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + GAP:
            break
        change = inverse @ column
        rising = change > 1e-9
        ratio = np.where(rising, amount / np.where(rising, change, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * change, 0)
        amount[out] = ratio[out]
        columns[:, out] = column
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
    return [(int(n + 1e-9), columns[:, k]) for k, n in enumerate(amount) if int(n + 1e-9) > 0]


def groups_of(counts: dict[int, int], wanted: int) -> list[list[tuple[int, int]]]:
    """Runs (length, number), longest first, cut into groups of equal cardinality."""
    total = sum(counts.values())
    share, out, room = -(-total // wanted), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


class Plan:
    """Places for all documents of each length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sequences = 0
        self.next_rank: dict[int, int] = defaultdict(int)
        # length -> rows (first rank, first sequence, documents of this length a sequence, offset)
        self.slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        # gap -> runs (first sequence, number of sequences) with that gap
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def open(self, n: int) -> tuple[int, int]:
        """A run of n new sequences."""
        self.sequences += n
        return self.sequences - n, n

    def place(self, length: int, first: int, n: int, each: int, gap: int) -> None:
        """Put ``each`` documents into each of n sequences from ``first`` on, which have this gap."""
        self.slots[length].append((self.next_rank[length], first, each, self.capacity - gap))
        self.next_rank[length] += n * each

    def fill(self, length: int, count: int) -> None:
        """Best fit for ``count`` documents of a length."""
        while count:
            gap = min((g for g, runs in self.gaps.items() if g >= length and runs), default=0)
            if not gap:
                self.gaps[self.capacity].append(self.open(-(-count // (self.capacity // length))))
                continue
            first, n = self.gaps[gap].pop()
            each = min(gap // length, count)
            use = min(n, count // each)
            self.place(length, first, use, each, gap)
            self.gaps[gap - each * length].append((first, use))
            if use < n:
                self.gaps[gap].append((first + use, n - use))
            count -= use * each


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Pack counts of documents by length (1 to capacity).

    Rounding makes the program ask for more sequences than the actual lengths need; so only a part of each configuration
    is opened at first. Of several parts the one that ends with the fewest sequences is taken.
    """
    large = {s: n for s, n in counts.items() if s * SMALL_PART > capacity and n}
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for group in groups_of(large, groups) if large else []:
        merged[group[0][0]] += group
    sizes = list(merged)
    found = configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity) if sizes else []
    plans = [_planned(counts, [list(merged[s]) for s in sizes], found, part, capacity) for part in PARTS]
    return min(plans, key=lambda made: made.sequences)


def _planned(counts: dict[int, int], queues: list, found: list, part: float, capacity: int) -> Plan:
    """Configurations with actual lengths in all places but the last and smallest, then best fit for all that is left."""
    made, left = Plan(capacity), dict(counts)
    for often, column in found:
        n = int(often * part)
        chosen = [g for g, k in enumerate(np.rint(column)) for _ in range(int(k))]
        for use, lengths in _substituted(queues, chosen[: max(len(chosen) - 1, 1)], n) if n else []:
            first, gap = made.open(use)[0], capacity
            for length in lengths:
                made.place(length, first, use, 1, gap)
                left[length] -= use
                gap -= length
            made.gaps[gap].append((first, use))
    for length in sorted(left, reverse=True):
        made.fill(length, left[length])
    return made


def _substituted(queues: list, column: list[int], n: int) -> Iterator[tuple[int, list[int]]]:
    """Runs (sequences, actual lengths) for n sequences with these groups; takes the lengths from the queues."""
    places = []
    for group in column:
        runs, need = [], n
        while need:
            length, have = queues[group][0]
            use = min(need, have)
            runs.append((length, use))
            need -= use
            if use == have:
                queues[group].pop(0)
            else:
                queues[group][0] = (length, have - use)
        places.append(runs)
    at = 0
    positions = [[0, 0] for _ in places]
    while at < n:
        use = min(runs[k][1] - done for runs, (k, done) in zip(places, positions, strict=True))
        yield use, [runs[k][0] for runs, (k, _) in zip(places, positions, strict=True)]
        at += use
        for runs, position in zip(places, positions, strict=True):
            position[1] += use
            if position[1] == runs[position[0]][1]:
                position[0], position[1] = position[0] + 1, 0


PIECES = "part int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(documents: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """All pieces with their number among those of the same length in the same task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names = batch.column(0)
            for low, high, ids, of in held.encode(batch.column(1)):
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for i in range(high - low):
                    own = np.append(ids[of[i] : of[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    data = memoryview(own).cast("B")
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        row.append(low + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(data[4 * a : 4 * b]))
                        rank.append(seen[b - a])
                        seen[b - a] += 1
                yield pa.record_batch(
                    [pa.array(np.full(len(row), part, np.int32)), pa.array(rank, pa.int64()), names.take(pa.array(row)),
                     pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                     pa.array(crc, pa.int64())],
                    names=["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return map_arrow(ids_and_texts(documents), PIECES, work, f"encoder {path}")


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(documents: DataFrame, path: str = FILE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of one id, the end id. Only documents longer than a sequence are cut; their
    first piece takes what the whole pieces leave. Rows that repeat an id, and rows without id, are documents of their
    own. Other columns are ignored. An empty table gives no rows.
    """
    cut = stage(pieces(documents, path, end_id, capacity), "pieces")
    per_task = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, capacity)
    table = {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in made.slots.items()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("rank") + F.col("before")).alias("r")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("r").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                first, begin, each, at = table[size]
                k = np.searchsorted(first, rank[rows], "right") - 1
                ahead = rank[rows] - first[k]
                sequence[rows] = begin[k] + ahead // each[k]
                offset[rows] = at[k] + ahead % each[k] * size
            yield pa.record_batch(
                [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return map_arrow(numbered, PLACED, work)
