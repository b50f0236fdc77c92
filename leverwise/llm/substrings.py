"""Passages that occur in an earlier document too, found through a partitioned count-min sketch (operator 12).

A window is a run of thirteen words. Documents are written once in packets of bounded size, bucketed by packet, so that
every later pass reads them where they are and no text is shuffled.

First pass: each packet's windows give a count-min sketch of two rows. Counts end at two, as only repetition matters. A
row is cut into segments by the leading bits of the hash; the number of segments follows the input, so the load of a
cell does not. The sketches of all packets are summed segment by segment, and each packet gets back which of its own
cells were reached twice. A window whose cells were all reached twice is estimated to be repeated: the estimate is never
too low, so no repeated window is lost; about one in twenty of the others is let through.

Second pass: each packet sends its estimated windows once each, with the least id of a document that holds them, as
128-bit hashes in packed form. They are grouped by the whole hash; a packet is told which of its windows occur in a
smaller document elsewhere. What repeats inside the packet it sees itself. So a window that a third of all documents hold
costs one entry for each packet.

Third pass: the words that such windows cover are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.llm.common import ids_and_texts, map_arrow, new_folder, stage, tidied
from leverwise.llm.packed import pack, unpack
from leverwise.llm.text import WHITE, Alphabet, constants, mix, run_hashes, view, word_bounds

WINDOW = 13
# Text of one packet (more only for a single longer document).
PACKET_BYTES = 12 * 1024 * 1024
# Cells of one segment of a sketch row, windows that it is made for, and bytes of text that hold about one window.
CELL_BITS = 24
SEGMENT_WINDOWS = 1 << 22
WINDOW_BYTES = 5
# Segments of the exact grouping for one of the sketch.
FINER_BITS = 2
MAX_BUCKETS = 50_000
# Kept words that are put together at once.
JOINED = 400_000

_U = np.uint64
_WORDS = Alphabet(WHITE)
# Two independent hashes of a window: capitals count, unlike in the alphabet's own values.
_VALUES = constants(256, 41), constants(256, 43)
_FACTORS = constants(WINDOW, 45), constants(WINDOW, 47)


class Windows:
    """All windows of some texts: place of the first word, id of the document, both hashes. Rows without id have none."""

    def __init__(self, texts: pa.Table):
        column = texts.column("text").combine_chunks()
        self.raw, offsets = view(column)
        self.starts, self.ends = word_bounds(self.raw, offsets, _WORDS)
        self.of = np.searchsorted(self.starts, offsets)
        ids = texts.column("doc_id").combine_chunks()
        many = np.diff(self.of)
        own = np.repeat(np.arange(len(many)), np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.maximum(many - WINDOW + 1, 0), 0))
        counts = np.bincount(own, minlength=len(many))
        begin = np.cumsum(counts) - counts
        self.at = np.arange(len(own)) - begin[own] + self.of[own]
        self.doc = ids.fill_null(0).to_numpy()[own]
        self.hashes = tuple(self._hash(values, factors) for values, factors in zip(_VALUES, _FACTORS, strict=True))

    def _hash(self, values: np.ndarray, factors: np.ndarray) -> np.ndarray:
        words = run_hashes(self.raw, self.starts, self.ends, values)
        total = np.zeros(max(len(words) - WINDOW + 1, 0), np.uint64)
        for j in range(WINDOW):
            total += words[j : j + len(total)] * factors[j]
        return mix(total[self.at]) if len(self.at) else np.zeros(0, np.uint64)


def grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, and where each group begins."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the packets of a task; ids are never used again by another task."""
    task, number, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        _, offsets = view(batch.column(1))
        packets = []
        for length in np.diff(offsets).tolist():
            if size and size + length > PACKET_BYTES:
                number, size = number + 1, 0
            size += length
            packets.append((task << 32) + number)
        yield pa.record_batch([*batch.columns, pa.array(packets, pa.int64())], names=["doc_id", "text", "packet"])


def _in_packets(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, packet), written once as a table bucketed by packet."""
    spark = documents.sparkSession
    numbered = map_arrow(ids_and_texts(documents), "doc_id long, text string, packet long", _packets)
    name = f"packets_{uuid.uuid4().hex}"
    buckets = min(MAX_BUCKETS, 2 + 4 * size // PACKET_BYTES)
    numbered.write.bucketBy(buckets, "packet").option("compression", "zstd").saveAsTable(name, path=new_folder(spark, "packets"))
    return spark.table(name)


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Cell of each window in one row of the sketch, with the segment in front."""
    return hashes >> _U(64 - CELL_BITS - bits)


def _by_segment(spots: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """Segment and range of each run of sorted numbers with equal leading bits."""
    segments = (spots >> _U(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1], [True]])) if len(spots) else [0]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(segments[low]), int(low), int(high)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SKETCH = "line int, segment long, packet long, cells binary, twice binary"
_SKETCH = pa.schema(
    [("line", pa.int32()), ("segment", pa.int64()), ("packet", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())]
)


def _sketched(bits: int):
    def work(texts: pa.Table) -> pa.Table:
        windows, packet = Windows(texts), texts.column("packet")[0].as_py()
        rows = []
        for line, hashes in enumerate(windows.hashes):
            spots, counts = np.unique(_spots(hashes, bits), return_counts=True)
            for segment, low, high in _by_segment(spots, CELL_BITS):
                cells = (spots[low:high] & _U((1 << CELL_BITS) - 1)).astype(np.uint32)
                gaps = np.diff(cells, prepend=np.uint32(0))
                rows.append((line, segment, packet, pack(gaps), np.packbits(counts[low:high] > 1).tobytes()))
        return _table(rows, _SKETCH)

    return work


def _summed(rows: pa.Table) -> pa.Table:
    """Sum one segment of all sketches; tell each packet which of its cells were reached twice."""
    once, twice = np.zeros(1 << CELL_BITS, bool), np.zeros(1 << CELL_BITS, bool)

    def cells(i: int) -> np.ndarray:
        return np.cumsum(unpack(rows.column("cells")[i].as_py(), np.uint32))

    for i in range(rows.num_rows):
        own = cells(i)
        marks = np.unpackbits(np.frombuffer(rows.column("twice")[i].as_py(), np.uint8), count=len(own)).astype(bool)
        twice[own] |= once[own] | marks
        once[own] = True
    flags = [np.packbits(twice[cells(i)]).tobytes() for i in range(rows.num_rows)]
    return rows.select(["line", "segment", "packet"]).append_column("flags", pa.array(flags, pa.binary()))


EXACT = "segment long, packet long, first binary, second binary, doc binary"
_EXACT = pa.schema([("segment", pa.int64()), ("packet", pa.int64()), *((c, pa.binary()) for c in ("first", "second", "doc"))])


def _estimated(bits: int):
    """Windows of a packet that the sketch takes for repeated, once each, by segment of the exact grouping."""

    def work(texts: pa.Table, flags: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows and flags.num_rows:
            windows, packet = Windows(texts), texts.column("packet")[0].as_py()
            told = {(r["line"], r["segment"]): r["flags"] for r in flags.to_pylist()}
            keep = np.ones(len(windows.at), bool)
            for line, hashes in enumerate(windows.hashes):
                spots = _spots(hashes, bits)
                known, back = np.unique(spots, return_inverse=True)
                own = np.zeros(len(known), bool)
                for segment, low, high in _by_segment(known, CELL_BITS):
                    own[low:high] = np.unpackbits(np.frombuffer(told[line, segment], np.uint8), count=high - low)
                keep &= own[back]
            h1, h2 = (h[keep] for h in windows.hashes)
            order, begins = grouped(h1, h2)
            if len(order):
                least = np.minimum.reduceat(windows.doc[keep][order], begins)
                h1, h2 = h1[order][begins], h2[order][begins]
                for segment, low, high in _by_segment(h1, 64 - bits - FINER_BITS):
                    rows.append((segment, packet, pack(np.diff(h1[low:high], prepend=_U(0))), h2[low:high].tobytes(), pack(least[low:high])))
        return _table(rows, _EXACT)

    return work


def _compared(rows: pa.Table) -> pa.Table:
    """Group one segment by the whole hash; tell each packet which of its windows a smaller document elsewhere holds."""
    first = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in rows.column("first")]
    second = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("second")]
    docs = np.concatenate([unpack(x.as_py(), np.int64) for x in rows.column("doc")])
    h1, h2 = np.concatenate(first), np.concatenate(second)
    order, begins = grouped(h1, h2)
    least = np.minimum.reduceat(docs[order], begins)
    smaller = np.zeros(len(docs), bool)
    smaller[order] = docs[order] > np.repeat(least, np.diff(np.append(begins, len(order))))
    cuts = np.cumsum([0, *map(len, first)]).tolist()
    parts = [(h1[a:b][smaller[a:b]], h2[a:b][smaller[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table(
        [rows.column("packet"), pa.array([a.tobytes() for a, _ in parts], pa.binary()), pa.array([b.tobytes() for _, b in parts], pa.binary())],
        names=["packet", "first", "second"],
    )


def _held(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Which pairs of a occur among the pairs of b."""
    if not len(b1) or not len(a1):
        return np.zeros(len(a1), bool)
    order = np.lexsort((b2, b1))
    b1, b2 = b1[order], b2[order]
    low = np.minimum(np.searchsorted(b1, a1), len(b1) - 1)
    found = (b1[low] == a1) & (b2[low] == a2)
    # Two pairs that agree in the first half: compare those in turn.
    if (b1[1:] == b1[:-1]).any():
        known = set(zip(b1.tolist(), b2.tolist(), strict=True))
        for i in np.flatnonzero((b1[low] == a1) & ~found):
            found[i] = (int(a1[i]), int(a2[i])) in known
    return found


def _joined(windows: Windows, keep: np.ndarray) -> Iterator[str]:
    """For each text its kept words, one blank between them."""
    n = len(windows.of) - 1
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(windows.of, windows.of[low] + JOINED, "right")) - 1)
        first, last = int(windows.of[low]), int(windows.of[high])
        stays = np.flatnonzero(keep[first:last]) + first
        starts, sizes = windows.starts[stays], windows.ends[stays] - windows.starts[stays] + 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        made = windows.raw[np.minimum(places, max(len(windows.raw) - 1, 0))] if len(places) else np.zeros(0, np.uint8)
        made[total[1:] - 1] = 0x20
        data, cuts = made.tobytes(), total[np.searchsorted(stays, windows.of[low : high + 1])].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield data[a : max(a, b - 1)].decode()
        low = high


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _removed(texts: pa.Table, told: pa.Table) -> pa.Table:
    if not texts.num_rows:
        return _table([], _KEPT)
    windows = Windows(texts)
    h1, h2 = windows.hashes
    covered = np.zeros(len(windows.starts) + 1, np.int64)
    order, begins = grouped(h1, h2)
    if len(order):
        sizes = np.diff(np.append(begins, len(order)))
        least = np.minimum.reduceat(windows.doc[order], begins)
        first, second = (np.frombuffer(b"".join(told.column(c).to_pylist()), np.uint64) for c in ("first", "second"))
        elsewhere = _held(h1[order][begins], h2[order][begins], first, second)
        gone = windows.at[order[np.repeat(elsewhere, sizes) | (windows.doc[order] > np.repeat(least, sizes))]]
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + WINDOW, -1)
    keep = np.cumsum(covered)[:-1] == 0
    sums = np.concatenate([[0], np.cumsum(~keep)])
    return pa.table(
        [texts.column("doc_id").cast(pa.int64()), pa.array(np.diff(windows.of), pa.int64()),
         pa.array(sums[windows.of[1:]] - sums[windows.of[:-1]], pa.int64()), pa.array(list(_joined(windows, keep)), pa.string())],
        schema=_KEPT,
    )


def without_repeats(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed, kept_text.

    A word goes if a window that covers it also starts in a document with a smaller doc_id; a window that repeats in its
    own document only, or in rows with the same id, stays. Null and empty texts have no words, texts of fewer than
    thirteen words no window. A row without id keeps all its words, and nothing goes because of it. Other columns are
    ignored. An empty table gives no rows.

    The packets stay in the session's catalog under a new name, and their files in the shared folder.
    """
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first().n or 0
    bits = max(0, (size // WINDOW_BYTES // SEGMENT_WINDOWS).bit_length())
    packets = _in_packets(documents, size)
    sketches = packets.groupBy("packet").applyInArrow(tidied(_sketched(bits)), SKETCH)
    flags = stage(
        sketches.groupBy("line", "segment").applyInArrow(tidied(_summed), "line int, segment long, packet long, flags binary"), "flags"
    )
    estimated = packets.groupBy("packet").cogroup(flags.groupBy("packet")).applyInArrow(tidied(_estimated(bits)), EXACT)
    told = stage(estimated.groupBy("segment").applyInArrow(tidied(_compared), "packet long, first binary, second binary"), "repeated")
    return packets.groupBy("packet").cogroup(told.groupBy("packet")).applyInArrow(tidied(_removed), KEPT)
