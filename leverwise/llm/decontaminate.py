"""Benchmark passages in training documents by an FM-index of each shard (operator 5).

The windows of the benchmark (ten consecutive words of an item, or all words of a shorter one) are the phrases. They are
written to the shared folder in blocks of bounded size. A task takes its documents shard by shard, a shard being a few
megabytes of whole texts, and for each block of phrases builds the FM-index of the shard over the block's words, searches
all phrases backwards, locates their occurrences by sampled places and merges the spans. Words that no phrase holds end
a run, and runs shorter than every phrase are left out of the index: no phrase can lie there. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.llm.common import ids_and_texts, map_arrow, new_folder
from leverwise.llm.fm_index import FMIndex
from leverwise.llm.text import ALPHANUMERIC, Words, words_of

WINDOW = 10
# Phrases in a block (a few MB).
BLOCK = 100_000
# What takes the place of removed passages; a number follows if a benchmark item holds the word.
MARK = "removed"


def windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, words): the windows of every item as hashes. Items without a word have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, _, words in words_of(batch.column(1), ALPHANUMERIC):
                hashes = words.hashes.view(np.int64)
                for i in range(high - low):
                    own = hashes[words.of[i] : words.of[i + 1]]
                    size = min(WINDOW, len(own))
                    for begin in range(0, len(own) - size + 1 if size else 0, BLOCK):
                        part = own[begin : begin + BLOCK + size - 1]
                        rows = np.lib.stride_tricks.sliding_window_view(part, size)
                        yield pa.record_batch(
                            [pa.repeat(batch.column(0)[low + i], len(rows)),
                             pa.ListArray.from_arrays(np.arange(0, rows.size + 1, size, np.int32), rows.reshape(-1))],
                            names=["item_id", "words"],
                        )

    own = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return map_arrow(own, "item_id string, words array<long>", work).distinct()


def write_blocks(benchmark: DataFrame) -> list[str]:
    """Paths of the blocks of phrases; the driver holds one block at a time."""
    folder = new_folder(benchmark.sparkSession, "phrases")
    paths: list[str] = []
    items: list[str | None] = []
    phrases: list[list[int]] = []

    def write() -> None:
        table = np.zeros((len(phrases), WINDOW), np.int64)
        lengths = np.array([len(p) for p in phrases])
        for row, phrase in enumerate(phrases):
            table[row, WINDOW - len(phrase) :] = phrase
        data = io.BytesIO()
        np.savez(data, table=table, lengths=lengths, named=np.array([i is not None for i in items]),
                 items=np.array([i or "" for i in items]))
        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        with place.open_output_stream(f"{path}/block-{len(paths):06d}", compression=None) as out:
            out.write(data.getvalue())
        paths.append(f"{folder}/block-{len(paths):06d}")
        items.clear()
        phrases.clear()

    for row in windows(benchmark).toLocalIterator():
        items.append(row.item_id)
        phrases.append(row.words)
        if len(phrases) == BLOCK:
            write()
    if phrases:
        write()
    return paths


class Phrases:
    """One block: its words, its distinct phrases in symbols, and the items of each phrase."""

    def __init__(self, path: str):
        place, name = fs.FileSystem.from_uri(path)
        with place.open_input_file(name) as stream:
            held = np.load(io.BytesIO(stream.read()), allow_pickle=False)
            table, lengths, named, items = held["table"], held["lengths"], held["named"], held["items"]
        used = np.arange(WINDOW)[None, :] >= WINDOW - lengths[:, None]
        self.words = np.unique(table[used].view(np.uint64))
        symbols = np.where(used, np.searchsorted(self.words, table.view(np.uint64)) + 1, 0)
        self.phrases, which = np.unique(symbols, axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1)
        self.shortest = int(self.lengths.min())
        order = np.argsort(which[named], kind="stable")
        self.items = items[named][order]
        self.first_item = np.searchsorted(which[named][order], np.arange(len(self.phrases) + 1))
        bits = max(16, int(4 * len(self.words)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.words >> self.shift] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 if no phrase has it."""
        out = np.zeros(len(hashes), np.int64)
        likely = np.flatnonzero(self.maybe[hashes >> self.shift])
        at = np.minimum(np.searchsorted(self.words, hashes[likely]), len(self.words) - 1)
        same = self.words[at] == hashes[likely]
        out[likely[same]] = at[same] + 1
        return out


@lru_cache(maxsize=1)
def _block(path: str) -> Phrases:
    return Phrases(path)


def occurrences(words: Words, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, number of the first word) of all occurrences of the block's phrases inside one text."""
    none = np.zeros(0, np.int64)
    symbols = block.symbols(words.hashes)
    known = symbols > 0
    first = known.copy()
    first[1:] &= ~known[:-1]
    heads = words.of[:-1]
    heads = heads[heads < len(known)]
    first[heads] = known[heads]
    begins = np.flatnonzero(first)
    stops = np.append(np.flatnonzero(~known), len(known))
    ends = np.minimum(stops[np.searchsorted(stops, begins)], words.of[np.searchsorted(words.of, begins, "right")])
    long = ends - begins >= block.shortest
    begins, sizes = begins[long], (ends - begins)[long]
    if not len(begins):
        return none, none
    offsets = np.cumsum(sizes + 1) - sizes - 1
    place = np.repeat(begins - offsets, sizes + 1) + np.arange(int((sizes + 1).sum()))
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[offsets + sizes] = 0
    index = FMIndex(text, len(block.words))
    low, high = index.search(block.phrases, block.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(low)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return phrase, place[index.locate(rows)]


@dataclass
class Found:
    """What one text holds."""

    n_words: int
    n_hit: int
    items: set
    spans: list[tuple[int, int]]


def find(column: pa.Array, paths: list[str]) -> Iterator[Found]:
    """For each text of a batch its words, hit words, items, and merged spans in bytes of the text."""
    for low, high, _, offsets, words in words_of(column, ALPHANUMERIC):
        change = np.zeros(len(words.hashes) + 1, np.int64)
        items: dict[int, set] = {}
        for path in paths:
            block = _block(path)
            phrase, word = occurrences(words, block)
            np.add.at(change, word, 1)
            np.add.at(change, word + block.lengths[phrase], -1)
            row = np.searchsorted(words.of, word, "right") - 1
            for r, p in np.unique(np.stack([row, phrase], axis=1), axis=0).tolist():
                own = block.items[block.first_item[p] : block.first_item[p + 1]]
                items.setdefault(r, set()).update(own.tolist())
        hit = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        for r in range(high - low):
            a, b = int(words.of[r]), int(words.of[r + 1])
            n = int(total[b] - total[a])
            spans = []
            if n:
                edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
                    spans.append((int(words.starts[a + s] - offsets[r]), int(words.ends[a + e - 1] - offsets[r])))
            yield Found(b - a, n, items.get(r, set()), spans)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the merged passages as byte ranges. A null or empty text has no words. An item without id marks words
    but is not listed; items that repeat an id count as one; an empty benchmark finds nothing. Other columns are ignored.
    """
    paths = write_blocks(benchmark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(find(batch.column(1), paths))
            names = [",".join(sorted(f.items)) for f in found]
            yield pa.record_batch(
                [batch.column(0), pa.array([f.n_words for f in found], pa.int64()),
                 pa.array([f.n_hit for f in found], pa.int64()), pa.array([len(f.items) for f in found], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()),
                 pa.array([f.n_hit > 0 for f in found], pa.bool_()),
                 pa.array([[x for span in f.spans for x in span] for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<long>"
    )
    return map_arrow(ids_and_texts(documents), schema, work)


def remove_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with every benchmark passage replaced by a mark; all other columns and clean texts unchanged.

    The mark is a word that no item holds, so no window can go across it. A document of nothing but passages goes.
    """
    paths = write_blocks(benchmark)
    held = pa.array([f"{MARK}{n or ''}" for n in range(1000)])
    (*_, marks), = words_of(held, ALPHANUMERIC)

    def mark() -> str:
        free = np.ones(len(held), bool)
        for path in paths:
            free &= _block(path).symbols(marks.hashes) == 0
        return held[int(np.flatnonzero(free)[0])].as_py()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = mark().encode()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column, texts, stays = batch.column(at), [], []
            for row, found in enumerate(find(column, paths)):
                stays.append(found.n_hit < max(found.n_words, 1))
                if not found.spans:
                    texts.append(column[row].as_py())
                    continue
                raw, parts, done = column[row].as_py().encode(), [], 0
                for begin, end in found.spans:
                    parts += [raw[done:begin], word]
                    done = end
                texts.append(b"".join([*parts, raw[done:]]).decode())
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type)).filter(pa.array(stays))

    return map_arrow(documents, documents.schema, work)
