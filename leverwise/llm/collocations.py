"""Phrases whose words stand together more often than their parts suggest (operator 11).

Words are counted first. A phrase of a hundred occurrences has only parts that occur as often, so of the pairs only those
of frequent words are counted, and longer phrases only where every pair of neighbours is frequent. What is frequent
reaches the tasks as a bit array of bounded size that may let others through but drops nothing; every count is exact.

Each slice of documents turns its sorted n-grams into count transducers, one for each language and range of prefixes
(two words for pairs, three for longer phrases, so that one hot word or pair does not fill a range). For each range the
transducers of all slices are united and the counts added up. What stays is kept as one transducer for each range; the
parts of the candidates are sent to the range of their prefix and read off there.

Words are 64-bit hashes meanwhile. All words of the corpus are checked for equal hashes; if two share one, the counting
starts again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leverwise.llm.common import map_arrow, stage, tidied
from leverwise.llm.substrings import grouped
from leverwise.llm.text import constants, mix, run_hashes, view, word_bounds
from leverwise.llm.transducer import Builder, Transducer, built, summed

LONGEST = 5
LEAST = 100
FIRST_OF_EACH = 2000
# Text whose n-grams are sorted at once, and words that one range of prefixes is made for.
SLICE = 16 * 1024 * 1024
RANGE_WORDS = 1 << 21
# The bit array: bits for each frequent item, and its largest size (32 MB).
ITEM_BITS = 16
MOST_BITS = 28

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_PREFIX = constants(3, 71)
_CELLS = constants(2, 73)


class _Alphabet:
    word = np.ones(256, bool)


_Alphabet.word[list(BREAKS + BLANKS)] = False


def _language(lang: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


class _Text:
    """Words of some texts in a row: places, hashes, and whether each one's successor stands in the same piece."""

    def __init__(self, texts: pa.Array, salt: int):
        raw, offsets = view(texts)
        self.raw = _LOWER[raw]
        self.starts, self.ends = word_bounds(self.raw, offsets, _Alphabet)
        self.hashes = np.maximum(run_hashes(self.raw, self.starts, self.ends, constants(256, 1000 + salt)), _U(1))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.raw])])[self.starts]
        text = np.searchsorted(offsets, self.starts, "right")
        self.joined = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Language and texts, of one language and about SLICE bytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def by_language() -> Iterator[tuple[str, pa.Array]]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column("lang")).to_pylist():
            yield lang, table.filter(pc.equal(table.column("lang"), lang)).column("text").combine_chunks()

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield from by_language()
            held, size = [], 0
    if held:
        yield from by_language()


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return documents.select(lang.alias("lang"), F.col("text").cast("string"))


def _word_counts(salt: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches):
            found = _Text(texts, salt)
            # Words of a slice are the same if two independent hashes are; only then the first hash stands for a word.
            second = run_hashes(found.raw, found.starts, found.ends, constants(256, 2000 + salt))
            order, begins = grouped(found.hashes, second)
            first, n = order[begins], np.diff(np.append(begins, len(order)))
            hashes = found.hashes[first]
            data = found.raw.tobytes()
            words = [data[a:b].decode() for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
            yield pa.record_batch(
                [pa.repeat(pa.scalar(lang), len(words)), pa.array(words, pa.string()), pa.array(hashes.view(np.int64)), pa.array(n)],
                names=["lang", "word", "hash", "n"],
            )

    return work


def _counted_words(documents: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, hash, n) of all words, and the salt under which no two words share a hash."""
    for salt in range(100):
        rows = map_arrow(_texts(documents), "lang string, word string, hash long, n long", _word_counts(salt))
        words = stage(rows.groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n")), "words")
        if words.groupBy("hash").agg((F.min("word") != F.max("word")).alias("two")).where("two").isEmpty():
            return words, salt
    raise RuntimeError("every choice of hashes had words in common")


def _keys(lang: str, rows: np.ndarray) -> np.ndarray:
    """One number for each row of words of a language."""
    key = np.full(len(rows), _language(lang), np.uint64)
    for column in rows.T:
        key = mix(key * _U(3) + column)
    return key


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(keys + c) >> _U(64 - bits)).astype(np.int64) for c in _CELLS]


def _marks(bits: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            keys = [_keys(lang, np.array([row], np.int64).view(np.uint64)) for lang, row in zip(langs, batch.column("ngram").to_pylist(), strict=True)]
            cells = np.concatenate(_cells(np.concatenate(keys), bits)) if keys else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(cells >> 5), pa.array(np.int64(1) << (cells & 31))], names=["place", "mark"])

    return work


def _bit_array(items: DataFrame) -> tuple[Broadcast, int]:
    """Marks of the frequent items (lang, ngram) in a bit array of at most 2^MOST_BITS bits, sent to every executor."""
    bits = min(MOST_BITS, max(10, (items.count() * ITEM_BITS).bit_length()))
    marks = map_arrow(items.select("lang", "ngram"), "place long, mark long", _marks(bits))
    rows = marks.groupBy("place").agg(F.bit_or("mark").alias("mark")).toArrow()
    held = np.zeros(1 << max(0, bits - 5), np.uint32)
    held[rows.column("place").to_numpy()] = rows.column("mark").to_numpy().astype(np.uint32)
    return items.sparkSession.sparkContext.broadcast(held), bits


def _marked(held: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for cells in _cells(keys, bits):
        found &= (held[cells >> 5] >> (cells & 31).astype(np.uint32)) & 1 == 1
    return found


def _range_of(rows: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The range of each n-gram, by its first words: those of pairs before those of longer phrases."""
    key = np.zeros(len(rows), np.uint64)
    for column, factor in zip(rows.T[: min(length, 3)], _PREFIX, strict=False):
        key = mix(key + column * factor)
    return (key >> _U(64 - bits)).astype(np.int64) + (0 if length == 2 else 1 << bits)


def _rows_of(found: _Text, links: np.ndarray, least: int, longest: int) -> np.ndarray:
    """At each place the words from there on, as far as neighbours are linked, if these are enough (0: no word)."""
    n = len(found.hashes)
    stops = np.append(np.where(links, n, np.arange(n - 1)), n - 1) if n else np.zeros(0, np.int64)
    until = np.minimum.accumulate(stops[::-1])[::-1]
    size = np.minimum(until - np.arange(n) + 1, longest)
    at = np.flatnonzero(size >= least)
    padded = np.append(found.hashes, np.zeros(longest, np.uint64))
    rows = padded[at[:, None] + np.arange(longest)]
    rows[np.arange(longest) >= size[at][:, None]] = 0
    return rows


PARTS = "array<binary>"


def _built(shared: Broadcast, filter_bits: int, salt: int, least: int, longest: int, bits: int) -> Callable:
    """Transducers of each slice, by language and range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches):
            found, held = _Text(texts, salt), shared.value
            if longest == 2:
                known = _marked(held, filter_bits, _keys(lang, found.hashes[:, None]))
                links = found.joined & known[1:] & known[:-1]
            else:
                links = found.joined.copy()
                pairs = np.stack([found.hashes[:-1], found.hashes[1:]], axis=1)[links]
                links[links] = _marked(held, filter_bits, _keys(lang, pairs))
            rows = _rows_of(found, links, least, longest)
            rows, counts = summed([(rows, np.ones(len(rows), np.int64))])
            ranges = _range_of(rows, longest, bits)
            order = np.argsort(ranges, kind="stable")
            rows, counts, ranges = rows[order], counts[order], ranges[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(rows) else [0]
            numbers, made = [], []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                numbers.append(int(ranges[low]))
                made.append(built(rows[low:high], counts[low:high]).to_parts())
            yield pa.record_batch(
                [pa.repeat(pa.scalar(lang), len(made)), pa.array(numbers, pa.int64()), pa.array(made, pa.list_(pa.binary()))],
                names=["lang", "range", "parts"],
            )

    return work


def _united(least: int) -> Callable:
    """One transducer for a range, of the n-grams that are frequent over all slices."""

    def work(rows: pa.Table) -> pa.Table:
        by_length: list[list] = [[] for _ in range(LONGEST)]
        for parts in rows.column("parts"):
            for length, found in enumerate(Transducer.from_parts(parts.as_py()).paths()):
                by_length[length].append(found)
        listed = []
        for length, tables in enumerate(by_length, 1):
            if tables and length >= least:
                ngrams, counts = summed(tables)
                often = counts >= LEAST
                listed += zip(ngrams[often].tolist(), counts[often].tolist(), strict=True)
        build = Builder()
        for ngram, count in sorted(listed):
            build.put(ngram, count)
        made = [build.finish().to_parts()] if listed else []
        first = rows.slice(0, len(made))
        return pa.table([first.column("lang"), first.column("range"), pa.array(made, pa.list_(pa.binary()))], names=["lang", "range", "parts"])

    return work


def _listed(least: int) -> Callable:
    """The n-grams of transducers with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, parts in zip(batch.column("lang").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                for length, (rows, counts) in enumerate(Transducer.from_parts(parts).paths(), 1):
                    if length >= least:
                        yield pa.record_batch(
                            [pa.repeat(pa.scalar(lang), len(rows)), pa.array(rows.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(counts)],
                            names=["lang", "ngram", "n"],
                        )

    return work


def _routed(bits: int) -> Callable:
    """Add to each n-gram of two words or more the range that knows it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("ngram").to_pylist()
            ranges = [int(_range_of(np.array([row], np.int64).view(np.uint64), len(row), bits)[0]) for row in listed]
            yield pa.record_batch([*batch.select(["lang", "ngram"]).columns, pa.array(ranges, pa.int64())], names=["lang", "ngram", "range"])

    return work


def _looked_up(asked: pa.Table, known: pa.Table) -> pa.Table:
    found = Transducer.from_parts(known.column("parts")[0].as_py()) if known.num_rows and asked.num_rows else None
    counts = [found.find(np.array(row, np.int64).view(np.uint64).tolist()) if found else 0 for row in asked.column("ngram").to_pylist()]
    return pa.table([asked.column("lang"), asked.column("ngram"), pa.array(counts, pa.int64())], names=["lang", "ngram", "n"])


NGRAMS = "lang string, ngram array<bigint>, n long"
RANGES = f"lang string, range long, parts {PARTS}"


def _phrases(documents: DataFrame, words: DataFrame, salt: int) -> tuple[DataFrame, int]:
    """(lang, range, parts): the transducers of all frequent phrases of two words or more, and the bits of a range."""
    total = words.agg(F.sum("n").alias("n")).first().n or 0
    bits = max(1, (total // RANGE_WORDS).bit_length())

    def united(items: DataFrame, least: int, longest: int, name: str) -> DataFrame:
        shared, filter_bits = _bit_array(items)
        slices = map_arrow(_texts(documents), RANGES, _built(shared, filter_bits, salt, least, longest, bits))
        return stage(slices.groupBy("lang", "range").applyInArrow(tidied(_united(least)), RANGES), name)

    frequent = words.where(F.col("n") >= LEAST).select("lang", F.array("hash").alias("ngram"))
    pairs = united(frequent, 2, 2, "pairs")
    longer = united(map_arrow(pairs, NGRAMS, _listed(2)), 3, LONGEST, "longer")
    return pairs.union(longer), bits


def collocations(documents: DataFrame, first: int = FIRST_OF_EACH) -> DataFrame:
    """Per language the ``first`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase has two to five words of one piece and occurs ``a`` times, at least LEAST; ``l`` and ``r`` count the two
    parts of its weakest cut, ``n`` the words of the language. A phrase is left out if a phrase one or more words longer
    that holds it occurs as often. Null language is ``und``; null, empty and blank texts have no words. Rows count as
    often as they are there, with or without id; other columns are ignored. An empty table gives no rows.
    """
    words, salt = _counted_words(documents)
    transducers, bits = _phrases(documents, words, salt)
    sizes = F.size("ngram")
    # Pairs stand in the transducers of pairs only; those of longer phrases list from three words on.
    candidates = stage(
        map_arrow(transducers.where(F.col("range") < (1 << bits)), NGRAMS, _listed(2)).union(
            map_arrow(transducers.where(F.col("range") >= (1 << bits)), NGRAMS, _listed(3))
        ), "candidates"
    )
    longer = candidates.where(sizes > 2)
    inner = longer.select("lang", "n", F.explode(F.array(F.slice("ngram", F.lit(1), sizes - 1), F.slice("ngram", F.lit(2), sizes - 1))).alias("ngram"))
    held = inner.groupBy("lang", "ngram").agg(F.max("n").alias("as_part"))
    kept = candidates.join(held, ["lang", "ngram"], "left").where("as_part is null or as_part < n").drop("as_part")
    cuts = stage(
        kept.withColumn("k", F.explode(F.sequence(F.lit(1), sizes - 1)))
        .withColumn("left", F.slice("ngram", F.lit(1), F.col("k")))
        .withColumn("right", F.slice("ngram", F.col("k") + 1, sizes - F.col("k"))), "cuts"
    )
    asked = cuts.select("lang", F.col("left").alias("ngram")).union(cuts.select("lang", "right")).distinct().where(sizes > 1)
    routed = map_arrow(asked, "lang string, ngram array<bigint>, range long", _routed(bits))
    answers = routed.groupBy("lang", "range").cogroup(transducers.groupBy("lang", "range")).applyInArrow(tidied(_looked_up), NGRAMS)
    often = words.where(F.col("n") >= LEAST)
    parts = stage(answers.union(often.select("lang", F.array("hash").alias("ngram"), "n")), "parts")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counted = (
        cuts.join(parts.select("lang", F.col("ngram").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("ngram").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .join(total, "lang")
    )
    score = F.expr(
        "(cast(1000 as decimal(4, 0)) * cast(n as decimal(19, 0)) * cast(total as decimal(19, 0)))"
        " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    )
    weakest = counted.groupBy("lang", "ngram", F.col("n").alias("a"), F.col("total").alias("n")).agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    spelled = (
        weakest.select("lang", "ngram", F.posexplode("ngram").alias("place", "hash"))
        .join(often.select("lang", "hash", "word"), ["lang", "hash"])
        .groupBy("lang", "ngram").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
        .select("lang", "ngram", F.array_join(F.col("words.word"), " ").alias("phrase"))
    )
    rows = weakest.join(spelled, ["lang", "ngram"]).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
