"""Token counts at every prefix of a text by dynamic programming (operator 10).

A sequence of byte-level BPE tokens is the encoding of its bytes exactly if every two neighbours are: if the encoding
of the two tokens' bytes is these two tokens. So the last token of each prefix is the one token that ends there and
suits the last token of the prefix before it, and the count is one more than there. One pass over a piece of text gives
the counts of all its prefixes. Pieces come from the vocabulary's pre-tokenizer; where a cut changes the pieces (inside
white space, inside a contraction, inside a special token) the prefix's own pieces are counted.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.llm.chunks import CACHED_BYTES, Distinct, distinct_chunks, tokenizer
from leverwise.llm.common import ids_and_texts, kept, map_arrow

FILE = "byte_bpe_50k.json"
LIMIT = 1024
# Memory of each table of partial results that a worker keeps, in each of two generations, and of an entry.
FITS, PIECES, TOTALS = 28 * 1024 * 1024, 8 * 1024 * 1024, 52 * 1024 * 1024
ENTRY = 110
# White space of Unicode.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PART = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_CONTRACTION = ("'re", "'ve", "'ll")


class Recent(dict):
    """A table of bounded memory: when it is full it becomes the older generation, and what is used again returns."""

    def __init__(self, size: int):
        super().__init__()
        self.older: dict = {}
        self.most, self.size = size, 0

    def __missing__(self, key):
        found = self.older.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value, more: int = 0) -> None:
        """Keep a result that takes ``more`` bytes besides its entry."""
        if self.size > self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        self.size += ENTRY + more
        self[key] = value


class PrefixCounter:
    """Counts at every byte prefix, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        for text in self.special:
            vocabulary.pop(text.decode(), None)
        # Tokens by text, numbered from 1, and for each letter of the byte alphabet the lengths of tokens that end in it: long
        # ones first, as they are the likelier ones to fit.
        self.tokens = sorted(vocabulary)
        self.numbers = {token: k for k, token in enumerate(self.tokens, 1)}
        lengths: dict[str, set[int]] = {}
        for token in self.tokens:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {letter: sorted(found, reverse=True) for letter, found in lengths.items()}
        self.find_special = re.compile(b"|".join(map(re.escape, sorted(self.special)))) if self.special else None
        # By the numbers of both tokens in one.
        self.fits = Recent(FITS)
        self.pieces = Recent(PIECES)
        self.totals = Recent(TOTALS)

    def _suits(self, before: int, number: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens (or the one, if nothing stands before)."""
        token = self.tokens[number - 1]
        other = self.tokens[before - 1] if before else ""
        made = [t.value for t in self.tokenizer.model.tokenize(other + token)]
        found = made == ([other, token] if before else [token])
        self.fits.keep(before << 32 | number, found)
        return found

    def piece(self, text: str) -> Sequence[int]:
        """Counts of the prefixes of 1, 2, ... bytes of one piece, given in the byte alphabet of the vocabulary."""
        found = self.pieces[text]
        if found is None:
            found = self._counted(text)
            if len(text) <= CACHED_BYTES:
                self.pieces.keep(text, found, 80 + 6 * len(text))
        return found

    def _counted(self, text: str) -> Sequence[int]:
        counts, last = array("I", [0]), array("I", [0])
        numbers, fits, lengths = self.numbers, self.fits, self.lengths
        for end in range(1, len(text) + 1):
            for size in lengths.get(text[end - 1], ()):
                if size > end:
                    continue
                begin = end - size
                number = numbers.get(text[begin:end])
                if number is not None:
                    pair = last[begin] << 32 | number
                    known = fits[pair]
                    if known or known is None and self._suits(last[begin], number):
                        counts.append(counts[begin] + 1)
                        last.append(number)
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends a prefix of {text[:40]!r}")
        return counts[1:]

    def _split(self, text: str) -> list[str]:
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _add(self, part: str, counts: list[int], total: int) -> tuple[list[int], int]:
        """Counts go on over white space and the run of other characters behind it."""
        begin = len(counts)
        now = total
        for piece in self._split(part):
            own = self.piece(piece)
            if piece in _CONTRACTION:
                counts += (now + 1, now + 2, now + own[-1])
            else:
                counts += own if not now else [now + c for c in own]
            now += own[-1]
        blank = part[: len(part) - len(part.lstrip(_BLANK))]
        if len(blank) > 1:
            whole = self.piece(self._split(blank)[0])
            counts[begin : begin + len(whole)] = [total + c for c in whole]
        return counts, now

    def _cut(self, chunk: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Other text and the special token behind it, from left to right; the last piece has none."""
        done = 0
        for match in self.find_special.finditer(chunk) if self.find_special else ():
            yield chunk[done : match.start()], match[0]
            done = match.end()
        yield chunk[done:], b""

    def _plain(self, text: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes of text without special tokens."""
        counts: list[int] = []
        total = 0
        for part in _PART.findall(text.decode("utf-8", "replace")):
            counts, total = self._add(part, counts, total)
        return counts

    def chunk(self, chunk: bytes) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... bytes of a chunk.

        A prefix that ends inside a special token does not hold it: it counts like other text up to there.
        """
        out, total = [], 0
        for text, special in self._cut(chunk):
            open_end = text + special[:-1]
            own = self._plain(open_end)
            out.append(np.array(own, np.uint32) + np.uint32(total))
            if special:
                total += (own[len(text) - 1] if text else 0) + 1
                out.append(np.array([total], np.uint32))
        return np.concatenate(out)

    def total(self, chunk: bytes) -> int:
        """Tokens of a whole chunk."""
        found = self.totals[chunk]
        if found is None:
            found = 0
            for text, special in self._cut(chunk):
                parts = _PART.findall(text.decode("utf-8", "replace"))
                found += sum(self._counted(piece)[-1] for part in parts for piece in self._split(part)) + bool(special)
            if len(chunk) <= CACHED_BYTES:
                self.totals.keep(chunk, found, len(chunk))
        return found

    def prefixes(self, text: bytes) -> np.ndarray:
        """Counts of the prefixes of 0, 1, 2, ... bytes of a whole text."""
        found = Distinct(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        parts, total = [np.zeros(1, np.uint32)], 0
        for i in found.index.tolist() if text else []:
            parts.append(self.chunk(found.chunks[i]) + np.uint32(total))
            total = int(parts[-1][-1])
        return np.concatenate(parts)


def longest_within(counts: np.ndarray, text: bytes, budget: int) -> int:
    """Bytes of the longest prefix of whole characters with at most ``budget`` tokens."""
    raw = np.append(np.frombuffer(text, np.uint8), 0)
    return int(np.flatnonzero((counts <= budget) & ((raw & 0xC0) != 0x80))[-1])


def _counter(path: str) -> PrefixCounter:
    return kept(f"counter {path}", lambda: PrefixCounter(path))


def _cut(counter: PrefixCounter, found: Distinct, totals: np.ndarray, row: int, budget: int) -> int:
    """As ``longest_within`` for one text of a slice, from the counts of its chunks."""
    low, high = int(found.of[row]), int(found.of[row + 1])
    before = totals[low : high + 1] - totals[low]
    last = bisect_right(before, budget) - 1
    begin = int(found.ends[low + last] - found.ends[low])
    if last == high - low:
        return begin
    chunk = found.chunks[found.index[low + last]]
    counts = np.concatenate([[0], counter.chunk(chunk)]) + before[last]
    return begin + longest_within(counts, chunk, budget)


def token_counts(documents: DataFrame, path: str = FILE, limit: int = LIMIT) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit, fit_bytes.

    ``fit_bytes`` is the length in bytes of the longest prefix (of whole characters) of at most ``limit`` tokens. A null
    or empty text has no bytes and no tokens. Repeated rows and rows without id are counted like others; other columns
    are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for low, high, found in distinct_chunks(batch.column(1)):
                own = np.array([counter.total(c) if c else 0 for c in found.chunks], np.int64)
                totals = np.concatenate([[0], np.cumsum(own[found.index])])
                n = totals[found.of[1:]] - totals[found.of[:-1]]
                size = found.ends[found.of[1:]] - found.ends[found.of[:-1]]
                fit = [
                    _cut(counter, found, totals, row, limit) if n[row] > limit else int(size[row])
                    for row in range(high - low)
                ]
                yield pa.record_batch(
                    [batch.column(0).slice(low, high - low), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(n > limit), pa.array(fit, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"],
                )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"
    return map_arrow(ids_and_texts(documents), schema, work, f"counter {path}")


def prefix_table(documents: DataFrame, path: str = FILE) -> DataFrame:
    """Per row: doc_id and the token counts of all byte prefixes (array, from the empty prefix on).

    Any later question about a truncation or a budget reads this array and encodes nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for row in range(batch.num_rows):
                text = (batch.column(1)[row].as_py() or "").encode()
                counts = counter.prefixes(text).astype(np.int32)
                offsets = pa.array([0, len(counts)], pa.int32())
                yield pa.record_batch(
                    [batch.column(0).slice(row, 1), pa.ListArray.from_arrays(offsets, pa.array(counts))],
                    names=["doc_id", "counts"],
                )

    return map_arrow(ids_and_texts(documents), "doc_id long, counts array<int>", work, f"counter {path}")


def within_budget(table: DataFrame, budget: int) -> DataFrame:
    """Per row of a prefix table: doc_id and the tokens used by the longest byte prefix within the budget."""
    fits = F.filter("counts", lambda c: c <= budget)
    return table.select("doc_id", F.size("counts").alias("prefixes"), F.array_max(fits).alias("used"))
