"""Words and hashes of whole Arrow batches of text with numpy; no loop over words.

A batch is seen as one run of bytes with the offsets of its texts. Words are maximal runs of word bytes inside one
text; bytes from 0x80 on always belong to words, so UTF-8 needs no decoding. Work goes in pieces of bounded size:
temporary arrays stay small for a text of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that are hashed at once (more only for a single word longer than that).
PIECE = 512 * 1024
# Bytes of text whose words are held at once (more only for a single longer text).
SLICE = 4 * 1024 * 1024

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(_BASE) + _U(seed)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Alphabet:
    """Which bytes make words, and the value of each byte in hashes (A-Z count as a-z)."""

    def __init__(self, separators: bytes):
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        self.value = constants(256, 7)
        self.value[65:91] = self.value[97:123]


WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SPACED = Alphabet(WHITE)
ALPHANUMERIC = Alphabet(NOT_ALPHANUMERIC)


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a column of texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or one longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def word_bounds(raw: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    inside = alphabet.word[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hash of each run raw[start:end]; runs come in order and do not overlap.

    Prefix sums of byte values times powers of an odd base give every run's polynomial by one subtraction.
    """
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        begin = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        stop = int(ends[high - 1])
        n = stop - begin
        if n <= PIECE:
            if run_hashes.powers is None:
                run_hashes.powers = _powers(_BASE, PIECE), _powers(_BASE_INVERSE, PIECE)
            up, down = run_hashes.powers
        else:
            up, down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[raw[begin:stop]] * up[:n], out=sums[1:])
        s, e = starts[low:high] - begin, ends[low:high] - begin
        out[low:high] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        low = high
    return out


run_hashes.powers = None


class Words:
    """The words of some texts: hashes, and for each text the range of its words (``of[i]:of[i + 1]``)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        self.starts, self.ends = word_bounds(raw, offsets, alphabet)
        self.hashes = run_hashes(raw, self.starts, self.ends, alphabet.value)
        self.of = np.searchsorted(self.starts, offsets)


def words_of(column: pa.Array, alphabet: Alphabet) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """Slice by slice: first and last row, bytes, offsets and words."""
    raw, offsets = view(column)
    for low, high in slices(offsets):
        part, own = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        yield low, high, part, own, Words(part, own, alphabet)


def shingle_sets(words: Words, size: int, factors: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words (of all its words if fewer)."""
    n = len(words.hashes)
    spread = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        spread += words.hashes[j : j + len(spread)] * factors[j]
    spread = mix(spread + _U(size))
    found = []
    for low, high in zip(words.of[:-1], words.of[1:], strict=True):
        if high - low >= size:
            found.append(np.unique(spread[low : high - size + 1]))
        elif high > low:
            own = words.hashes[low:high] * factors[: high - low]
            found.append(mix(own.sum(dtype=np.uint64, keepdims=True) + _U(high - low)))
        else:
            found.append(spread[:0])
    return found
