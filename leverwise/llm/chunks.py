"""Tokenizing whole batches through their distinct chunks.

A chunk is a run of white space with the characters behind it. Texts are cut before ASCII white space that follows
anything but white space, and between an ASCII letter and an ASCII punctuation mark (but for those that occur in
contractions and special tokens). The pre-tokenizers of both vocabularies in use always have a boundary there, and what
they do behind it does not depend on what stands before it: so the ids of a text are the ids of its chunks in a row.
Each distinct chunk of a slice goes through the tokenizer once; a bounded cache keeps short ones for the next slices.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from leverwise.llm.common import kept
from leverwise.llm.text import WHITE, slices, view

# Text whose tokens a worker holds at once (more only for a single longer text).
SLICE = 10 * 1024 * 1024
# Memory of the chunks kept from one slice to the next (in each of two generations), what an entry takes besides its
# chunk and ids, and the longest chunk kept.
CACHED = 64 * 1024 * 1024
ENTRY = 180
CACHED_BYTES = 48
# Chunks given to the tokenizer at once.
GROUP = 10_000

_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
# Lead bytes of the characters among which Unicode has more white space; no cut is made behind one of these.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file among the installed public tokenizers; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file; parallelism is Spark's."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(tokenizer_path(path))


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks, from 0 on, and for each text the number of its first chunk (n + 1)."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        space = _SPACE[raw]
        blocked = space[:-1].copy()
        odd = _MAYBE_SPACE[raw]
        blocked[1:] |= odd[:-2]
        blocked[2:] |= odd[:-3]
        cut[1:-1] = (space[1:] & ~blocked) | (_LETTER[raw[:-1]] & _MARK[raw[1:]])
    cut[offsets] = True
    cut[0] = True
    ends = np.flatnonzero(cut)
    return ends, np.searchsorted(ends, offsets)


class Distinct:
    """The chunks of some texts: the distinct ones, the number of each in order, and each text's first chunk."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.ends, self.of = bounds(raw, offsets)
        kind, width = (pa.binary(), np.int32) if len(raw) < 2**31 else (pa.large_binary(), np.int64)
        found = type(pa.array([], kind)).from_buffers(
            kind, len(self.ends) - 1, [None, pa.py_buffer(self.ends.astype(width)), pa.py_buffer(raw)]
        ).dictionary_encode()
        self.chunks: list[bytes] = found.dictionary.to_pylist()
        self.index = found.indices.to_numpy()


def distinct_chunks(
    texts: pa.Array, change: Callable[[np.ndarray], np.ndarray] = lambda raw: raw
) -> Iterator[tuple[int, int, Distinct]]:
    """Slice by slice: first and last row, chunks of the changed bytes (as many as before)."""
    raw, offsets = view(texts)
    for low, high in slices(offsets, SLICE):
        part = change(raw[offsets[low] : offsets[high]])
        yield low, high, Distinct(part, offsets[low : high + 1] - offsets[low])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Ids of whole texts as the tokenizers library gives them without added start or end tokens."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        # Where the file's normalizer lower-cases, capitals are folded first: fewer chunks are distinct.
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def _fold(self, raw: np.ndarray) -> np.ndarray:
        """Small letters for A-Z, unless that could make a special token out of other text."""
        if not self.folds or not len(raw):
            return raw
        data = raw.tobytes()
        if any(s[:2] in data for s in self.special):
            return raw
        return _LOWER[raw]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        known, older = self.known, self.older
        out = [known.get(c) for c in chunks]
        missing = []
        for i, found in enumerate(out):
            if found is None:
                held = older.get(chunks[i])
                if held is None:
                    missing.append(i)
                else:
                    out[i] = known[chunks[i]] = held
                    self.size += ENTRY + len(chunks[i]) + len(held)
        for low in range(0, len(missing), GROUP):
            part = missing[low : low + GROUP]
            texts = [chunks[i].decode("utf-8", "replace") for i in part]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            data = np.fromiter(chain.from_iterable(ids), np.uint32).tobytes()
            at = 0
            for i, own in zip(part, ids, strict=True):
                out[i] = data[at : at + 4 * len(own)]
                at += 4 * len(own)
                if len(chunks[i]) <= CACHED_BYTES:
                    known[chunks[i]] = out[i]
                    self.size += ENTRY + len(chunks[i]) + len(out[i])
            self._bound()
            known = self.known
        self._bound()
        return out

    def _bound(self) -> None:
        """A full generation becomes the older one; what is used again returns."""
        if self.size > CACHED:
            self.older, self.known, self.size = self.known, {}, 0

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slice by slice: first and last row, all ids in a row (uint32), and each text's first id (n + 1)."""
        for low, high, found in distinct_chunks(texts, self._fold):
            own = self._ids(found.chunks)
            flat = np.frombuffer(b"".join(own), np.uint32)
            sizes = np.array([len(x) // 4 for x in own], np.int64)
            begins = np.cumsum(sizes) - sizes
            each = sizes[found.index]
            total = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(begins[found.index] - total[:-1], each) + np.arange(total[-1])]
            yield low, high, ids, total[found.of]


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept in the worker: later tasks find the chunks of earlier ones."""
    return kept(f"encoder {path}", lambda: Encoder(path))
