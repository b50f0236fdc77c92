"""Acyclic automata that map n-grams to counts.

Every arc carries a word and the count of the n-gram that the path up to it spells. N-grams come in order; a state is
closed as soon as no further n-gram can reach it, and looked up among the states that exist already, so that equal ones
are kept once. ``Builder`` does this n-gram by n-gram, ``built`` for a whole sorted table, where all arcs of a state stand
in a row and only states are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from leverwise.llm.packed import pack, unpack


class Builder:
    """Takes n-grams (sequences of numbers) in ascending order, a prefix before what extends it."""

    def __init__(self) -> None:
        self.states: list[tuple] = [()]
        self.known: dict[tuple, int] = {(): 0}
        self.last: Sequence[int] = ()
        # The arcs of each state along the last n-gram: [label, count, number of the next state].
        self.open: list[list[list[int]]] = [[]]

    def _state(self, arcs: list[list[int]]) -> int:
        made = tuple(map(tuple, arcs))
        number = self.known.setdefault(made, len(self.states))
        if number == len(self.states):
            self.states.append(made)
        return number

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            number = self._state(self.open.pop())
            self.open[-1][-1][2] = number

    def _reach(self, ngram: Sequence[int]) -> None:
        shared = 0
        for a, b in zip(self.last, ngram, strict=False):
            if a != b:
                break
            shared += 1
        self._close(shared)
        for label in ngram[shared:]:
            self.open[-1].append([label, 0, 0])
            self.open.append([])
        self.last = ngram

    def add(self, ngram: Sequence[int], count: int) -> None:
        """Count the n-gram and all its prefixes."""
        self._reach(ngram)
        for arcs in self.open[: len(ngram)]:
            arcs[-1][1] += count

    def put(self, ngram: Sequence[int], count: int) -> None:
        """Set the count of this n-gram alone."""
        self._reach(ngram)
        self.open[len(ngram) - 1][-1][1] = count

    def finish(self) -> Transducer:
        self._close(0)
        root = self._state(self.open[0])
        sizes = np.array([len(arcs) for arcs in self.states], np.int64)
        flat = [arc for arcs in self.states for arc in arcs]
        labels, counts, targets = zip(*flat, strict=True) if flat else ((), (), ())
        return Transducer(
            np.array(labels, np.uint64), np.array(counts, np.int64), np.array(targets, np.int64),
            np.concatenate([[0], np.cumsum(sizes)]), root,
        )


class Transducer:
    """Arcs in arrays; those of state s are ``first[s]:first[s + 1]``, sorted by label."""

    def __init__(self, label: np.ndarray, count: np.ndarray, target: np.ndarray, first: np.ndarray, root: int):
        self.label, self.count, self.target, self.first, self.root = label, count, target, first, root

    def find(self, ngram: Sequence[int]) -> int:
        """The count at the end of the path, 0 if there is none."""
        state, count = self.root, 0
        for label in ngram:
            low, high = int(self.first[state]), int(self.first[state + 1])
            at = low + int(np.searchsorted(self.label[low:high], np.uint64(label)))
            if at == high or int(self.label[at]) != label:
                return 0
            state, count = int(self.target[at]), int(self.count[at])
        return count

    def paths(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: all n-grams (one row each, ascending) and their counts."""
        at = np.arange(self.first[self.root], self.first[self.root + 1])
        rows, out = self.label[at][:, None], []
        while len(at):
            out.append((rows, self.count[at]))
            state = self.target[at]
            many = self.first[state + 1] - self.first[state]
            before = np.repeat(np.arange(len(at)), many)
            begin = np.cumsum(many) - many
            at = self.first[state][before] + np.arange(len(before)) - begin[before]
            rows = np.concatenate([rows[before], self.label[at][:, None]], axis=1)
        return out

    def to_parts(self) -> list[bytes]:
        words, index = np.unique(self.label, return_inverse=True)
        sizes = np.diff(self.first).astype(np.uint32)
        numbers = (index.astype(np.uint32), self.count.view(np.uint64), self.target.astype(np.uint32), sizes)
        return [words.tobytes(), *map(pack, numbers), self.root.to_bytes(8, "little")]

    @classmethod
    def from_parts(cls, parts: Sequence[bytes]) -> Transducer:
        words = np.frombuffer(parts[0], np.uint64)
        index, sizes = unpack(parts[1], np.uint32), unpack(parts[4], np.uint32).astype(np.int64)
        count, target = unpack(parts[2], np.uint64).view(np.int64), unpack(parts[3], np.uint32).astype(np.int64)
        return cls(words[index], count, target, np.concatenate([[0], np.cumsum(sizes)]), int.from_bytes(parts[5], "little"))


def built(rows: np.ndarray, counts: np.ndarray) -> Transducer:
    """The transducer that ``Builder.add`` makes of sorted distinct n-grams (one row each, 0: no word) and their counts."""
    depth = rows.shape[1]
    sums = np.concatenate([[0], np.cumsum(counts)])
    changed = np.zeros(len(rows), bool)
    if len(rows):
        changed[0] = True
    levels = []
    for d in range(depth):
        # Where the first d + 1 words differ from those of the row before; rows without so many words have no arc here.
        changed[1:] |= rows[1:, d] != rows[:-1, d]
        cuts = np.append(np.flatnonzero(changed), len(rows))
        there = rows[cuts[:-1], d] != 0
        levels.append((cuts[:-1][there], rows[cuts[:-1][there], d], (sums[cuts[1:]] - sums[cuts[:-1]])[there]))
    known: dict[bytes, int] = {b"": 0}
    states: list[np.ndarray] = [np.zeros((0, 3), np.uint64)]
    target = np.zeros(len(levels[-1][0]), np.uint64)
    for d in range(depth - 1, -1, -1):
        first, label, count = levels[d]
        arcs = np.stack([label, count.view(np.uint64), target], axis=1) if len(first) else states[0]
        above = levels[d - 1][0] if d else np.zeros(1, np.int64)
        parent = np.searchsorted(above, first, "right") - 1
        target = np.zeros(len(above), np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1], [True]])).tolist() if len(first) else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = arcs[low:high]
            key = part.tobytes()
            number = known.get(key)
            if number is None:
                number = known[key] = len(states)
                states.append(part)
            target[parent[low]] = number
    flat = np.concatenate(states)
    sizes = np.array([len(x) for x in states], np.int64)
    return Transducer(
        flat[:, 0].copy(), flat[:, 1].copy().view(np.int64), flat[:, 2].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), int(target[0])
    )


def summed(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Union of n-grams of one length, ascending, with their counts added up."""
    rows, counts = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    begins = np.flatnonzero(new)
    return rows[begins], np.add.reduceat(counts, begins) if len(begins) else counts
