"""Removed passages against a plain version."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from leverwise.llm import substrings


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    least = {}
    for (doc_id, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12 if doc_id is not None else 0):
            key = tuple(w[i : i + 13])
            least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 12 if doc_id is not None else 0) if least[tuple(w[i : i + 13])] < doc_id for j in range(i, i + 13)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in substrings.without_repeats(df).collect()), key=repr)


def test_passages_and_edges(docs, prose):
    a, b, c = prose(1, 40), prose(2, 13), prose(3, 60)
    rows = [
        (10, f"{prose(11, 30)} {a} {prose(12, 5)}"), (3, a), (7, a.replace(" ", "\t\n ")), (8, a.upper()), (9, f"{b} {b}"), (4, b),
        (5, b.rsplit(" ", 1)[0]), (6, f"x {b[1:]}"), (1, None), (2, ""), (11, " \n\t"), (None, a), (None, c), (12, c), (12, c), (13, c),
        (14, f"{prose(14, 50)} {prose(14, 50)}"), (15, "ü é " * 30), (16, "é ü " * 30), (17, "a\x00b " * 20), (18, f" {a}\xa0"),
        (-4, f"{c} {a}"), (2**62, a), (19, " ".join([*a.split()[:20], *a.split()[:20]])),
    ]
    assert found(docs(*rows)) == brute(rows)


@pytest.mark.parametrize("packet", [1, 200, 10**6])
@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 3), (3, 40)])
def test_random_texts_in_packets_of_any_size(docs, monkeypatch, packet, seed, words):
    monkeypatch.setattr(substrings, "PACKET_BYTES", packet)
    monkeypatch.setattr(substrings, "MAX_BUCKETS", 8)
    monkeypatch.setattr(substrings, "SEGMENT_WINDOWS", 500)
    chosen = random.Random(seed)
    pool = [" ".join(f"w{chosen.randrange(words)}" for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = " ".join(chosen.choice([f"w{chosen.randrange(words)}", chosen.choice(pool)]) for _ in range(chosen.randrange(30)))
        rows.append((chosen.randrange(50), text))
    assert found(docs(*rows)) == brute(rows)


def test_long_texts_and_many_copies(docs, prose, monkeypatch):
    monkeypatch.setattr(substrings, "PACKET_BYTES", 200_000)
    monkeypatch.setattr(substrings, "MAX_BUCKETS", 8)
    long = prose(5, 30_000)
    rows = [(i, long[: 20_000 * (i % 3 + 1)]) for i in range(12)] + [(100 + i, prose(6, 100)) for i in range(300)]
    rows += [(900, "x" * 300_000), (901, "y " * 60_000), (902, "y " * 60_000)]
    assert found(docs(*rows)) == brute(rows)


def test_a_full_sketch_lets_all_through_but_loses_nothing(docs, monkeypatch):
    monkeypatch.setattr(substrings, "CELL_BITS", 2)
    rows = [(i, " ".join(f"w{(i % 20) * 31 + j}" for j in range(40))) for i in range(60)]
    assert found(docs(*rows)) == brute(rows)


def test_no_documents(docs):
    assert found(docs()) == []
    assert found(docs((1, None), (None, None))) == [(1, 0, 0, ""), (None, 0, 0, "")]


def test_packed_numbers_come_back():
    for kind in (np.uint32, np.int64, np.uint64):
        for n in (0, 1, 1000):
            numbers = np.random.default_rng(n).integers(0, 2**31, n).astype(kind)
            assert (substrings.unpack(substrings.pack(numbers), kind) == numbers).all()


def test_equal_halves_of_hashes_are_told_apart():
    h1 = np.array([5, 5, 5, 9, 5], np.uint64)
    h2 = np.array([1, 2, 1, 1, 2], np.uint64)
    order, begins = substrings.grouped(h1, h2)
    assert [sorted(g.tolist()) for g in np.split(order, begins[1:])] == [[0, 2], [1, 4], [3]]
    assert substrings._held(h1, h2, h1[:2], h2[:2]).tolist() == [True, True, True, False, True]
    assert substrings._held(h1, h2, h1[1:2], h2[1:2]).tolist() == [False, True, False, False, True]
