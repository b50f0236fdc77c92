"""Phrases and their scores against plain counting; the automata against dictionaries."""

from __future__ import annotations

import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from leverwise.llm import collocations
from leverwise.llm.transducer import Builder, Transducer, built, summed

SMALL = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least, first):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if a >= candidates[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in held:
                cuts = ((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(docs, rows):
    return docs(*[(i, text, lang) for i, (lang, text) in enumerate(rows)])


@pytest.mark.parametrize(("least", "first", "piece"), [(3, 1000, 10**6), (8, 15, 2000)])
def test_phrases_equal_plain_counting(docs, monkeypatch, least, first, piece):
    monkeypatch.setattr(collocations, "LEAST", least)
    monkeypatch.setattr(collocations, "SLICE", piece)
    monkeypatch.setattr(collocations, "RANGE_WORDS", 300)
    chosen = random.Random(least)
    words = ["The", "of", "ÉTÉ", "été", "x-y", "new", "york", "a\xa0b", "z\x00", " ", *(f"w{i}" for i in range(9))]
    fixed = ["new york city hall tower", "of the of the", "été  x-y\tNEW"]
    rows = []
    for _ in range(150):
        parts = [chosen.choice([chosen.choice(words), chosen.choice(words), chosen.choice(fixed)]) for _ in range(chosen.randrange(25))]
        rows.append((chosen.choice(["en", "en", "fr", None, "und", ""]), "".join(p + chosen.choice([" ", " ", " ", ". ", "\n", ","]) for p in parts)))
    rows += [("en", None), (None, ""), ("fr", " .,\t"), ("one", "alone alone alone alone"), ("en", "the of " * 3000)]
    got = sorted(tuple(r) for r in collocations.collocations(texts(docs, rows), first).collect())
    assert got == brute(rows, least, first) and got


def test_words_that_share_a_hash_start_again(docs, monkeypatch):
    plain = collocations.run_hashes

    def clumsy(raw, starts, ends, value):
        found = plain(raw, starts, ends, value)
        return found % np.uint64(5) if value[0] == collocations.constants(256, 1000)[0] else found

    rows = [("en", "one two three four five six seven eight nine ten " * 30)]
    df = texts(docs, rows)
    monkeypatch.setattr(collocations, "run_hashes", clumsy)
    mapped = []
    monkeypatch.setattr(collocations, "map_arrow", lambda frame, schema, work: mapped.append(work) or local(frame, schema, work))

    def local(frame, schema, work):
        import pyarrow as pa

        made = list(work(iter(frame.toArrow().to_batches())))
        return frame.sparkSession.createDataFrame(pa.Table.from_batches(made).to_pylist(), schema)

    _, salt = collocations._counted_words(df)
    assert salt == 1 and len(mapped) == 2


def test_no_texts(docs):
    assert collocations.collocations(docs()).collect() == []
    assert collocations.collocations(docs((1, None), (2, "only a few words"))).collect() == []


def test_transducers_count_and_come_back():
    chosen = random.Random(3)
    for _ in range(40):
        f = Counter(tuple(chosen.randrange(1, 5) for _ in range(chosen.randrange(1, 5))) for _ in range(chosen.randrange(1, 200)))
        build = Builder()
        for ngram in sorted(f):
            build.add(ngram, f[ngram])
        made = Transducer.from_parts(build.finish().to_parts())
        rows = np.array([[*ngram, *[0] * (4 - len(ngram))] for ngram in sorted(f)], np.uint64)
        whole = built(rows, np.array([f[ngram] for ngram in sorted(f)]))
        assert len(whole.first) == len(made.first) and len(whole.label) == len(made.label)
        for (a, n), (b, m) in zip(whole.paths(), made.paths(), strict=True):
            assert (a == b).all() and (n == m).all()
        prefixes = Counter()
        for ngram, count in f.items():
            for d in range(1, len(ngram) + 1):
                prefixes[ngram[:d]] += count
        listed = {tuple(row): int(n) for rows, counts in made.paths() for row, n in zip(rows.tolist(), counts, strict=True)}
        assert listed == prefixes
        assert all(made.find(p) == n for p, n in prefixes.items()) and made.find((9,)) == made.find((1, 2, 3, 4, 1)) == 0


def test_equal_states_are_kept_once():
    build = Builder()
    for a in range(100):
        build.add((a, 1, 2), 1)
    made = build.finish()
    assert len(made.first) - 1 == 4 and len(made.label) == 102


def test_union_adds_up():
    a, b = (np.array([[1, 2], [3, 4]], np.uint64), np.array([5, 6])), (np.array([[0, 9], [3, 4]], np.uint64), np.array([1, 1]))
    rows, counts = summed([a, b])
    assert rows.tolist() == [[0, 9], [1, 2], [3, 4]] and counts.tolist() == [1, 5, 7]
