from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from leverwise.llm import language, quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_folds_are_crc32_of_the_id(spark, docs):
    from leverwise.llm.common import fold
    from pyspark.sql import functions as F

    table = docs(*((i, "x") for i in (0, 1, 7, 123456789)))
    for r in table.select("doc_id", fold(F.col("doc_id"), 3).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.doc_id).encode()) % 3


def all_segments(scores):
    """Maximal segments by definition: the best run, then the same left and right of it."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    left, right = all_segments(scores[:i]), all_segments(scores[j:])
    return left + [(best[0], i, j)] + [(s, a + j, b + j) for s, a, b in right]


def test_segments_equal_the_definition():
    chosen = np.random.default_rng(3)
    for _ in range(300):
        scores = chosen.choice([-2.0, -1.0, -0.25, 0.5, 1.125, 3.0], int(chosen.integers(0, 25)))
        got = toxicity.segments(scores)
        want = all_segments(scores.tolist())
        assert sum(s for s, *_ in got) == pytest.approx(sum(s for s, *_ in want))
        assert max((s for s, *_ in got), default=0) == pytest.approx(max((s for s, *_ in want), default=0))
        assert all(s > 0 and scores[b:e].sum() == pytest.approx(s) for s, b, e in got)


@pytest.fixture(scope="module")
def judged(spark, docs, prose):
    bad = ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 60).split()
        if i % 6 == 0:
            words[20:23] = bad
        rows.append((i, " ".join(words), "en"))
        if i % 2 == 0 or i % 6 == 0:
            labels.append((i, None, int(i % 6 == 0)))
    rows += [(900, None), (901, ""), (902, " ".join(["vile rotten foul"] * 3000)), (None, "vile rotten foul " * 9), (0, rows[0][1])]
    return docs(*rows), spark.createDataFrame(labels, LABELS)


def test_toxic_passages_are_found(judged):
    documents, labels = judged
    found = toxicity.toxicity(documents, labels).collect()
    assert len(found) == documents.count()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
            toxic = r.doc_id == 902 or r.doc_id < 300 and r.doc_id % 6 == 0
            assert r.predicted == int(toxic), (r.doc_id, r.score)
            if toxic:
                raw = texts[r.doc_id].encode()
                assert b"rotten" in raw[r.passages[0] : r.passages[1]]
    left = toxicity.drop_toxic(documents, labels)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} == {i for i in range(300) if i % 6} | {900, 901}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.toxicity(docs((1, "a"), (2, None)), none).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(docs(), none).collect() == []
    assert toxicity.drop_toxic(docs((1, "a")), none).count() == 1


def test_forward_backward_equals_enumeration():
    chosen = np.random.default_rng(1)
    moves = chosen.normal(size=(3, 3))
    of = np.array([0, 4, 4, 5, 8])
    scores = chosen.normal(size=(8, 3)) * 2
    got, pairs = language.forward_backward(scores, of, moves)
    want, want_pairs = np.zeros_like(got), np.zeros((3, 3))
    for low, high in zip(of[:-1], of[1:], strict=True):
        paths = list(itertools.product(range(3), repeat=high - low))
        weight = np.array([np.exp(sum(scores[low + t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for t, k in enumerate(p):
                want[low + t, k] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_languages_are_learned_and_mixed_texts_shared_out(docs):
    chosen = np.random.default_rng(2)
    stems = {"aa": ["kato", "rimu", "saro", "olin"], "bb": ["gwyth", "thrack", "brusk", "dwelm"]}

    def text(lang, n):
        return " ".join(chosen.choice(stems[lang]) + chosen.choice(["", "a", "en"]) for _ in range(n))

    rows = [(i, text("aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(120)]
    mixed = text("aa", 40) + " " + text("bb", 20)
    rows += [(500, None, "aa"), (501, "123 ...", "bb"), (502, "", None), (503, mixed, None), (None, text("bb", 9), "aa"), (504, text("aa", 20_000), None),
             (1, rows[1][1], "aa")]
    found = {r.doc_id: r for r in language.languages(docs(*rows)).collect()}
    for i in range(120):
        assert found[i].lang_pred == ("aa" if i % 2 else "bb")
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [(found[i].lang_pred, found[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert found[503].lang_pred == "aa" and found[503].shares[0] == pytest.approx(2 / 3, abs=0.05)
    assert found[504].lang_pred == "aa" and found[None].lang_pred == "bb"


def test_rare_languages_are_learned_beside_many_copies(docs):
    chosen = np.random.default_rng(4)
    stems = {"aa": ["kato", "rimu", "saro", "olin"], "bb": ["gwyth", "thrack", "brusk", "dwelm"], "cc": ["zuxxi", "pleqo", "jyvva"]}

    def text(lang):
        return " ".join(chosen.choice(stems[lang]) + chosen.choice(["", "a", "en"]) for _ in range(20))

    copied = text("aa")
    rows = [(i, text("bb"), "bb") for i in range(600)] + [(i, copied, "aa") for i in range(600, 1200)]
    rows += [(i, text("aa"), "aa") for i in range(1200, 1240)] + [(i, text("cc"), "cc") for i in range(1240, 1248)]
    table = docs(*rows)
    sample = language.sampled(table.select("doc_id", "text", "lang"), 60).collect()
    assert sorted(r.lang for r in sample) == ["aa"] * 26 + ["bb"] * 26 + ["cc"] * 8
    assert len({r.text for r in sample}) == 60
    found = language.languages(table, 60).collect()
    assert [(r.doc_id, r.lang_pred) for r in found if r.lang_pred != rows[r.doc_id][2]] == []
    assert {r.lang for r in language.sampled(table.select("doc_id", "text", "lang"), 2).collect()} == {"aa", "bb", "cc"}


def test_languages_without_any_to_learn(docs):
    assert [r.lang_pred for r in language.languages(docs((1, "text", None))).collect()] == ["und"]
    assert language.languages(docs()).collect() == []


def test_kth_largest(spark):
    values = [5, -3, 2**62, -(2**63), 2**63 - 1, 0, 5, 5, -1]
    table = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(table, "v", 0) is None
    numbers = np.array([-2.5, -0.0, 0.0, 1e-300, 3.0, -1e300])
    assert np.array_equal(np.argsort(quality.sortable(numbers), kind="stable"), np.argsort(numbers, kind="stable"))


def test_resampling_keeps_a_share_and_prefers_the_target(spark, docs, prose):
    rows = [(i, prose(i, 50) if i % 4 else "### buy ### now ###" * 20) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(0, 200, 3)], LABELS)
    found = quality.resample(docs(*rows), labels, share=0.75).collect()
    assert sum(r.kept for r in found) == 150
    assert sum(r.kept for r in found if r.doc_id % 4 == 0) == 0
    least = min(r.gumbel_key for r in found if r.kept)
    assert all(r.kept == (r.gumbel_key >= least) for r in found)
    odd = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (2, ""), (3, "w " * 50_000)]
    again = quality.resample(docs(*odd), labels, share=0.5).collect()
    assert len(again) == 6 and len({r.kept for r in again if r.doc_id is None}) == 1
    assert all(r.log_weight == 0 for r in again if r.doc_id in (1, 2))
    assert quality.resample(docs(), labels).collect() == []
