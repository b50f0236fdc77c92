from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from leverwise.llm import minhash
from leverwise.llm.components import components
from leverwise.llm.text import SPACED, constants, shingle_sets, words_of


def brute(rows):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            folded = folded.replace(c, " ")
        w = [x for x in folded.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_equals_brute_force(docs, prose):
    chosen = random.Random(4)
    rows = [(i, prose(i, 30)) for i in range(20)]
    base = prose(99, 60).split()
    for i in range(100, 260):  # near copies of one text: linked with it, often not with each other
        copy = list(base)
        for _ in range(chosen.randrange(1, 4)):
            copy[chosen.randrange(60)] = f"edit{chosen.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(300, rows[0][1]), (301, rows[0][1].upper()), (302, rows[0][1].replace(" ", "\n\t ")), (303, "one two"),
             (304, "two one"), (305, "one  two"), (306, ""), (307, None), (308, " \n "), (309, "é " * 30_000),
             (310, "x" * 200_000), (303, "another text under the same id")]
    found = minhash.near_duplicates(docs(*rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_rows_without_id_and_empty_tables(docs):
    found = minhash.near_duplicates(docs((None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"))).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in found) == [(False, 4, True)] + [(True, None, True)] * 2
    assert minhash.near_duplicates(docs()).collect() == []


def test_one_of_each_keeps_columns_and_one_row(docs):
    table = docs((1, "a b c d e f", "en"), (2, "a b c d e f", "fr"), (2, "a b c d e f", "fr"), (3, None, "de"),
                 (3, None, "de"), (None, "a b c d e f", "es"))
    left = minhash.one_of_each(table)
    assert left.columns == table.columns
    assert sorted((r.doc_id or 0, r.lang) for r in left.collect()) == [(0, "es"), (1, "en"), (3, "de")]


def _sets(*texts):
    factors = constants(minhash.SHINGLE, 11)
    return [s for *_, w in words_of(pa.array(texts), SPACED) for s in shingle_sets(w, minhash.SHINGLE, factors)]


def test_estimate_is_close_and_corrected(prose):
    words = prose(1, 4000).split()
    one, two = _sets(" ".join(words[:3000]), " ".join(words[300:3300]))
    true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    table = minhash.registers([one, two])
    found, error = minhash.estimate(table[:1], table[1:], np.array([len(one)]), np.array([len(two)]))
    assert abs(found[0] - true) < 4 * error[0]
    chance = minhash.expected_collisions(np.array([5e6]), np.array([5e6]))
    assert 0 < chance[0] < 0.2


def test_short_texts_at_the_threshold_share_a_band():
    words = [f"w{i}" for i in range(400)]
    missed = 0
    for k in range(0, 390, 2):
        one, two = _sets(" ".join(words[k : k + 7]), " ".join(words[k : k + 8]))  # 3 of 4 shingles
        keys = minhash.band_keys(minhash.registers([one, two]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_block_links_join_all_that_belongs_together(prose):
    words = prose(5, 40).split()
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(0, 40, 4)] + [prose(6, 40)]
    n = len(texts)
    rows = pa.table({"i": [0] * n, "j": [0] * n, "block": [0] * n, "node": list(range(n)), "component": list(range(n)), "text": texts})
    links = minhash._links_within(rows)
    sets = [set(s.tolist()) for s in _sets(*texts)]
    linked = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) * 100 >= 75 * len(sets[i] | sets[j])]
    assert set(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)) <= set(linked)
    assert links.num_rows == len({i for p in linked for i in p}) - 1


def test_components_of_chain_star_and_cycle(spark):
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, i) for i in range(101, 160)]
    cycle = [(200, 201), (201, 202), (202, 200)]
    links = spark.createDataFrame([*chain, *star, *cycle, (300, 300), (None, 5)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 203)}}
