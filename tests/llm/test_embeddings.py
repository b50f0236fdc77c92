from __future__ import annotations

import math

import numpy as np

from leverwise.llm import embeddings

DDL = "vec_id bigint, embedding array<float>, label int, node string, bucket string, weight string"


def brute(rows):
    """(vec_id, links, component) of every row by comparing all pairs."""
    good = []
    for vec_id, v, label in rows:
        usable = vec_id is not None and label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if usable else None)
    links = [[] for _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = good[i], good[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[i].append(j)
                    links[j].append(i)
                    parent[find(i)] = find(j)
            if rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(((row[0], len(links[i]), None if row[0] is None else least[find(i)]) for i, row in enumerate(rows)), key=repr)


def test_equals_brute_force(spark):
    chosen = np.random.default_rng(5)
    centres = chosen.standard_normal((6, 24))
    rows = []
    for k in range(160):
        noise = chosen.standard_normal(24) * chosen.choice([0.05, 0.12, 0.15, 0.3])
        rows.append((k, (centres[k % 6] + noise).tolist(), k % 3))
    rows += [(200 + k, rows[0][1], 0) for k in range(5)]
    rows += [(210, [2 * x for x in rows[0][1]], 0), (211, rows[0][1], 1), (212, rows[0][1], None), (213, None, 0), (214, [], 0),
             (215, [0.0] * 24, 0), (216, [float("nan"), *rows[0][1][1:]], 0), (217, [None, *rows[0][1][1:]], 0),
             (218, [float("inf"), *rows[0][1][1:]], 0), (219, [1.0], 0), (220, [2.0], 0), (None, rows[0][1], 0), (3, rows[1][1], 1), (3, rows[1][1], 1)]
    found = embeddings.near_vectors(spark.createDataFrame([(*r, None, None, None) for r in rows], DDL)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert embeddings.near_vectors(spark.createDataFrame([], DDL)).collect() == []


def test_pairs_at_the_threshold_share_a_table():
    chosen = np.random.default_rng(6)
    one = chosen.standard_normal((2000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = chosen.standard_normal(one.shape)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    two = 0.98 * one + math.sqrt(1 - 0.98**2) * other
    assert (embeddings.table_codes(one) == embeddings.table_codes(two)).any(axis=1).all()
