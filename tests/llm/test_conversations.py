"""The prefix trie of conversations against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from leverwise.llm import conversations


def brute(rows):
    """Nodes of the trie of rebuilt conversations, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv_id].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [row[3:] for row in sorted(found)] for c, found in own.items()}
    rebuilt = {}
    for c, said in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(head, [])[:h] + said[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
            if d:
                children[said[: d - 1]].add(said[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    out = []
    for path in sorted(members, key=len, reverse=True):
        if not children[path]:
            leaves[path] = 1
        if path:
            saved[path] += (len(members[path]) - 1) * len(path[-1][1].encode())
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
        ends = ",".join(str(c) for c in sorted(members[path]) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(children[path]), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="session")
def talks(spark):
    """A conversations table with further columns whose names occur inside the operator."""

    def make(*rows):
        ddl = "conv_id bigint, turn bigint, role string, text string, key string, shard int, head string, ids int, digest int, id string"
        return spark.createDataFrame([(*r, *[None] * 6) for r in rows], ddl)

    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def drawn(seed, n, turns, texts, first=0):
    chosen = random.Random(seed)
    return [(c, t, chosen.choice(["user", "bot", None]), chosen.choice(texts))
            for c in range(first, first + n) for t in range(chosen.randrange(1, turns + 1))]


@pytest.mark.parametrize("fanout", [2, 64])
@pytest.mark.parametrize(("seed", "n", "turns", "texts"), [(1, 40, 3, ["a", "b"]), (2, 60, 14, ["a", "ü", None, ""]), (3, 30, 30, ["x"])])
def test_trie_equals_the_definition(spark, talks, monkeypatch, fanout, seed, n, turns, texts):
    monkeypatch.setattr(conversations, "FANOUT", fanout)
    monkeypatch.setattr(conversations, "SHARD", 20)
    rows = drawn(seed, n, turns, texts, first=-7)
    assert rows_of(conversations.prefix_trie(talks(*rows))) == brute(rows)


def test_ties_nulls_repeats_and_missing_heads(talks):
    rows = [(5, None, "user", "first"), (5, 0, "user", "same"), (5, 0, "bot", "same"), (5, 0, "bot", "same"), (6, 1, None, None),
            (None, 0, "user", "nobody's"), (None, None, None, None), (23, 0, "user", "no head"), (24, 3, "", ""), (24, 3, None, "")]
    rows += [(2**62, t, "user", "long " * 30_000) for t in range(3)]
    assert rows_of(conversations.prefix_trie(talks(*rows))) == brute(rows)


def test_many_equal_and_one_very_long_conversation(talks, monkeypatch):
    monkeypatch.setattr(conversations, "SHARD", 50)
    monkeypatch.setattr(conversations, "PIECE", 7)
    rows = [(5 * c, t, "user", f"same {t}") for c in range(80) for t in range(2)]
    rows += [(1001, t, "bot", f"{t % 3}") for t in range(700)]
    assert rows_of(conversations.prefix_trie(talks(*rows))) == brute(rows)


def test_no_conversations(talks):
    assert conversations.prefix_trie(talks()).collect() == []
    assert conversations.prefix_trie(talks((None, 1, "user", "x"))).collect() == []


def test_a_tree_filled_by_medians_is_shallow():
    assert sorted(conversations.medians(1000)) == list(range(1000))
    tree = conversations.TernaryTree()
    for k in conversations.medians(1000):
        tree.add([k], [1])
    height = {tree.below[0]: 1}
    for node in list(range(1, len(tree.id))):
        for links in (tree.less, tree.more):
            if links[node] >= 0:
                height[links[node]] = height[node] + 1
    assert max(height.values()) == 10
