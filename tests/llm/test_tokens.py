from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leverwise.llm import chunks, packing, token_counts, token_files
from leverwise.llm.chunks import Encoder, tokenizer
from leverwise.llm.common import new_folder

PIECES = [*"aeth  \n\t'slre.,!?<|>0129éßñ中🙂", " ", " ", "　", "́", "<|endoftext|>", "<|startoftext|>", "'re", "'ll", " the", " OF", "\r\n  ", "\x1c", "a,b", "(c)", "it's", "x_y", "A.B", " t'll.", "w-", "$$"]


def odd_texts(n: int, seed: int = 1) -> list[str | None]:
    chosen = random.Random(seed)
    return ["".join(chosen.choice(PIECES) for _ in range(chosen.randrange(50))) for _ in range(n)] + [None, "", "x" * 3000]


@pytest.mark.parametrize("path", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_the_library(path):
    texts, whole = odd_texts(1500), tokenizer(path)
    seen = 0
    for low, high, ids, of in Encoder(path).encode(pa.array(texts)):
        for row in range(low, high):
            want = whole.encode(texts[row] or "", add_special_tokens=False).ids
            assert ids[of[row - low] : of[row - low + 1]].tolist() == want
            seen += 1
    assert seen == len(texts)


def test_count_of_every_prefix():
    counter, whole = token_counts.PrefixCounter(token_counts.FILE), tokenizer(token_counts.FILE)
    for text in odd_texts(80, 2)[:-3]:
        counts = counter.prefixes(text.encode())
        for end in range(len(text) + 1):
            want = len(whole.encode(text[:end], add_special_tokens=False).ids)
            assert counts[len(text[:end].encode())] == want, repr(text[:end])


@pytest.mark.parametrize("text", ["中文字" * 50_000 + "<|endoftext|>" + "中文" * 50_000, "x" * 400_000, " " * 400_000, "<|endoftext|>" * 30_000,
                                  "<|endoftext" * 30_000, "a <|endoftext|>\n" * 30_000])
def test_long_chunks_with_special_tokens_take_time_in_proportion(text):
    counter, whole = token_counts.PrefixCounter(token_counts.FILE), tokenizer(token_counts.FILE)
    begun = time.process_time()
    n, counts = counter.total(text.encode()), counter.prefixes(text.encode())
    assert time.process_time() - begun < 30
    assert n == counts[-1] == len(whole.encode(text, add_special_tokens=False).ids)


def test_tables_of_partial_results_are_bounded():
    held = token_counts.Recent(10_000)
    for k in range(1000):
        held.keep(k, k, 30)
        assert len(held) + len(held.older) <= 2 * (10_000 // (token_counts.ENTRY + 30) + 1) + 1
    assert held[999] == 999 and held[0] is None


def test_kept_chunks_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(chunks, "CACHED", 20_000)
    made, whole = Encoder("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    for turn in range(20):
        text = " ".join(f"w{turn % 7}x{i}" for i in range(300))
        (_, _, ids, _), = made.encode(pa.array([text]))
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        assert sum(chunks.ENTRY + len(k) + len(v) for k, v in made.known.items()) <= 20_000
        assert len(made.older) < 1000


def test_token_counts_and_cuts(docs):
    texts = [(i, t) for i, t in enumerate(odd_texts(60, 3))] + [(7, "again"), (None, "no id")]
    whole = tokenizer(token_counts.FILE)
    found = token_counts.token_counts(docs(*texts), limit=5).collect()
    want = []
    for doc_id, text in texts:
        text = text or ""
        fit = max(k for k in range(len(text) + 1) if len(whole.encode(text[:k], add_special_tokens=False).ids) <= 5) if len(text) < 200 else None
        n = len(whole.encode(text, add_special_tokens=False).ids)
        want.append((doc_id, len(text.encode()), n, n > 5, None if fit is None else len(text[:fit].encode())))
    got = [tuple(r)[:4] + (r.fit_bytes if len(t[1] or "") < 200 else None,) for r, t in zip(found, texts, strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs()).collect() == []


def test_prefix_table_answers_budgets(docs):
    table = token_counts.prefix_table(docs((1, "some words to count"), (2, None)))
    rows = {r.doc_id: r.counts for r in table.collect()}
    assert rows[2] == [0] and len(rows[1]) == len("some words to count") + 1
    used = {r.doc_id: r.used for r in token_counts.within_budget(table, 2).collect()}
    assert used == {1: 2, 2: 0}


def test_files_hold_all_documents_in_order(spark, docs):
    rows = [(i, t) for i, t in zip(range(70, 0, -1), odd_texts(67, 4), strict=True)] + [(None, "none"), (5, "second")]
    whole = tokenizer(token_files.FILE)
    manifest = token_files.write_tokens(docs(*rows), new_folder(spark, "tokens"))
    found = sorted(token_files.read_back(spark, manifest).collect(), key=lambda r: r.start)
    assert len(found) == len(rows)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    want = []
    for doc_id, text in rows:
        own = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == sorted(want, key=repr)
    assert token_files.token_output(docs()).collect() == []
    one = token_files.fetch(spark, manifest, [9]).collect()
    assert [r.doc_id for r in one] == [9] and one[0].frames_read == 1
    assert one[0].ids == [*whole.encode(dict(rows)[9] or "", add_special_tokens=False).ids, 1]


def _file(documents) -> bytes:
    sink = pa.BufferOutputStream()
    writer = token_files.Writer(sink)
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, np.uint32))
    writer.close()
    return sink.getvalue().to_pybytes()


def test_reader_takes_only_the_frames_it_needs_and_sees_damage():
    size = token_files.FRAME_IDS
    parts = [(1, range(10)), (2, range(3 * size + 5)), (None, []), (4, range(7))]
    data = _file(parts)
    reader = token_files.Reader(pa.BufferReader(data))
    assert reader.ids.to_pylist() == [1, 2, None, 4]
    assert np.concatenate(list(reader.document(3))).tolist() == list(range(7)) and reader.frames_read == 1
    assert np.concatenate(list(reader.document(1))).tolist() == list(range(3 * size + 5))
    assert list(reader.document(2)) == []
    table = reader.entries.copy()
    broken = token_files.Reader(pa.BufferReader(data))
    broken.entries = table
    broken.entries[0, 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        broken.frame(0)


def test_packing_places_every_piece_without_gaps(docs, prose):
    rows = [(i, prose(i, 1 + i * 7 % 900)) for i in range(150)] + [(200, None), (201, ""), (None, "a"), (5, "twice"), (300, prose(3, 3000))]
    whole = tokenizer(packing.FILE)
    found = packing.pack(docs(*rows)).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    ends: dict = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    assert len(ends) <= -(-sum(r.length for r in found) // 1024) + 2
    assert packing.pack(docs()).collect() == []


@pytest.mark.parametrize("counts", [{600: 50, 400: 50}, {1: 5}, {1024: 3}, {s: 20 for s in range(1, 1025, 3)}, {513: 9}])
def test_plan_is_whole_and_tight(counts):
    made = packing.plan(counts)
    assert {s: made.next_rank[s] for s in counts} == counts
    least = -(-sum(s * n for s, n in counts.items()) // 1024)
    if counts != {513: 9}:
        assert made.sequences <= least * 1.03 + 1
    else:
        assert made.sequences == 9
