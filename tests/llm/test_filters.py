from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from leverwise.llm import decontaminate, pii
from leverwise.llm.fm_index import FMIndex


def plain_by_definition(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_plain_spans_equal_the_definition():
    chosen = random.Random(8)
    for signs in ("a@.-", "ab@.1 +-é", "0123456789 -", "1.2 ", "+1(). -2", "001.25."):
        for _ in range(3000):
            text = "".join(chosen.choice(signs) for _ in range(chosen.randrange(40)))
            assert pii.plain_spans(text) == plain_by_definition(text), text


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("to john [at] mail [dot] com now", "email", "john [at] mail [dot] com"),
        ("john.doe at mail dot example dot org!", "email", "john.doe at mail dot example dot org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊｏ＠ｅｘ．ｃｏｍ", "email", "ｊｏ＠ｅｘ．ｃｏｍ"),
        ("jo​hn@ex​ample.com", "email", "jo​hn@ex​ample.com"),
        ("é plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
        ("at one two seven dot zero dot zero dot one", "ip", "one two seven dot zero dot zero dot one"),
        ("4" + "１" * 15, "card", "4" + "１" * 15),
    ],
)
def test_disguises_are_mapped_back(text, kind, piece):
    (_, plain, every), = pii.spans_of(pa.array([text]))
    start = text.index(piece)
    assert (start, pii.KINDS.index(kind), start + len(piece)) in every
    assert set(plain) <= set(every)
    assert piece not in pii.masked(text, every)


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("ask john at mail.example dot com", "email", "john at mail.example dot com"),
        ("ask john at mail.example [dot] com", "email", "john at mail.example [dot] com"),
        ("ask john at a.b-c.example (dot) co dot uk", "email", "john at a.b-c.example (dot) co dot uk"),
        ("tel +49 151 two three 4567890!", "phone", "+49 151 two three 4567890"),
        ("tel +49 151 two 3 four, 567890", "phone", "+49 151 two 3 four, 567890"),
        ("tel plus four 9 151 23456 sept", "phone", "plus four 9 151 23456 sept"),
        ("tel +49 1512eight34 567 now", "phone", "+49 1512eight34 567"),
        ("at 10.0.0 dot one", "ip", "10.0.0 dot one"),
        ("at ten dot or one dot 20.30.4 ok", "ip", "one dot 20.30.4"),
        ("4111 1111, one one\xa0one one 1111", "card", "4111 1111, one one\xa0one one 1111"),
    ],
)
def test_domains_with_plain_dots_and_digits_among_figures(text, kind, piece):
    every, ungated = gated_and_ungated(text)
    start = text.index(piece)
    assert every == ungated == [(start, pii.KINDS.index(kind), start + len(piece))]


def test_spelled_digits_that_touch_figures_take_nothing_away():
    """A joined digit would break the checksum of the card or lengthen the number."""
    card = "4111 1111 1111 11\u200b11"
    for text, kind, piece in ((f"{card} one", "card", card), ("one 4111111111111111 un", "card", "4111111111111111"),
                              ("+49 151 23\u200b45678 un ami", "phone", "+49 151 23\u200b45678")):
        every, _ = gated_and_ungated(text)
        start = text.index(piece)
        assert every == [(start, pii.KINDS.index(kind), start + len(piece))]


def test_the_gate_holds_all_that_can_be_rewritten():
    chosen = random.Random(5)
    parts = ["one", "ſıx", "fünf", "un", "plus", "dot", "[dot]", "at", "+", "1", "49", "2345678", ".", ",", "-", "a", "é", "_", "@", "x.co"]
    texts = [
        "".join(chosen.choice(parts) + chosen.choice(["", " ", "\xa0", "  "]) for _ in range(chosen.randrange(3, 14)))
        for _ in range(20_000)
    ]
    for text, plain, every in pii.spans_of(pa.array(texts)):
        assert every == sorted(plain + pii.hidden_spans(text, plain)), text


def gated_and_ungated(text):
    (_, plain, every), = pii.spans_of(pa.array([text]))
    return every, sorted(plain + pii.hidden_spans(text, plain))


def test_no_blank_is_missed_by_the_gate():
    blanks = [c for c in map(chr, range(sys.maxunicode + 1)) if re.match(r"\s", c)]
    assert len(blanks) > 20
    for c in blanks:
        for text, kind in (
            (f"john at mail{c}dot{c}com", "email"),
            (f"john{c}[{c}at{c}]{c}mail.com", "email"),
            (f"john@mail({c}dot{c})com", "email"),
            (f"plus{c}" + c.join("four nine one five one two three four five six".split()), "phone"),
            (c.join("one two seven dot zero dot zero dot one".split()), "ip"),
        ):
            every, ungated = gated_and_ungated(text)
            assert every == ungated == [(0, pii.KINDS.index(kind), len(text))], (hex(ord(c)), text)


@pytest.mark.parametrize("letter", ["ı", "İ", "ſ", "I", "S"])
def test_letters_that_fold_to_ascii_are_read_as_digits(letter):
    text = "plus four nine one five one two three four six five"
    text = text.replace("i" if letter in "ıİI" else "s", letter)
    every, ungated = gated_and_ungated(text)
    assert every == ungated and (every[0][1], every[0][2]) == (pii.KINDS.index("phone"), len(text))


def test_ordinary_text_is_left_alone():
    for text in ("the house at the sea, one two three", "dot by dot", "la de un dos tres", "α and ω", "page 12 of 400", "a – b"):
        (_, plain, every), = pii.spans_of(pa.array([text]))
        assert plain == every == []


LONG = {
    "spelled digits": "one two three " * 30_000, "more of them": "one two three four " * 30_000 + "x", "blanks": " " * 200_000 + "[at]" + " " * 200_000,
    "groups of blanks": (" " * 500 + "[ at ] ") * 800, "mails": "a@b.co x[at]y.co " * 20_000, "plus": "plus " * 80_000, "dots": "a dot " * 60_000,
    "at": "a at b.c " * 50_000, "figures": "1 " * 200_000, "figures and words": "one 5 " * 50_000, "joined": "1 un" * 80_000, "commas": "one" + "," * 300_000 + "two 5",
    "hidden": "a" + "\u200b" * 300_000 + " ", "brackets": "[ " * 150_000 + "[at]", "one domain": "a at " + "b." * 150_000, "one word": "x" * 400_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts_take_time_in_proportion(name):
    begun = time.process_time()
    (text, plain, every), = pii.spans_of(pa.array([LONG[name]]))
    assert time.process_time() - begun < 20
    assert plain == plain_by_definition(text) if name == "mails" else set(plain) <= set(every)


def test_taken_places_equal_plain_comparison():
    chosen = random.Random(2)
    for _ in range(500):
        spans = sorted((s := chosen.randrange(60), 0, s + chosen.randrange(1, 9)) for _ in range(chosen.randrange(6)))
        taken, listed = pii.Taken(spans), [(s, e) for s, _, e in spans]
        for _ in range(20):
            start = chosen.randrange(60)
            end = start + chosen.randrange(1, 9)
            free = all(end <= s or start >= e for s, e in listed)
            assert taken.take(start, end) == free
            listed += [(start, end)] * free


def test_blanks_around_brackets():
    for text, piece in (("a.b  \t [ at ]  c [dot] de", "a.b  \t [ at ]  c [dot] de"), ("a[at] [dot]b", None), ("x (at) (at) y.co", None),
                        (" [at] a.co", None), ("go: j [at]\n\n k.co.", "j [at]\n\n k.co")):
        every, ungated = gated_and_ungated(text)
        start = -1 if piece is None else text.index(piece)
        assert every == ungated == ([] if piece is None else [(start, 0, start + len(piece))]), text


def test_identifiers_and_mask(docs):
    rows = [(1, "mail a@b.co and x [at] y [dot] de"), (2, None), (3, ""), (None, "10.0.0.1"), (1, "again a@b.co"), (5, "w " * 50_000 + "a@b.co")]
    found = pii.identifiers(docs(*rows)).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.n_email, r.n_ip, r.spans) for r in found}
    assert (1, 2, 0, "email:5:11,email:16:33") in by and (None, 0, 1, "ip:0:8") in by and (2, 0, 0, "") in by
    assert (5, 1, 0, "email:100000:100006") in by
    base = next(r.base_sha256 for r in found if r.n_email == 2)
    assert base == hashlib.sha256(b"email:5:11").hexdigest()
    masked = pii.mask(docs(*rows))
    assert masked.columns == docs().columns
    assert {r.text for r in masked.collect() if r.doc_id in (1, 2, 3, None)} == {"mail [email] and [email]", None, "", "[ip]", "again [email]"}
    assert pii.identifiers(docs()).collect() == [] and pii.mask(docs()).collect() == []


def test_index_finds_every_place():
    chosen = np.random.default_rng(0)
    for turn in range(60):
        size = int(chosen.integers(1, 6))
        runs = [[*chosen.integers(1, size + 1, int(chosen.integers(1, 40))).tolist(), 0] for _ in range(int(chosen.integers(1, 10)))]
        text = np.array([s for r in (runs[:1] * 7 if turn % 3 == 0 else []) + runs for s in r])
        index = FMIndex(text, size)
        phrases = [chosen.integers(1, size + 1, int(chosen.integers(1, 6))).tolist() for _ in range(8)]
        lengths = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), lengths.max()), int)
        for k, p in enumerate(phrases):
            table[k, table.shape[1] - len(p) :] = p
        low, high = index.search(table, lengths)
        for k, p in enumerate(phrases):
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def contaminated_by_definition(rows, items):
    found = []
    for doc_id, text in rows:
        w, hit, named = words(text), set(), set()
        for item_id, item in items:
            x = words(item)
            size = min(10, len(x))
            for i, j in itertools.product(range(len(x) - size + 1 if size else 0), range(len(w) - size + 1)):
                if x[i : i + size] == w[j : j + size]:
                    hit.update(range(j, j + size))
                    named.add(item_id)
        listed = sorted(str(i) for i in named if i is not None)
        found.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest()))
    return found


@pytest.fixture
def benchmark(spark, prose):
    rows = [(1, prose(1, 14)), (2, prose(2, 10)), (3, "Two words"), (4, None), (5, "..."), (6, prose(1, 12)), (None, prose(9, 11)),
            (10, prose(2, 10))]
    return spark.createDataFrame(rows, "item_id bigint, text string"), rows


def test_contamination_equals_the_definition(docs, prose, benchmark):
    table, items = benchmark
    a, b = prose(1, 14), prose(2, 10)
    rows = [(1, f"before {a} after {b}"), (2, a.upper().replace(" ", " -- ")), (3, a[: len(a) // 2]), (4, "two, WORDS two words"), (5, None),
            (6, ""), (7, prose(9, 11)), (None, b), (1, b), (9, f"{prose(30, 9000)} {b} {b} {prose(31, 3000)}"), (10, f"two. {a}"), (11, "..."),
            (12, b.rsplit(" ", 1)[0]), (13, b.rsplit(" ", 1)[1])]
    found = decontaminate.contamination(docs(*rows), table).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found]
    assert sorted(got, key=repr) == sorted(contaminated_by_definition(rows, items), key=repr)
    assert all(r.contaminated == (r.n_hit > 0) for r in found)


def test_removed_passages_do_not_come_back(docs, prose, benchmark):
    table, items = benchmark
    a = prose(1, 14)
    w = a.split()
    rows = [(1, f"before {a} after", "en"), (2, a, "en"), (3, "clean text", "de"), (4, None, None),
            (5, " ".join([*w[:5], *w, *w[5:]]), "en")]
    left = decontaminate.remove_passages(docs(*rows), table)
    assert left.columns == docs().columns
    kept = {r.doc_id: (r.text, r.lang) for r in left.collect()}
    assert set(kept) == {1, 3, 4, 5} and kept[1] == ("before removed after", "en") and kept[3] == ("clean text", "de") and kept[4] == (None, None)
    again = contaminated_by_definition([(k, v[0]) for k, v in kept.items()], items)
    assert all(row[2] == 0 for row in again)


def test_empty_tables(spark, docs, benchmark):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs(), benchmark[0]).collect() == []
    assert [r.n_hit for r in decontaminate.contamination(docs((1, "a b")), nothing).collect()] == [0]
    assert [r.text for r in decontaminate.remove_passages(docs((1, "a b")), nothing).collect()] == ["a b"]
