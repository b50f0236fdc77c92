"""Personal data in texts, also behind disguises, with spans in the source text (operator 4).

Plain identifiers are found by fixed patterns. Then a chain of two transducers rewrites the text: the first replaces
look-alike characters one for one; the second rewrites at/dot disguises, runs of spelled digits and invisible
characters, and keeps for each rewritten piece where it came from. The same patterns run over the normalised text; a
match that holds a rewritten piece and touches no plain match is mapped back to source positions and added.

At least DIGIT_RUN spelled digits in a row are a number of their own. Fewer count only where they touch figures; a last
pass joins these, and what it finds is added if it touches no span of before. An ``at`` without brackets is rewritten
only if a spelled dot follows in the domain, perhaps after labels with plain dots: ``john at mail.example.com`` is left,
as it cannot be told from prose.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leverwise.llm.common import ids_and_texts, map_arrow

KINDS = ("email", "ip", "card", "phone")
# Spelled digits in a row that count as a number if they touch no figure.
DIGIT_RUN = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can only match if the start of the run does, so such starts are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
# Chains of fewer than 12 digits fail anyway.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        if match:
            done = match.end()
            yield begin, done
        else:
            # The run before this sign can be part of no later match.
            done = max(done, at + 1)
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) << (k & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of all identifiers as they stand, leftmost and not overlapping for each kind."""
    out: list[Span] = []
    out += ((s, 0, e) for s, e in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Cyrillic and Greek letters that look like Latin ones.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "А": "A", "В": "B",
    "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}


def _look_alikes() -> dict[int, str]:
    """The table above, and by rule all characters whose compatibility form is one ASCII letter, digit or sign."""
    table = {ord(k): v for k, v in _ALIKE.items()}
    for low, high in ((0x2000, 0x2500), (0xFE50, 0xFF60), (0x1D400, 0x1D800)):
        for code in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and "!" <= plain <= "~":
                table[code] = plain
    for code in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212):
        table[code] = "-"
    return table


LOOK_ALIKES = _look_alikes()
# Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3",
    "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2",
    "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_HIDDEN = "​‌‍⁠﻿­"
_DOT = r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
# A run of blanks is entered at its start only, so that each is read once.
_AT = r"(?:(?<!\s)\s++)?[\[({<]\s*+at\s*+[\])}>]\s*+"
_JOIN = rf"(?:[\s,-]+|{_DOT})"
_START = r"\b(?:plus[\s,-]+)?"
_SPELLED = rf"{_START}(?:{_WORD})(?:{_JOIN}(?:{_WORD}))" + f"{{{DIGIT_RUN - 1},}}" + r"\b"
_CHAIN = (
    rf"(?P<digits>{_SPELLED})"
    rf"|(?P<at>{_AT}|(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_DOT}[A-Za-z0-9-]))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<hidden>(?<=\S)[{_HIDDEN}]+(?=\S))"
)
_REWRITE = re.compile(_CHAIN, re.IGNORECASE)
# Spelled digits, whatever their number, with a figure before or after them.
_SOME = rf"(?:{_WORD})(?:{_JOIN}(?:{_WORD}))*"
_MIXED = rf"(?P<mixed>(?<=[0-9]){_JOIN}?{_SOME}(?:{_JOIN}?(?=[0-9])|\b)|{_START}{_SOME}{_JOIN}?(?=[0-9]))"
# Long runs are taken whole, so that none is read again from each of its words.
_TOUCHING = re.compile(f"{_MIXED}|{_SPELLED}", re.IGNORECASE)
_REWRITE_MIXED = re.compile(f"{_MIXED}|{_CHAIN}", re.IGNORECASE)
_ALIKE_CHARACTER = re.compile("[" + "".join(map(re.escape, map(chr, LOOK_ALIKES))) + "]")
# All that Python's \s matches, and the letters that it takes for i and s without regard to case: the linear-time matcher
# knows only the ASCII blanks and not every such letter.
_BLANK = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_FOLDED = {ord("ı"): "i", ord("İ"): "i", ord("ſ"): "s"}
_ANY_WORD = "(" + _WORD.replace("i", "[iıİ]").replace("s", "[sſ]") + ")"
_ANY_JOIN = rf"(({_BLANK}|[,-])+|{_BLANK}*[\[({{<]?{_BLANK}*dot{_BLANK}*[\])}}>]?{_BLANK}*)"
# What any rewriting needs, for the linear-time matcher over whole batches: no text is missed, few are read in vain.
_SIGNS = (
    rf"(?i)[\[({{<]{_BLANK}*(at|dot){_BLANK}*[\])}}>]|{_BLANK}dot{_BLANK}|[{_HIDDEN}]|(?-i:{_ALIKE_CHARACTER.pattern})"
    rf"|({_ANY_WORD}{_ANY_JOIN}){{{DIGIT_RUN - 1}}}{_ANY_WORD}"
    rf"|[0-9]{_ANY_JOIN}?{_ANY_WORD}([^A-Za-z_]|$)|(^|[^0-9A-Za-z_]){_ANY_WORD}{_ANY_JOIN}?[0-9]"
)
_STEP = re.compile(rf"(?P<word>{_WORD})|(?P<dot>dot)|(?P<plus>plus)", re.IGNORECASE)


class Normalised:
    """A rewritten text with the way back: pieces (start in the new text, start and end in the source)."""

    def __init__(self, source: str, rewrite: re.Pattern[str] = _REWRITE):
        text = source.translate(LOOK_ALIKES) if not source.isascii() else source
        self.changed = [m.start() for m in _ALIKE_CHARACTER.finditer(source)] if text != source else []
        self.parts: list[str] = []
        self.new: list[int] = []
        self.old: list[tuple[int, int, bool]] = []
        self.size = 0
        done = 0
        for match in rewrite.finditer(text):
            self._add(text[done : match.start()], done, match.start(), False)
            if match.lastgroup in ("digits", "mixed"):
                steps = list(_STEP.finditer(match[0]))
                # What stands between spelled digits and figures becomes one blank, which the patterns take.
                if steps[0].start() and not steps[0]["dot"]:
                    self._add(" ", match.start(), match.start() + steps[0].start(), True)
                for step in steps:
                    word = DIGIT_WORDS[step["word"].translate(_FOLDED).lower()] if step["word"] else "." if step["dot"] else "+"
                    self._add(word, match.start() + step.start(), match.start() + step.end(), True)
                if steps[-1].end() < len(match[0]) and not steps[-1]["dot"]:
                    self._add(" ", match.start() + steps[-1].end(), match.end(), True)
            elif match.lastgroup != "hidden":
                self._add("@" if match.lastgroup == "at" else ".", match.start(), match.end(), True)
            else:
                self._add("", match.start(), match.end(), True)
            done = match.end()
        self._add(text[done:], done, len(text), False)
        self.text = "".join(self.parts)

    def _add(self, piece: str, begin: int, end: int, rewritten: bool) -> None:
        if piece or rewritten:
            self.parts.append(piece)
            self.new.append(self.size)
            self.old.append((begin, end, rewritten))
            self.size += len(piece)

    def source(self, begin: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the new text, and whether anything in it was rewritten."""
        first, last = bisect_right(self.new, begin) - 1, bisect_right(self.new, end - 1) - 1
        a, _, one = self.old[first]
        c, d, two = self.old[last]
        start = a if one else a + begin - self.new[first]
        stop = d if two else c + end - self.new[last]
        inside = bisect_right(self.changed, stop - 1) > bisect_right(self.changed, start - 1)
        return start, stop, inside or any(x[2] for x in self.old[first : last + 1])


class Taken:
    """Places that spans cover, as disjoint ranges in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in spans:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def take(self, start: int, end: int) -> bool:
        """Cover a range if nothing in it is covered yet."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def hidden_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, in source positions; none touches one of the sorted plain ones."""
    taken = Taken(plain)
    out: list[Span] = []
    source = text if text.isascii() else text.translate(LOOK_ALIKES)
    mixed = any(m.lastgroup == "mixed" for m in _TOUCHING.finditer(source))
    for rewrite in (_REWRITE, _REWRITE_MIXED) if mixed else (_REWRITE,):
        made = Normalised(text, rewrite)
        for begin, kind, end in plain_spans(made.text):
            start, stop, rewritten = made.source(begin, end)
            if rewritten and taken.take(start, stop):
                out.append((start, kind, stop))
    return out


def spans_of(texts: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """For each text of a batch: the text, its plain spans, all its spans."""
    signs = pc.fill_null(pc.match_substring_regex(texts, _SIGNS), False)
    for value, sign in zip(texts, signs.to_pylist(), strict=True):
        text = value.as_py() or ""
        plain = plain_spans(text)
        yield text, plain, sorted(plain + hidden_spans(text, plain)) if sign else plain


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def identifiers(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and ``spans`` cover plain and disguised identifiers, ``base_sha256`` the plain ones; positions are code
    points, the end is exclusive. A null or empty text holds none: counts 0, no spans, the hash of nothing. Repeated
    rows and rows without id are treated like others; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, joined = [], []
            for _, plain, every in spans_of(batch.column(1)):
                for k, column in enumerate(counts):
                    column.append(sum(span[1] == k for span in every))
                digests.append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                joined.append(_joined(every))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(joined, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_arrow(ids_and_texts(documents), schema, work)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones are replaced together."""
    parts, done = [], 0
    merged: list[list] = []
    for start, kind, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        parts += [text[done:start], f"[{KINDS[kind]}]"]
        done = end
    return "".join([*parts, text[done:]])


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with masked texts; null texts stay null, all other columns are unchanged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            texts = pa.array([masked(text, every) for text, _, every in spans_of(column)], column.type)
            blank = pa.nulls(len(column), column.type)
            yield batch.set_column(at, batch.schema.field(at), pc.if_else(column.is_valid(), texts, blank))

    return map_arrow(documents, documents.schema, work)
