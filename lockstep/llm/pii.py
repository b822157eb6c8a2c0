"""Personal data in texts, disguised forms included, with spans in the source's own characters.

Plain forms are found by four scanners.  Then transducers rewrite the text on a tape that keeps, for
every character, the source range it came from: look-alike characters become ASCII, invisible ones
go, "at" and "dot" disguises become "@" and ".", spelled digits become digits.  The same scanners run
over the tape and what they find is mapped back.  A found span inside a plain span of its kind is the
same thing seen twice and is dropped; one that reaches further is added beside the plain one.

Every scanner is linear in the text: a run of characters is entered at its start or at its "@" only.
Offsets count code points, ends are exclusive.  Null and empty texts have no spans.
"""
from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lockstep.llm.common import keyed_text, named_id

KINDS = ("email", "ip", "card", "phone")

# --- Fixed values -----------------------------------------------------------------------------------
#: Cyrillic and Greek letters that look like the Latin ones below them.
LOOKALIKE = "асеорхуіјѕԁһԛԝАВСЕНІЈКМОРЅТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɡ"
LATIN = "aceopxyijsdhqwABCEHIJKMOPSTXABEZHIKMNOPTYXog"
INVISIBLE = "­​‌‍⁠﻿"
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punto", "punkt", "point")
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
#: A run with fewer spelled digits is prose.
LEAST_SPELLED = 4
# ----------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is the run of local characters left of an "@", as far as the previous one's end."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Of a chain of dotted numbers, every four in turn."""
    for chain in _DOTTED.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        parts, start = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            values = [part.lstrip("0") for part in four]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, match.group())) <= 15:
                yield match.span()


SCANNERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the undisguised forms, by kind as listed, then by start."""
    if not text:
        return []
    return [(kind, s, e) for kind in KINDS for s, e in SCANNERS[kind](text)]


def _translation() -> dict[int, str]:
    """One character for one: look-alikes, full-width forms, and the decimal digits of every script."""
    table = {ord(a): b for a, b in zip(LOOKALIKE, LATIN, strict=True)}
    table |= {code: chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)}
    for code in range(0x80, sys.maxunicode + 1):
        digit = unicodedata.decimal(chr(code), None)
        if digit is not None:
            table[code] = str(digit)
    return table


_TABLE = _translation()
_MAPPED = frozenset(map(chr, _TABLE)) | frozenset(INVISIBLE)
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_OR = "|".join
_ATS, _DOTS = _OR(AT_WORDS), _OR(DOT_WORDS)
_DIGITS = _OR(sorted(DIGIT_WORDS, key=len, reverse=True))
_BRACKETED = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*+(?:({_ATS}|@)|({_DOTS}|\.))\s*+[\])}}>]\s*+", re.I)
#: A spoken address from its "at" on, and one piece of what stands before that.
_SPOKEN_TAIL = re.compile(rf"(?<=[a-z0-9])(?:\s++(?:{_ATS})\s++|@)[a-z0-9-]++(?:(?:\s++(?:{_DOTS})\s++|\.)[a-z0-9-]++)+", re.I)
_SPOKEN_PIECE = re.compile(rf"(?<=[a-z0-9])\s++(?:{_DOTS})\s++[a-z0-9-]++", re.I)
_SPOKEN_PLACE = re.compile(r"(?<=[a-z0-9])[\s@]", re.I)
_SPOKEN_MARK = re.compile(rf"\s++(?:({_ATS})|({_DOTS}))\s++", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])\s++(?:{_DOTS})\s++(?=[0-9])", re.I)
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:plus\s++)?(?:{_DIGITS}|[0-9]++)(?:(?:\s++(?:{_DOTS})\s++|[ .()-]{{1,3}})(?:{_DIGITS}|[0-9]++)(?!\w))+", re.I)
_SPELLED_PART = re.compile(rf"(plus\s++)|({_DIGITS})(?!\w)|\s++({_DOTS})\s++|([ .()-]{{1,3}})|([0-9]++)", re.I)
#: The part of a spoken address from a spoken "at" on; what stands before it is optional.
_SPOKEN_AT = re.compile(rf"\s(?:{_ATS})\s++[a-z0-9-]++(?:\s++(?:{_DOTS})\s|\.[a-z0-9-])", re.I)
_BRACKET_HINT = re.compile(rf"[\[({{<]\s*+(?:{_ATS}|@|{_DOTS}|\.)\s*+[\])}}>]", re.I)
_AT_SET, _DIGIT_SET, _DOT_SET = frozenset(AT_WORDS), frozenset(DIGIT_WORDS), frozenset(DOT_WORDS)
_WORD = re.compile(r"\w+")
#: Everything but the word characters of ASCII becomes a blank.
_ASCII_WORDS = bytes(c if _WORD.match(chr(c)) and c < 128 else 32 for c in range(256))
#: Letters re.I takes for "s" and "i" and lower() does not.
_FOLDED = {ord("ſ"): "s", ord("ı"): "i", ord("İ"): "i"}


def _low(text: str) -> str:
    """Lower case as re.I sees it."""
    return (text if text.isascii() else text.translate(_FOLDED)).lower()


class Tape:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def translate(self) -> Tape:
        self.text = self.text.translate(_TABLE)  # one for one: the ranges stay
        return self

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ranges of the tape, given in order; every new character stands for the whole range it replaces."""
        if not edits:
            return self
        text, starts, ends, done = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[done:s], new]
            starts += self.starts[done:s]
            ends += self.ends[done:s]
            starts += [self.starts[s]] * len(new)
            ends += [self.ends[e - 1]] * len(new)
            done = e
        self.text = "".join(text) + self.text[done:]
        self.starts = starts + self.starts[done:]
        self.ends = ends + self.ends[done:]
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _spoken_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spoken addresses: pieces " dot word", as many as lead to an "at", then the rest from there on.

    From right to left every place learns where an address that starts there ends, so each is looked at once.
    """
    if _SPOKEN_TAIL.search(text) is None:
        return
    places = [m.start() for m in _SPOKEN_PLACE.finditer(text)]
    ends: dict[int, int] = {}
    for at in reversed(places):
        piece = _SPOKEN_PIECE.match(text, at)
        end = ends.get(piece.end()) if piece else None
        if end is None and (tail := _SPOKEN_TAIL.match(text, at)):
            end = tail.end()
        if end is not None:
            ends[at] = end
    free = 0
    for at in places:
        if at >= free and at in ends:
            free = ends[at]
            yield at, free


def _spoken_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for start, end in _spoken_addresses(text):
        for mark in _SPOKEN_MARK.finditer(text, start, end):
            edits.append((*mark.span(), "@" if mark.group(1) else "."))
    return edits


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, run.start(), run.end()))
        if sum(bool(p.group(2)) for p in parts) < LEAST_SPELLED:
            continue
        for k, part in enumerate(parts):
            if part.group(1):
                edits.append((*part.span(), "+"))
            elif part.group(2):
                edits.append((*part.span(), DIGIT_WORDS[_low(part.group(2))]))
            elif part.group(3):
                edits.append((*part.span(), "."))
            elif part.group(4) == " " and parts[k - 1].group(2) and k + 1 < len(parts) and parts[k + 1].group(2):
                edits.append((*part.span(), ""))
    return edits


def _spelled(low: str) -> bool:
    """Whether enough digit words stand among digits and spoken dots, with any marks between them."""
    words = low.encode().translate(_ASCII_WORDS).decode().split() if low.isascii() else _WORD.findall(low)
    if _DIGIT_SET.isdisjoint(words):
        return False
    if sum(map(_DIGIT_SET.__contains__, words)) < LEAST_SPELLED:
        return False
    count = 0
    for word in words:
        if word in _DIGIT_SET:
            count += 1
            if count == LEAST_SPELLED:
                return True
        elif word not in _DOT_SET and not word.isdecimal():
            count = 0
    return False


def _spoken_at(low: str) -> bool:
    """Whether a spoken "at" stands before a word with a "." inside or a spoken dot behind it."""
    words = low.split()
    if _AT_SET.isdisjoint(words):
        return False
    return any("." in b[1:-1] or c in _DOT_SET for a, b, c in zip(words, words[1:], [*words[2:], ""]) if a in _AT_SET)


def disguised(text: str) -> bool:
    """Whether some transducer may change the text; a cheap look that never misses one."""
    if not text.isascii() and not _MAPPED.isdisjoint(set(text)):
        return True
    low = _low(text)
    if _spoken_at(low) and _SPOKEN_AT.search(text):
        return True
    if any(word in low for word in DOT_WORDS) and ("@" in text and _SPOKEN_TAIL.search(text) or _DIGIT_DOT.search(text)):
        return True
    if any(bracket in text for bracket in "[({<") and _BRACKET_HINT.search(text):
        return True
    return _spelled(low)


def normalise(text: str) -> Tape:
    """The tape after all transducers, in order: characters, invisible ones, brackets, spoken marks, digits."""
    tape = Tape(text).translate()
    tape.rewrite([(*m.span(), "") for m in _INVISIBLE.finditer(tape.text)])
    tape.rewrite([(*m.span(), "@" if m.group(1) else ".") for m in _BRACKETED.finditer(tape.text)])
    tape.rewrite(_spelled_edits(tape.text))
    tape.rewrite(_spoken_edits(tape.text))
    return tape.rewrite([(*m.span(), ".") for m in _DIGIT_DOT.finditer(tape.text)])


def all_spans(text: str | None, plain: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Plain spans and the disguised ones, by kind as listed, then by start."""
    plain = plain_spans(text) if plain is None else plain
    if not text or not disguised(text):
        return plain
    tape, found = normalise(text), list(plain)
    for kind in KINDS:
        taken = [(s, e) for k, s, e in plain if k == kind]
        begins = [s for s, _ in taken]
        for s, e in SCANNERS[kind](tape.text):
            start, end = tape.source(s, e)
            if tape.text[s:e] == text[start:end]:
                continue
            at = bisect_right(begins, start)
            if at and taken[at - 1][1] >= end:
                continue
            found.append((kind, start, end))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs, in its own partition: id, plain and spans (arrays of kind, start, end).

    Null and empty texts give empty arrays; a null id stays null; repeated rows are scanned each;
    further columns are ignored.
    """
    span = "array<struct<kind:string,start:int,end:int>>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("kind", "start", "end")
        for batch in batches:
            plain = [plain_spans(text) for text in batch["text"]]
            spans = [all_spans(text, own) for text, own in zip(batch["text"], plain, strict=True)]
            yield pd.DataFrame({"id": batch["id"],
                                "plain": [[dict(zip(names, x, strict=True)) for x in row] for row in plain],
                                "spans": [[dict(zip(names, x, strict=True)) for x in row] for row in spans]})

    found = keyed_text(docs, id_column, text_column).mapInPandas(scan, f"id string, plain {span}, spans {span}")
    return named_id(found, docs, id_column)
