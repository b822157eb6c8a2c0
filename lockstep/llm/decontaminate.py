"""Benchmark decontamination by templates.

Words are stripped of punctuation and lower-cased; numbers, units after a number and names become typed
placeholders.  A number with a unit glued to it counts as two words.  What is a name, or a glued number, is
read in two ways, and windows of both count: strictly (capitalised inside a sentence; glued ones literal) and
openly (any capitalised word that is no function word, at a sentence start as well; glued ones placeholders).
Windows of templates are hashed on both sides and joined
by hash; the joined windows are compared template by template, and then their slots: along one alignment
of a document with an item, equal values of the item have to stand for equal values of the document.
So a question with other numbers or names is caught and a chance match of unlike fillings is not.
Windows also count with their plain words, so a copy in other case is a copy, and templates with few
literal words, which say little, are not used.

Documents emit only windows whose hash is in a bitmap of the benchmark's hashes.  The bitmap has a fixed
size, so its broadcast is bounded for a benchmark of any size; what it lets through too much falls out
of the join.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import split_words, stored, unused, window_hashes

WINDOW = 13
#: Bits of the bitmap: 2 MB.
BITS = 1 << 24
#: Words of short texts that go through the arrays together.
TOGETHER = 1 << 15
#: Windows a worker gathers before it hands them on.
HANDED_ON = 10_000

# --- Fixed values -----------------------------------------------------------------------------------
UNITS = frozenset("""
mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres
kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
ml cl l litre litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent degrees celsius
fahrenheit kelvin hz khz mhz ghz w kw mw v kv a j kj kwh n pa kpa bar kmh mph
""".split())
#: Words that are no names when they are capitalised; words that also are names are left out.
FUNCTION_WORDS = frozenset("""
a the this that these those each every some any all both no if when while where what which who whose whom why how then there
here he she it we you they i his her its our your their is are was were be been do does did has have had for from to of on at
in by with after before during since because and or but so as than not only suppose assume consider calculate compute find
der die das ein eine wenn wann wie was wer wo warum und oder aber er sie wir ihr ist sind hat haben
le la les une quand comment pourquoi qui que quel quelle combien et ou mais il elle nous vous ils elles est sont
el los las cuando como donde quien cual cuanto cuantos y pero nosotros ellos ellas es son
""".split())
PUNCTUATION = b"\"'`.,;:!?()[]{}<>"
# ----------------------------------------------------------------------------------------------------
_GLUED = re.compile(rb"([+-]?[$]?[0-9][0-9.,/:]*)([A-Za-z]+)\Z")
_ORDINAL = re.compile(rb"[0-9][0-9,]*(?:st|nd|rd|th)\Z", re.I)
_NUMBER = re.compile(rb"[+-]?[$]?[0-9][0-9.,/:]*%?\Z")

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
SIGNS = ("", "<number>", "<unit>", "<name>")
_SIGN_HASHES = np.array([0, *(xxhash.xxh3_64_intdigest(s.encode()) for s in SIGNS[1:])], dtype=np.uint64)
_TEMPLATE = np.uint64(xxhash.xxh3_64_intdigest(b"a window's template"))


#: First bytes of a number, an ordinal, or a number with a unit glued to it.
_STARTS = b"+-$0123456789"
_UNITS, _FUNCTION_WORDS = (frozenset(w.encode() for w in words) for words in (UNITS, FUNCTION_WORDS))
#: Stands behind each text of several in a row; no text has an empty word.
APART = b""


class Lexicon(dict):
    """Word (bytes) -> row of the arrays: hash of the bare word, and what a template needs to know of it."""

    def __init__(self):
        self.clear()

    def clear(self):
        super().clear()
        self.hash = np.zeros(1 << 12, dtype=np.uint64)
        # 1 number, 2 unit word, 4 capitalised, 8 ends a sentence, 16 function word, 32 ordinal, 64 number and unit in one
        self.flags = np.zeros(1 << 12, dtype=np.uint8)
        # Row 0: a text begins behind it like a sentence.
        self[APART] = 0
        self.flags[0] = 8

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.hash):
            self.hash = np.concatenate((self.hash, np.zeros_like(self.hash)))
            self.flags = np.concatenate((self.flags, np.zeros_like(self.flags)))
        bare = word.strip(PUNCTUATION)
        if bare.isascii():
            low, flags = bare.lower(), 4 * bare[:1].isupper()
        else:
            text = bare.decode("utf-8", "replace")
            low, flags = text.lower().encode(), 4 * text[:1].isupper()
        if bare is not word:
            flags += 8 * (word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":"))
        if bare[:1] in _STARTS:
            flags += bool(_NUMBER.match(bare)) + 32 * bool(_ORDINAL.match(bare)) + 64 * (_glued(word) is not None)
        self.hash[row] = xxhash.xxh3_64_intdigest(low)
        self.flags[row] = flags + 2 * (low in _UNITS) + 16 * (low in _FUNCTION_WORDS)
        self[word] = row
        return row


def _glued(word: bytes) -> tuple[bytes, bytes] | None:
    """The number with what stands before it and the unit with what stands behind it."""
    bare = word.strip(PUNCTUATION)
    found = _GLUED.match(bare) if bare[-1:].isalpha() else None
    if not found or found.group(2).lower().decode() not in UNITS:
        return None
    at = word.index(bare) + found.end(1)
    return word[:at], word[at:]


def looked_up(words: list[bytes], lexicon: Lexicon) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words, a number and a unit glued to it as two, their rows in the lexicon, and which words come from such a split."""
    if len(lexicon) > 400_000:
        lexicon.clear()
    rows = np.fromiter(map(lexicon.__getitem__, words), dtype=np.int64, count=len(words))
    both = np.nonzero(lexicon.flags[rows] & 64)[0]
    if not len(both):
        return words, rows, np.zeros(len(words), dtype=bool)
    out, done = [], 0
    for k in both.tolist():
        out += words[done:k]
        out += _glued(words[k])
        done = k + 1
    out += words[done:]
    first = both + np.arange(len(both))
    rows = np.insert(rows, both, 0)
    marks = np.zeros(len(out), dtype=bool)
    for k in first.tolist():
        rows[k], rows[k + 1] = lexicon[out[k]], lexicon[out[k + 1]]
        marks[k] = marks[k + 1] = True
    return out, rows, marks


def templates(rows: np.ndarray, glued: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its kind read strictly, its kind read openly, the hash of the bare word."""
    bare, flags = lexicon.hash[rows], lexicon.flags[rows]
    number = (flags & 1) > 0
    kind = (number & ~glued).astype(np.int8)  # NUMBER or LITERAL
    kind[1:][((flags[1:] & 2) > 0) & number[:-1] & ~glued[1:]] = UNIT
    open_kind = ((flags & 33) > 0).astype(np.int8)
    open_kind[1:][((flags[1:] & 2) > 0) & number[:-1]] = UNIT
    kind[1:][((flags[1:] & 4) > 0) & ((flags[:-1] & 8) == 0) & (kind[1:] == LITERAL) & ~glued[1:]] = NAME
    open_kind[((flags & 20) == 4) & (open_kind == LITERAL)] = NAME
    return kind, open_kind, bare


#: Readings a window belongs to, as bits.
STRICT, OPEN = 1, 2


def windows(rows: np.ndarray, read: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, readings) of windows, given the words' rows and templates; fewer words than a window make none.

    Every window counts with its words, and with its templates, one or two, if they have placeholders and at
    least half their words are literal.  None goes over the end of a text.
    """
    kind, open_kind, bare = read
    if len(rows) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sums = lambda marks: (total := np.concatenate(([0], np.cumsum(marks, dtype=np.int32))))[size:] - total[:-size]
    within = sums(rows == 0) == 0
    starts = [np.nonzero(within)[0]]
    own = [window_hashes(bare, size)[starts[0]]]
    readings = [np.full(len(own[0]), STRICT | OPEN)]
    differ = sums(kind != open_kind) > 0
    for reading, its in ((STRICT, kind), (OPEN, open_kind)):
        literal = sums(its == LITERAL)
        told = within & (literal < size) & (2 * literal >= size)
        told = np.nonzero(told & differ if reading == OPEN else told)[0]
        if len(told):
            canonical = np.where(its == LITERAL, bare, _SIGN_HASHES[its])
            own.append(window_hashes(canonical, size)[told] ^ _TEMPLATE)
            starts.append(told)
            readings.append(np.where(differ[told], reading, STRICT | OPEN))
    return np.concatenate(starts), np.concatenate(own).view(np.int64), np.concatenate(readings)


def _kind_of(reading: int, read: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The kinds by which a window of these readings is compared."""
    return read[1 if reading == OPEN else 0]


_ROWS = "hash long, size int, at int, reading int, kinds array<int>, words array<string>"


def _row(own: list[bytes], kind: np.ndarray, at: int, size: int) -> tuple[list[int], list[str]]:
    return kind[at:at + size].tolist(), [w.strip(PUNCTUATION).decode("utf-8", "replace").lower() for w in own[at:at + size]]


def _benchmark_windows(items: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """All windows of the items; an item of fewer words is one window of its own size."""
    kind_of = items.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for batch in batches:
            out = []
            for item, text in zip(batch["id"], batch["text"], strict=True):
                words, rows, glued = looked_up(split_words(text), lexicon)
                if not words:
                    continue
                own, read = min(size, len(words)), templates(rows, glued, lexicon)
                out += [(item, int(h), own, int(at), int(r), *_row(words, _kind_of(r, read), at, own)) for at, h, r in zip(*windows(rows, read, own), strict=True)]
            if out:
                yield pd.DataFrame(out, columns=["item", "hash", "size", "at", "reading", "kinds", "words"])

    given = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return given.mapInPandas(cut, f"item {kind_of}, {_ROWS}")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which of BITS values the hashes take: rows of a fixed number, collected."""
    slot = F.pmod("hash", F.lit(BITS)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(BITS, dtype=bool)
    for row in parts:
        own = np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little")
        start = (row["part"] - 1) * len(own)
        bits[start:start + len(own)] = own[:BITS - start]
    return np.packbits(bits, bitorder="little")


def _hits(ids: list, words: list[bytes], sizes: list[int], bits: np.ndarray, lexicon: Lexicon) -> Iterator[tuple]:
    """Rows of the windows that are in the bitmap, for texts in a row, each with APART behind it."""
    words, rows, glued = looked_up(words, lexicon)
    read, ends = templates(rows, glued, lexicon), np.nonzero(rows == 0)[0]
    begins = np.concatenate(([0], ends[:-1] + 1))
    for size in sizes:
        starts, hashes, readings = windows(rows, read, size)
        slot = hashes & (BITS - 1)
        hit = np.nonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)[0]
        starts, hashes, readings = starts[hit], hashes[hit], readings[hit]
        text = np.searchsorted(ends, starts)
        for k, h, at, r, own in zip(text.tolist(), hashes.tolist(), starts.tolist(), readings.tolist(), (starts - begins[text]).tolist(), strict=True):
            yield (ids[k], h, size, own, r, *_row(words, _kind_of(r, read), at, size))


def _probe(batches: Iterator[pd.DataFrame], sizes: list[int], bits: np.ndarray) -> Iterator[pd.DataFrame]:
    """The windows of whole texts that are in the bitmap; short texts go through the arrays together."""
    lexicon, columns = Lexicon(), ["doc", "hash", "size", "at", "reading", "kinds", "words"]
    for batch in batches:
        out, ids, words, last = [], [], [], len(batch) - 1
        for k, (doc, text) in enumerate(zip(batch["id"], batch["text"], strict=True)):
            ids.append(doc)
            words += split_words(text)
            words.append(APART)
            if len(words) >= TOGETHER or k == last:
                for row in _hits(ids, words, sizes, bits, lexicon):
                    out.append(row)
                    if len(out) >= HANDED_ON:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                ids, words = [], []
        if out:
            yield pd.DataFrame(out, columns=columns)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, item, n_windows, kind): documents with a window of a benchmark item, kind "copy" or "reparameterised".

    An item shorter than the window counts as one window of its own length.  Null and empty texts on
    either side, and rows without an id, match nothing.  Repeated rows and repeated items give one row
    for each pair of ids.  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bench = stored(_benchmark_windows(items.where(F.col(item_column).isNotNull()), item_column, item_text, window))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most ``window`` of them
    bitmap = spark.sparkContext.broadcast(_bitmap(bench))
    kind_of = docs.schema[id_column].dataType.simpleString()

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _probe(batches, sizes, bitmap.value)

    given = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = given.mapInPandas(probe, f"doc {kind_of}, {_ROWS}")
    d, b = found.alias("d"), bench.alias("b")
    same = F.col("d.kinds") == F.col("b.kinds")
    slots = F.filter(F.arrays_zip(F.col("b.kinds").alias("kind"), F.col("b.words").alias("theirs"), F.col("d.words").alias("ours")), lambda x: x["kind"] != LITERAL)
    literals = lambda side: F.filter(F.arrays_zip(F.col(f"{side}.kinds").alias("kind"), F.col(f"{side}.words").alias("word")), lambda x: x["kind"] == LITERAL)
    copy = F.col("d.words") == F.col("b.words")
    joined = d.join(b, (F.col("d.hash") == F.col("b.hash")) & (F.col("d.size") == F.col("b.size"))).where(
        copy | (same & (literals("d") == literals("b"))))
    aligned = joined.select("doc", "item", (F.col("d.at") - F.col("b.at")).alias("shift"), F.col("b.at").alias("at"),
                            F.col("d.reading").bitwiseAND(F.col("b.reading")).alias("reading"), copy.alias("copy"), slots.alias("slots"))
    # The slots have to fit within one reading or across both.  One alignment has at most as many slots as twice the item's words.
    ways = {"strict": F.col("reading").bitwiseAND(STRICT) > 0, "open": F.col("reading").bitwiseAND(OPEN) > 0, "any": F.lit(True)}
    told = aligned.groupBy("doc", "item", "shift").agg(F.max("copy").alias("copy"), *(column for way, of in ways.items() for column in (
        F.count_distinct(F.when(of, F.col("at"))).alias(f"n_{way}"),
        F.array_distinct(F.flatten(F.collect_set(F.when(of, F.col("slots"))))).alias(f"pairs_{way}"))))
    fits = lambda way: F.size(f"pairs_{way}") == F.size(F.array_distinct(F.transform(f"pairs_{way}", lambda x: F.struct(x["kind"], x["theirs"]))))
    n = F.greatest(*(F.when(F.col("copy") | fits(way) if way == "any" else fits(way), F.col(f"n_{way}")).otherwise(0) for way in ways))
    kept = told.withColumn("n", n).where("n > 0")
    return kept.groupBy(F.col("doc").alias(id_column), F.col("item").alias(item_column)).agg(
        F.sum("n").alias("n_windows"), F.when(F.max("copy"), "copy").otherwise("reparameterised").alias("kind"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents without a benchmark window, with all their columns; rows without an id stay."""
    own = unused(docs, "__id")
    dirty = contaminated(docs, items, window, id_column, text_column).select(F.col(id_column).alias(own)).distinct()
    return docs.join(dirty, F.col(id_column) == F.col(own), "left_anti")
