"""Substring deduplication by matching statistics against suffix automata of reference shards.

Streaming every document past an automaton of every shard would cost the square of the corpus.  So
documents are routed first: every window of 13 words has a minimiser, the 5-word run in it with the
least hash, and equal windows have equal minimisers.  Documents that share a minimiser are routed to the
shard named after the first document that has it, each with the stretches of its text around such
minimisers and nothing else.  Two documents with a common window therefore meet in a shard.

A shard streams its documents in the order of their ids past its automaton, reads the length of the
longest match ending at every word, removes stretches of matched windows, and then adds to the automaton
what the document has that is new.  An automaton so grows with distinct content, not with copies.

A shard with much text is split: documents are dealt by a salt, and each part finds what is new to it.
Windows that only one part has are then settled.  Those that several parts have, at most once a part, are
dealt by their hash to reference automata of their own, and streamed past them in the order of ids.  What
a document has around a shared passage but with no other part in common never leaves its part, so no
task gathers a hot group's documents or their texts.

A row is named by its id and a hash of its text, so rows that repeat an id have stretches of their own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.common import WordHashes, hash_words, named_id, split_words, stored, window_hashes

#: Words of a minimiser at most.
ANCHOR = 5
#: Minimisers routed to one part of a shard, about.
PART = 100_000
#: One document in so many looks for minimisers that are shared by many; they need no further proof of being shared.
SAMPLE, HOT, HOT_KEYS, SALTS = 64, 16, 20_000, 32
#: Reference automata of a shard in several parts.
BUCKETS = 4_096


class Automaton:
    """Suffix automaton over word hashes, of several texts; knows the first owner of every substring."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.owner.append(self.owner[state])
        new = len(self.link) - 1
        self.link[state] = new
        return new

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def add(self, words: list[int], owner) -> None:
        """Add a text; texts come in the order of their owners."""
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            there = nexts[last].get(word)
            if there is not None:
                if length[there] == length[last] + 1:
                    last = there
                else:
                    new = self._clone(there, length[last] + 1)
                    self._redirect(last, word, there, new)
                    last = new
                continue
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            self.owner.append(owner)
            new, state = len(link) - 1, last
            while state >= 0 and word not in nexts[state]:
                nexts[state][word] = new
                state = link[state]
            if state >= 0:
                there = nexts[state][word]
                if length[there] == length[state] + 1:
                    link[new] = there
                else:
                    copy = self._clone(there, length[state] + 1)
                    self._redirect(state, word, there, copy)
                    link[new] = copy
            last = new

    def matched(self, words: list[int], window: int, before=None) -> list[int]:
        """Ends (exclusive) of windows that occur in a text of an owner below ``before`` (None: any owner)."""
        nexts, link, length, owner = self.next, self.link, self.length, self.owner
        state, size, ends = 0, 0, []
        for k, word in enumerate(words, 1):
            there = nexts[state].get(word)
            while there is None and state:
                state = link[state]
                size = length[state]
                there = nexts[state].get(word)
            if there is None:
                continue
            state = there
            size += 1
            if size >= window:
                # Only the last words count: the state whose longest suffix link is too short for a window.
                while length[link[state]] >= window:
                    state = link[state]
                    size = length[state]
                if before is None or owner[state] < before:
                    ends.append(k)
        return ends


def spans_of(ends: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows with these ends, ascending."""
    spans: list[tuple[int, int]] = []
    for end in ends:
        if spans and end - window <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((end - window, end))
    return spans


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window its minimiser: (key of each window, start of each window's minimiser)."""
    size = min(ANCHOR, window)
    runs = window_hashes(words, size)
    width = window - size + 1
    n = len(runs) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # The least of each stretch of ``width`` values, by doubling; equal hashes are equal keys, so ties do no harm.
    least, span = runs, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span:width - span + n]), np.arange(n)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            keys, counts = [], []
            for text in batch["text"]:
                own = np.unique(anchors(hash_words(split_words(text), hashes), window)[0])
                keys.append(own)
                counts.append(len(own))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64),
                                    **{c: np.repeat(batch[c].to_numpy(), counts) for c in ("id", "t")}})

    return docs.mapInPandas(read, "key long, id long, t long")


def _routes(docs: DataFrame, window: int) -> DataFrame:
    """Rows (id, t, routes): for each document its minimisers that others have too, with shard and parts.

    A minimiser names its shard after its first document.  One that holds a large share of a sample is
    shared for certain; it names the shard after its first sampled document and is dealt by a salt.  There
    are at most HOT_KEYS such minimisers, so they are broadcast.
    """
    rows = _anchor_rows(docs, window)
    seen = _anchor_rows(docs.where(F.pmod(F.xxhash64("id", "t"), F.lit(SAMPLE)) == 0), window)
    counts = stored(seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("named")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where((F.col("n") >= HOT) & (F.col("n") > total / HOT_KEYS)).select(F.col("key").alias("hot"), "named")
    marked = rows.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").withColumn(
        "salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "t"), F.lit(SALTS))))
    order = Window.partitionBy("key", "salt").orderBy("id", "t")
    routed = (marked.withColumn("first", F.first("id").over(order)).withColumn("next", F.lead("id").over(order))
              .withColumn("shard", F.coalesce("named", "first"))
              .where((F.col("id") != F.col("shard")) | F.col("next").isNotNull() | F.col("hot").isNotNull()))
    shared = stored(routed.select("id", "t", "key", "shard"))
    # Few shards have several parts; their rows meet that number by salt, so that no task gathers a shard.
    load = shared.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("many")).where("many > 1").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = shared.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("long"))
    return salted.join(load, ["shard", "salt"], "left").withColumn("parts", F.coalesce("many", F.lit(1))).groupBy("id", "t").agg(
        F.collect_set(F.struct("key", "shard", "parts")).alias("routes"))


def _stretches(docs: DataFrame, routes: DataFrame, window: int) -> DataFrame:
    """Rows (shard, parts, id, t, start, words): the text around the shared minimisers of a document, by shard."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for row, t, text, own in zip(batch["id"], batch["t"], batch["text"], batch["routes"], strict=True):
                words = hash_words(split_words(text), hashes)
                keys = anchors(words, window)[0].view(np.int64)
                wanted = np.array([x["key"] for x in own], dtype=np.int64)
                shards = np.array([x["shard"] for x in own], dtype=np.int64)
                parts = dict(zip(shards.tolist(), (x["parts"] for x in own), strict=True))
                order = np.argsort(wanted)
                wanted, shards = wanted[order], shards[order]
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                routed = wanted[at] == keys
                starts = np.nonzero(routed)[0]
                if not len(starts):
                    continue
                to = shards[at[starts]]
                by = np.argsort(to, kind="stable")
                starts, to = starts[by], to[by]
                # Windows of one shard whose words touch or overlap are one stretch.
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (to[1:] != to[:-1]) | (starts[1:] > starts[:-1] + 1)
                first = np.nonzero(new)[0]
                last = np.append(first[1:], len(starts)) - 1
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    s, e = int(starts[a]), int(starts[b]) + window
                    out.append((int(to[a]), parts[int(to[a])], row, t, s, words[s:e].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["shard", "parts", "id", "t", "start", "words"])

    return docs.join(routes, ["id", "t"]).select("id", "t", "text", "routes").mapInPandas(
        cut, "shard long, parts int, id long, t long, start int, words binary")


def _stream(rows, window: int):
    """Stream (id, t, start, words) in the order of ids past a growing automaton.

    Yields (id, t, start, end, words): a removed span without words, or new content with its words.
    """
    grown = Automaton()
    waiting, current = [], None
    for row, t, start, packed in rows:
        words = np.frombuffer(packed, dtype=np.uint64).tolist()
        if row != current:  # rows that repeat an id are no references for each other
            for text in waiting:
                grown.add(text, current)
            waiting, current = [], row
        ends = grown.matched(words, window)
        for s, e in spans_of(ends, window):
            yield row, t, start + s, start + e, None
        old = set(ends)
        for s, e in spans_of([k for k in range(window, len(words) + 1) if k not in old], window):
            waiting.append(words[s:e])
            yield row, t, start + s, start + e, packed[8 * s:8 * e]


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]):
    """(key, rows) of a partition sorted by key; rows are tuples (id, t, start, words) and are read as they come."""
    def rows():
        for batch in batches:
            yield from zip(*(batch[k] for k in keys), batch["id"], batch["t"], batch["start"], batch["words"], strict=True)

    for key, group in groupby(rows(), key=lambda x: x[:len(keys)]):
        yield key, (x[len(keys):] for x in group)


def _collected(rows, columns, most=20_000):
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


SPAN = "id long, t long, start int, end int"


def removed_spans(docs: DataFrame, window: int) -> DataFrame:
    """Rows (id, t, start, end) in words: stretches of windows that a document with a smaller id has too.

    docs has rows (id, t, text); t tells the texts of an id apart.
    """
    stretches = _stretches(docs, _routes(docs, window), window)
    dealt = stretches.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.col("parts").cast("long")).cast("int"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for (shard, parts, salt), group in _grouped(batches, ["shard", "parts", "salt"]):
                for row, t, start, end, words in _stream(group, window):
                    if words is None or parts > 1:
                        yield shard, salt, row, t, start, end, words
        yield from _collected(rows(), ["shard", "salt", "id", "t", "start", "end", "words"])

    parted = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "parts", "salt", "id", "t", "start")
    first = stored(parted.mapInPandas(local, f"shard long, salt int, {SPAN}, words binary"))
    done = first.where("words is null").select("id", "t", "start", "end")
    # What a part found new is all that may still be matched in another part.
    return done.union(_between_parts(first.where("words is not null").select("shard", "salt", "id", "t", "start", "words"), window))


def _between_parts(fresh: DataFrame, window: int) -> DataFrame:
    """Spans among the new content of parts of one shard."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [window_hashes(np.frombuffer(x, dtype=np.uint64), window) for x in batch["words"]]
            counts = [len(x) for x in runs]
            if sum(counts):
                names = ["shard", "salt", "id", "t", "start"]
                yield pd.DataFrame({c: np.repeat(batch[c].to_numpy(), counts) for c in names} | {
                    "at": np.concatenate([np.arange(n) for n in counts]), "hash": np.concatenate(runs).view(np.int64)})

    windows = stored(fresh.mapInPandas(hashed, "shard long, salt int, id long, t long, start int, at int, hash long"))
    common = windows.groupBy("shard", "hash").agg(F.min("salt").alias("low"), F.max("salt").alias("high")).where("low < high")
    row = ["shard", "id", "t", "start"]
    held = windows.join(common.select("shard", "hash"), ["shard", "hash"], "left_semi").groupBy(*row).agg(F.collect_set("at").alias("at"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for shard, i, t, start, words, at in zip(*(batch[c] for c in row), batch["words"], batch["at"], strict=True):
                    hashes = window_hashes(np.frombuffer(words, dtype=np.uint64), window) % np.uint64(BUCKETS)
                    for k in at:
                        yield shard, int(hashes[k]), i, t, start + k, words[8 * k:8 * (k + window)]
        yield from _collected(rows(), ["shard", "bucket", "id", "t", "start", "words"])

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for _, group in _grouped(batches, ["shard", "bucket"]):
                for row, t, start, end, words in _stream(group, window):
                    if words is None:
                        yield row, t, start, end
        yield from _collected(rows(), ["id", "t", "start", "end"])

    asked = fresh.drop("salt").join(held, row).mapInPandas(cut, "shard long, bucket int, id long, t long, start int, words binary")
    return asked.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "id", "t", "start").mapInPandas(against, SPAN)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def substring_dedup(docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text",
                    emit_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, spans (array of start, end in words), kept_text, kept_sha256.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes when some ``window`` consecutive words around it also
    occur in a document with a smaller id, judged on the input.  Null texts have no words.  Rows without an
    id, or with a text shorter than the window, keep all; rows that repeat an id do not match each other,
    and each loses what smaller ids have.  Ids are integers.  An empty table gives no rows; other columns are
    ignored.
    """
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    whole = given.where("id is not null").withColumn("t", F.xxhash64("text"))
    spans = removed_spans(whole, window).groupBy("id", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, gone, kept, taken = [], [], [], []
            for text, own in zip(batch["text"], batch["spans"], strict=True):
                words = split_words(text)
                merged = _merged((x["start"], x["end"]) for x in own) if own is not None else []
                n.append(len(words))
                gone.append(sum(e - s for s, e in merged))
                taken.append([{"start": s, "end": e} for s, e in merged])
                for s, e in reversed(merged):
                    del words[s:e]
                kept.append(b" ".join(words))
            out = {"id": batch["id"], "n_words": n, "n_removed": gone, "spans": taken}
            if emit_text:
                out["kept_text"] = [x.decode("utf-8", "surrogatepass") for x in kept]
            yield pd.DataFrame(out | {"kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]})

    joined = whole.join(spans, ["id", "t"], "left").select(F.col("id").cast("string").alias("id"), "text", "spans").union(
        given.where("id is null").select(F.lit(None).cast("string"), "text", F.lit(None)))
    told = "id string, n_words long, n_removed long, spans array<struct<start:int,end:int>>"
    return named_id(joined.mapInPandas(cut, told + ", kept_text string" * emit_text + ", kept_sha256 string"), docs, id_column)
