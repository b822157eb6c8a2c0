"""Exact Jaccard join of word n-gram sets, to connected components.

Completeness comes from the pigeonhole principle.  Sizes fall into bands; sets that may link share a tile
of bands, and in a tile two linked sets differ in at most k elements.  The universe of shingle hashes is
cut into k + 1 + spare ranges, so linked sets agree on at least 1 + spare whole ranges; a set's key for a
range is a hash of all it has there.  Empty ranges say nothing and are keyed only by sets with more than
``spare`` of them, which is the one case in which no common range need be filled.

Sets with a common key are a group; groups with the same members are one.  A group is dealt to tiles of
size-banded blocks of bounded weight, in which hashed bitmap signatures bound the overlap from above: sets
differ by at least as much as the xor of their parity bitmaps has bits.  A tile returns a spanning forest
of the pairs the bound leaves, so rows out never exceed rows in, and the components of these forests hold
every link.  They are dealt to tiles again, now with their sorted arrays: what the bitmaps leave is
intersected exactly, unless the two are connected already.

Equal sets are one node, so copies cost nothing after the first pass.  Keys shared by many are salted.
"""
from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import groupby, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.common import (WordHashes, components, hash_words, keyed_text, mixed, named_id, split_words, stored, unused,
                                 window_hashes)

#: Upper ends of the size bands grow by this factor.
BAND_GROWTH = 1.5
#: Shingles, and bitmaps, a block of a tile holds, about; larger sets are blocks of their own.
BLOCK_SHINGLES, BLOCK_BITMAPS = 400_000, 2_000
#: One set in so many looks for keys that are shared by many; a key with this share of them is salted.
SAMPLE, HOT_SHARE, SALTS = 64, 0.001, 32
MOST_BITS = 1 << 16


@cache
def band_starts(limit: int = 1 << 40) -> tuple[int, ...]:
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, math.ceil(starts[-1] * BAND_GROWTH)))
    return tuple(starts)


@cache
def tile_plan(band: int, percent: int) -> tuple[int, int, int]:
    """Of the tile of sets from ``band`` and the larger ones they may link to: its largest size, its ranges, its spare ranges."""
    least, most = band_starts()[band], band_starts()[band + 1] - 1
    differ = most * (100 - percent) // percent
    spare = 0
    while spare < 64:
        parts = differ + 1 + spare
        empty = parts * math.exp(-least / parts)  # expected empty ranges of the smallest set
        if empty ** (spare + 1) / math.factorial(spare + 1) < 1e-4 or parts >= least:
            break
        spare += 1
    return most * 100 // percent, differ + 1 + spare, spare


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; with fewer words, the whole sequence as one."""
    words = split_words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(hash_words(words, hashes), min(size, len(words))))


def identity(elements: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit digests of a set: its node and a check on it."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bitmap(elements: np.ndarray, percent: int) -> np.ndarray:
    """Parity bitmap of a set, with room for the difference two linked sets of its size may have."""
    bits = min(MOST_BITS, 1 << max(8, (8 * (len(elements) * (100 - percent) // percent) + 63).bit_length()))
    odd = np.bincount((mixed(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap the same set has with fewer bits: halves added up modulo two."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def range_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set in each tile it belongs to."""
    n, starts = len(elements), band_starts()
    if not n:
        return np.zeros(0, dtype=np.uint64)
    totals = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(elements), dtype=np.uint64)))
    keys, band = [], bisect_right(starts, n) - 1
    while band >= 0:
        largest, parts, spare = tile_plan(band, percent)
        if n > largest:
            break
        # Alone in its tile a set of one range could only equal others, and equal sets are one node.
        if parts > 1 + spare:
            edges = np.ceil(np.arange(parts + 1) * (2.0 ** 32 / parts)).astype(np.uint64)
            at = np.searchsorted(elements >> np.uint64(32), edges)
            filled = at[1:] > at[:-1]
            values = totals[at[1:]] - totals[at[:-1]]
            salt = np.arange(parts, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64((band + 1) * 0x9FB21C651E98DF25 % 2 ** 64)
            own = mixed(values ^ mixed(salt))
            keys.append(own if parts - int(filled.sum()) > spare else own[filled])
        band -= 1
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def _read_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, size, hashes) for text in batch["text"]]
            names = [identity(s) for s in sets]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in sets],
                                "node": np.array([x for x, _ in names], dtype=np.int64),
                                "check": np.array([x for _, x in names], dtype=np.int64),
                                "bits": [bitmap(s, percent).tobytes() for s in sets]})

    told = keyed_text(docs, "id", "text").mapInPandas(read, "id string, n long, node long, check long, bits binary")
    return named_id(told, docs, "id")


def _read_keys(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            keys, nodes = [], []
            for text in batch["text"]:
                elements = shingles(text, size, hashes)
                node = identity(elements)[0]
                if node in seen:  # copies in one task; those in different tasks meet at the keys
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                own = range_keys(elements, percent)
                keys.append(own)
                nodes.append(np.full(len(own), node, dtype=np.int64))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes)})

    return docs.select("text").mapInPandas(read, "key long, node long")


def _candidate_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (component, node): groups of sets with a common key, one for keys with the same members.

    Keys that hold a large share of a sample are dealt by a salt and are groups of their own.  The sample
    only decides how a key is dealt, never what is compared.  There are at most 1 / HOT_SHARE such
    keys, so they are broadcast.
    """
    keys = _read_keys(docs, size, percent)
    sample = _read_keys(docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), size, percent)
    counts = stored(sample.groupBy("key").count().where("count > 8"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > HOT_SHARE * total).select(F.col("key").alias("hot"))
    salted = keys.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").withColumn(
        "salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)))
    bucket = Window.partitionBy("key", "salt")
    # Two groups whose digests agree by chance are compared together, which loses nothing.
    alike = F.xxhash64(F.bit_xor(F.xxhash64("node")).over(bucket), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30))).over(bucket))
    marked = salted.withColumn("alike", alike).withColumn("others", F.min("node").over(bucket) != F.max("node").over(bucket))
    return stored(marked.where(F.col("others") | F.col("hot").isNotNull()).select(
        F.when(F.col("hot").isNotNull(), F.xxhash64("key", F.lit("hot"))).otherwise(F.col("alike")).alias("component"), "node").distinct())


def _dealt(members: DataFrame, percent: int, weight, block: int) -> DataFrame:
    """Adds tiles: an array of the tiles (strings) each member is compared in.

    A light component is one tile.  A heavy one is cut into size bands, in which a set can link only to
    its own and the neighbouring band, and each band into blocks; any two sets that may link meet in
    exactly one tile.  The table of a component's bands is bounded by the number of bands.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    banded = members.withColumn("band", band)
    blocks = (banded.groupBy("component", "band").agg(F.sum(weight).alias("weight"))
              .groupBy("component").agg(F.sum("weight").alias("total"), F.map_from_entries(F.collect_list(F.struct(
                  "band", F.ceil(F.col("weight") / block).cast("int")))).alias("blocks")))
    joined = banded.join(blocks, "component")
    count = lambda shift: F.coalesce(F.try_element_at("blocks", F.col("band") + shift), F.lit(0))
    own = F.pmod(F.xxhash64("node"), count(0).cast("long")).cast("int")
    joined = joined.withColumn("own", own)
    each = lambda n, tile: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), tile)).otherwise(
        F.array().cast("array<string>"))
    name = lambda s, i, t, j: F.concat_ws(":", F.col("component"), s, i, t, j)
    b, i = F.col("band"), F.col("own")
    within = each(count(0), lambda j: name(b, F.least(i, j), b, F.greatest(i, j)))
    above = each(count(1), lambda j: name(b, i, b + 1, j))
    below = each(count(-1), lambda j: name(b - 1, j, b, i))
    return joined.withColumn("tiles", F.when(F.col("total") <= 2 * block, F.array(F.col("component").cast("string")))
                             .otherwise(F.concat(within, above, below))).select(*members.columns, "tiles")


class _Forest:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def plausible(sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(x, larger partners of x the bitmaps leave), sets given by ascending size.

    overlap <= (|x| + |y| - bits of the xor) / 2, and 100 * overlap >= percent * (|x| + |y| - overlap) is asked for.
    """
    if len(sizes) == 2:
        words = min(map(len, maps))
        a, b = (int.from_bytes(folded(m, words).tobytes(), "little") for m in maps)
        both, apart = int(sizes[0] + sizes[1]), (a ^ b).bit_count()
        if 100 * sizes[0] >= percent * sizes[1] and (100 + percent) * (both - apart) >= 2 * percent * both:
            yield 0, np.array([1])
        return
    words = min(map(len, maps))
    table = np.stack([folded(m, words) for m in maps])
    for x in range(len(sizes)):
        end = int(np.searchsorted(sizes, sizes[x] * 100 // percent, side="right"))
        if end > x + 1:
            apart = np.bitwise_count(table[x + 1:end] ^ table[x]).sum(axis=1, dtype=np.int64)
            both = sizes[x + 1:end] + sizes[x]
            yield x, np.nonzero((100 + percent) * (both - apart) >= 2 * percent * both)[0] + x + 1


def links_of_tile(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sets (positions), bitmaps first, then exact intersections."""
    if len(sets) < 2:
        return
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    forest = _Forest(len(order))
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    for x, others in plausible(sizes, [bitmap(sets[k], percent) for k in order], percent):
        a = sets[order[x]]
        for y in others.tolist():
            if forest.find(x) == forest.find(y):
                continue
            b = sets[order[y]]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                forest.join(x, y)
                yield order[x], order[y]


def _by_tile(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of each tile of a partition sorted by tile."""
    rows = (row for batch in batches for row in zip(batch["tile"], *(batch[c] for c in columns), strict=True))
    for _, group in groupby(rows, key=lambda row: row[0]):
        yield [row[1:] for row in group]


def _edges(found: Iterator[tuple[int, int]], most: int = 10_000) -> Iterator[pd.DataFrame]:
    while out := list(islice(found, most)):
        yield pd.DataFrame(out, columns=["a", "b"])


def _narrowed(members: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component): components of the pairs of a group that the bitmaps leave."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found():
            for rows in _by_tile(batches, ["n", "node", "bits"]):
                rows.sort(key=lambda row: row[:2])
                forest = _Forest(len(rows))
                if len(rows) < 2:
                    continue
                sizes = np.array([row[0] for row in rows], dtype=np.int64)
                for x, others in plausible(sizes, [np.frombuffer(row[2], dtype=np.uint64) for row in rows], percent):
                    for y in others.tolist():
                        if forest.join(x, y):
                            yield int(rows[x][1]), int(rows[y][1])
        yield from _edges(found())

    dealt = _dealt(members, percent, F.lit(1), BLOCK_BITMAPS).select(F.explode("tiles").alias("tile"), "n", "node", "bits")
    return components(dealt.repartition("tile").sortWithinPartitions("tile").mapInPandas(compare, "a long, b long"))


def _verified(docs: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes, a spanning forest of each tile."""
    # The number of members grows with the documents: the same join at every size.
    texts = docs.join(dealt.hint("merge"), "id").select("node", "tiles", "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for node, tiles, text in zip(batch["node"], batch["tiles"], batch["text"], strict=True):
                elements = shingles(text, size, hashes)
                if identity(elements)[0] == node:  # a row that repeats the id with another text is another node
                    yield pd.DataFrame({"tile": list(tiles), "node": node, "elements": [elements.tobytes()] * len(tiles)})

    def gathered(batches):
        frames, rows = [], 0
        for frame in batches:
            frames.append(frame)
            rows += len(frame)
            if rows >= 256:
                yield pd.concat(frames)
                frames, rows = [], 0
        if frames:
            yield pd.concat(frames)

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found():
            for rows in _by_tile(batches, ["node", "elements"]):
                sets = dict(rows)  # a row that repeats an id and a text is there twice
                names = sorted(sets)
                for x, y in links_of_tile([np.frombuffer(sets[k], dtype=np.uint64) for k in names], percent):
                    yield int(names[x]), int(names[y])
        yield from _edges(found())

    filled = texts.mapInPandas(lambda x: gathered(read(x)), "tile string, node long, elements binary")
    return filled.repartition("tile").sortWithinPartitions("tile").mapInPandas(tiles, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A set holds the distinct runs of ``size``
    words, or the whole sequence when it is shorter.  Documents link when 100 * intersection >= percent *
    union; component_id is the smallest id reachable.  Without words the set is empty and links with
    nothing; null texts count as empty.  Rows without an id are compared as well; where none in a
    component has one, component_id is null.  Repeated rows link as equal sets do.  An empty table gives
    no rows; other columns are ignored.
    """
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    sets = stored(_read_sets(given, size, percent))
    filled = sets.where("n > 0")
    nodes = filled.groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.any_value("bits").alias("bits"),
                                       F.min("check").alias("c1"), F.max("check").alias("c2")).where("id is not null")
    twice = F.raise_error(F.lit("two sets share a 64-bit digest"))
    nodes = nodes.withColumn("n", F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(twice.cast("long")))
    groups = _candidate_groups(given, size, percent)
    close = _narrowed(groups.join(nodes, "node").select("component", "node", "n", "bits"), percent)
    members = close.join(nodes, "node").select("id", "node", "component", "n")
    dealt = stored(_dealt(members, percent, F.col("n"), BLOCK_SHINGLES).select("id", "node", "tiles"))
    linked = components(_verified(given, dealt, size, percent))
    labelled = filled.select("id", "n", "node").join(linked, "node", "left").select(
        "id", "n", F.coalesce("component", "node").alias("c"))
    least = labelled.groupBy("c").agg(F.min("id").alias("component_id"))
    return (labelled.join(least, "c").select("id", "n", "component_id")
            .union(sets.where("n = 0").select("id", "n", "id"))
            .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns; rows without an id stay."""
    own = unused(docs, "__id")
    stay = jaccard_components(docs, size, percent, id_column, text_column).where(
        F.col(id_column).eqNullSafe(F.col("component_id")) | F.col(id_column).isNull()).select(F.col(id_column).alias(own))
    kept = docs.join(stay, F.col(id_column).eqNullSafe(F.col(own)), "left_semi")
    # Rows that repeat an id and a text are one document; rows without an id are none of each other.
    named, bare = kept.where(F.col(id_column).isNotNull()), kept.where(F.col(id_column).isNull())
    return named.dropDuplicates([id_column, text_column]).unionByName(bare)
