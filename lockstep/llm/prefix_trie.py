"""Prefix trie of conversations by a skeleton of splitter paths.

A conversation is a path: one 16-byte digest of (role, text) a turn.  Paths are dealt to shards by ranges
of (path, conversation id), so a prefix lies in one shard unless a splitter between two shards starts with
it.  The trie of the splitters, the skeleton, therefore holds every node that more than one shard can see.
It is broadcast.  A shard streams its sorted conversations once with a stack of open nodes and finishes all
nodes outside the skeleton; for skeleton nodes it emits partial aggregates, which a keyed reduction combines.

Splitters come from a sample and are cut after the first turn that tells them from the path before them in
it, as separators of a B-tree are.  Only copies of one path need a whole path and an id, so a path that many
conversations share is split among shards like any other stretch of the order.  Size bound of skeleton and
broadcast: splitters are thinned until their paths take SKELETON_BYTES at most.  The sample decides where
shards end, never which nodes there are.

Ids that end at a skeleton node travel as digits in pieces of PIECE bytes; a task reads the pieces of one
node in order and feeds them to its digest, which by definition has to see them one after another.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import stored

#: Bytes of a turn's digest in a path.
WIDE = 16
#: Conversations in a shard, about; shards at most; sampled conversations a splitter; bytes of all sampled paths, about, and of all splitters.
SHARD, MOST_SHARDS, LOOKS, SAMPLE_BYTES, SKELETON_BYTES = 50_000, 8_192, 8, 64 << 20, 4 << 20
#: Bytes of ids in a row of a skeleton node.
PIECE = 1 << 20
LEAST_ID = -(1 << 63)
ROOT = 0

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_paths(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (array of digest and size in code points), in order.

    Null roles and texts count as empty.  Turns go by ``order``, nulls first; ties by the digest.  Repeated
    rows are turns of their own.  Rows without a conversation id belong to none and are left out.  Ids are
    integers.  Only digests are shuffled; a conversation takes 20 bytes a turn and has to fit a row.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(who), F.lit(":"), who, said), 256)), 1, WIDE)
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(order).alias("at"), digest.alias("digest"), F.length(said).alias("size"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "size"))).alias("turns"))
    return told.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def _packed(paths: DataFrame) -> DataFrame:
    """Rows (conv_id, path binary, sizes array)."""
    digits = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")
    return paths.select("conv_id", F.unhex(digits).alias("path"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // WIDE
    if a[:high * WIDE] == b[:high * WIDE]:
        return high
    while low + 1 < high:  # the first low turns agree, the first high do not
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * WIDE] == b[:mid * WIDE] else (low, mid)
    return low


def choose_splitters(sample: list[tuple[bytes, int]], shards: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 ascending (path, id) splitters from a sorted sample; a row's shard is the count of those not above it."""
    out = []
    for k in range(1, shards):
        at = k * len(sample) // shards
        if at == 0:
            continue
        (before, _), (path, row) = sample[at - 1], sample[at]
        split = (path, row) if path == before else (path[:WIDE * (_common(before, path) + 1)], LEAST_ID)
        if not out or split > out[-1]:
            out.append(split)
    while sum(len(path) for path, _ in out) > most_bytes:
        out = out[1::2]
    return out


def skeleton_of(splitters: list[tuple[bytes, int]]) -> dict[tuple[int, bytes], int]:
    """Nodes of all splitter paths below the root: (parent's number, digest of the turn) -> number, above the parent's."""
    nodes: dict[tuple[int, bytes], int] = {}
    for path, _ in splitters:
        at = ROOT
        for k in range(0, len(path), WIDE):
            at = nodes.setdefault((at, path[k:k + WIDE]), len(nodes) + 1)
    return nodes


class _Node:
    __slots__ = ("size", "number", "least", "n", "children", "leaves", "saved", "ends", "waiting", "pieces")

    def __init__(self, size: int, number: int | None):
        self.size, self.number, self.least, self.n = size, number, None, 0
        self.children, self.leaves, self.saved, self.ends, self.waiting, self.pieces = 0, 0, 0, None, [], 0


def _shard_rows(rows: Iterator[tuple], skeleton: dict[tuple[int, bytes], int]) -> Iterator[tuple]:
    """Finished nodes and parts of skeleton nodes of one shard, whose rows (path, sizes, id) come sorted by path and id.

    Rows out: (skeleton number or None, piece, ids, size of the last turn, parent's skeleton number or None,
    *NODE).  A finished node waits for its parent's smallest member, so what is held is the stack and the
    children of open nodes.
    """
    stack = [_Node(0, ROOT)]
    out: list[tuple] = []

    def close():
        depth = len(stack) - 1
        node = stack.pop()
        for least, *rest in node.waiting:
            above, parent = (None, node.least) if node.number is None else (node.number, None)
            out.append((None, 0, None, None, above, least, depth + 1, parent, *rest))
        above = stack[-1] if stack else None
        if above is not None:
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.n += node.n
        if node.number is not None:  # its share of leaves and tokens goes up in the reduction
            out.append((node.number, node.pieces, ",".join(node.ends or []), node.size, None, node.least, depth, None,
                        node.n, node.children, node.leaves, node.saved, None))
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        digest = (node.ends or hashlib.sha256()).hexdigest()
        above.waiting.append((node.least, node.n, node.children, leaves, saved, digest))

    last = b""
    for path, sizes, row in rows:
        shared = _common(last, path)
        while len(stack) - 1 > shared:
            close()
        for d in range(shared, len(path) // WIDE):
            above = stack[-1].number
            turn = path[WIDE * d:WIDE * (d + 1)]
            stack.append(_Node(int(sizes[d]), None if above is None else skeleton.get((above, turn))))
        last, node = path, stack[-1]
        node.n += 1
        node.least = row if node.least is None else min(node.least, row)
        if node.number is not None:
            node.ends = node.ends or []
            node.ends.append(str(row))
            if len(node.ends) * 8 >= PIECE:
                out.append((node.number, node.pieces, ",".join(node.ends), node.size, None, None, None, None, 0, 0, 0, 0, None))
                node.ends, node.pieces = None, node.pieces + 1
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % row)
        else:
            node.ends.update(b",%d" % row)
        if out:
            yield from out
            out.clear()
    while stack:
        close()
    yield from out


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 20_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def _finish(parts: DataFrame, skeleton: dict[tuple[int, bytes], int]) -> DataFrame:
    """Skeleton nodes as rows (number, *NODE without digest): parts summed by node, shares added up towards the root."""
    summed = parts.groupBy("number").agg(
        F.min("conv_id").alias("least"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.sum("n_convs").alias("n"),
        F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    nodes = {r["number"]: r.asDict() for r in summed.collect()}  # the skeleton: bounded by SKELETON_BYTES / WIDE
    above = {number: parent for (parent, _), number in skeleton.items()}
    for number in sorted(nodes, reverse=True):  # children before parents
        node = nodes[number]
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * node["size"]
        if number != ROOT:
            parent = nodes[above[number]]
            parent["children"] += 1
            parent["leaves"] += node["leaves"]
            parent["saved"] += node["saved"]
    rows = [(number, x["least"], x["depth"], None if number == ROOT else nodes[above[number]]["least"],
             x["n"], x["children"], x["leaves"], x["saved"]) for number, x in nodes.items()]
    return parts.sparkSession.createDataFrame(rows, "number long, " + NODE.removesuffix(", ends_sha256 string"))


def _ends_digests(parts: DataFrame) -> DataFrame:
    """Rows (number, ends_sha256): the ids of a node, in the order of shards and pieces, through one digest."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["number"], batch["ids"], strict=True)

        def digests():
            for number, group in groupby(rows(), key=lambda x: x[0]):
                digest, first = hashlib.sha256(), True
                for _, ids in group:
                    if ids:
                        digest.update(ids.encode() if first else b"," + ids.encode())
                        first = False
                yield number, digest.hexdigest()

        yield from _frames(digests(), ["number", "ends_sha256"])

    return (parts.select("number", "shard", "piece", "ids").repartition("number").sortWithinPartitions("number", "shard", "piece")
            .select("number", "ids").mapInPandas(read, "number long, ends_sha256 string"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie over rows (conv_id, turns) as ``turn_paths`` gives them; columns as in NODE.

    Every distinct sequence of first d turns is a node of depth d, from the root (d = 0); conversations that
    start with it are its members, also those without turns (at the root).  conv_id is the smallest member,
    parent_conv_id the parent's (root: null), n_children its children, n_leaves the childless nodes in its
    subtree, saved_tokens the sum over its subtree of (members - 1) times the size of the last turn, and
    ends_sha256 the digest of the ids that end there, ascending, comma-joined.  Rows with a null id are left
    out, null turns count as none, and rows that repeat an id are members of their own.  An empty table has
    no nodes; other columns are ignored.
    """
    spark = paths.sparkSession
    none = F.array().cast(paths.schema["turns"].dataType)
    packed = stored(_packed(paths.where("conv_id is not null").select("conv_id", F.coalesce("turns", none).alias("turns"))))
    n, width = packed.agg(F.count(F.lit(1)), F.sum(F.length("path") + F.lit(64))).first()
    if not n:
        return spark.createDataFrame([], NODE)
    shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD)))
    share = min(1.0, LOOKS * shards / n, SAMPLE_BYTES / width)
    looked = packed.where(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("path", "conv_id").collect()
    splitters = choose_splitters(sorted((bytes(r["path"]), r["conv_id"]) for r in looked), shards, SKELETON_BYTES)
    skeleton = skeleton_of(splitters)
    sent = spark.sparkContext.broadcast((splitters, skeleton))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = sent.value[0]
        for batch in batches:
            keys = zip(batch["path"], batch["conv_id"], strict=True)
            yield batch.assign(shard=[bisect_right(bounds, (bytes(p), int(c))) for p, c in keys])

    columns = ["number", "piece", "ids", "size", "above", *(x.split()[0] for x in NODE.split(", "))]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["shard"], batch["path"], batch["sizes"], batch["conv_id"], strict=True)

        def nodes():
            for shard, group in groupby(rows(), key=lambda x: x[0]):
                for row in _shard_rows(((bytes(p), s, int(c)) for _, p, s, c in group), sent.value[1]):
                    yield int(shard), *row

        yield from _frames(nodes(), ["shard", *columns])

    by_shard = packed.mapInPandas(dealt, "conv_id long, path binary, sizes array<int>, shard int")
    streams = by_shard.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    told = stored(streams.mapInPandas(local, "shard int, number long, piece int, ids string, size long, above long, " + NODE))

    parts = told.where("number is not null")
    finished = stored(_finish(parts, skeleton).join(_ends_digests(parts), "number"))
    # One row a skeleton node: bounded by SKELETON_BYTES / WIDE.
    tops = F.broadcast(finished.select(F.col("number").alias("top"), F.col("conv_id").alias("top_conv_id")))
    names = columns[5:]
    nodes = told.where("number is null").join(tops, F.col("above") == F.col("top"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id")).select(*names)
    return nodes.union(finished.select(*names))


def first_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string")) % 6).cast("int")


def rebuilt(paths: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % 100, h = crc32(c) % 6; their own follow after h.

    A missing first conversation gives no turns.  At most 100 conversations share a first one.
    """
    heads = paths.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    c, h = F.col("conv_id"), first_turns(F.col("conv_id"))
    met = paths.join(heads, c - c % 100 == F.col("base"), "left")
    given = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return met.select("conv_id", F.concat(given, rest).alias("turns"))
