import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lockstep.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def conversations(rows):
    """{id: [(role, text)]} in order."""
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            told[c].append(((turn is not None, turn or 0), digest, len(text), (role, text)))
    return {c: [x[3] for x in sorted(turns)] for c, turns in told.items()}


def rebuilt(told):
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = told.get(base, [])[:h] + own[h:]
    return out


def trie(told):
    """Rows of every node; told: list of (id, turns)."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in told:
        turns = tuple(turns)
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return Counter((min(members[x]), len(x), min(members[x[:-1]]) if x else None, len(members[x]), len(children[x]), leaves[x], saved[x],
                    hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest()) for x in members)


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def turns_of(seed, n):
    rng = random.Random(seed)
    said = ["", "a", "bb", "ccc", "ü😀", None]
    rows = []
    for c in range(n):
        c = c * 37 % (3 * n) if rng.random() < 0.9 else 7 - c
        kind = rng.random()
        texts = ["hot", "hot", "x"] if kind < 0.3 else ["hot"] * rng.randint(1, 40) if kind < 0.4 else rng.choices(said, k=rng.randint(1, 6))
        rows += [(c, None if t == 0 and rng.random() < 0.1 else t, rng.choice(["user", None]) if kind > 0.8 else "user", x) for t, x in enumerate(texts)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, number long, shard int, path string"


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p") for r in rows], SCHEMA)


@pytest.mark.parametrize("shard, pieces, looks", [(50_000, 1 << 20, 8), (5, 16, 3), (40, 64, 1)])
def test_against_the_definition(spark, monkeypatch, shard, pieces, looks):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PIECE", pieces)
    monkeypatch.setattr(prefix_trie, "LOOKS", looks)
    rows = turns_of(shard, 250)
    paths = prefix_trie.turn_paths(given(spark, rows))
    assert got(prefix_trie.prefix_trie(paths)) == trie(conversations(rows).items())
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(paths))) == trie(rebuilt(conversations(rows)).items())


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "y"), (1, 0, "user", "y"), (2, 5, "", ""), (3, 0, "user", "z" * 100_000),
            (9007199254740993, 1, "user", "y"), (-5, 1, "user", "y")] + [(4, k, "user", "t") for k in range(3_000)]
    assert got(prefix_trie.prefix_trie(prefix_trie.turn_paths(given(spark, rows)))) == trie(conversations(rows).items())
    assert got(prefix_trie.prefix_trie(prefix_trie.turn_paths(given(spark, [])))) == Counter()
    turn = [(b"0123456789abcdef", 4)]
    kind = "conv_id long, turns array<struct<digest:binary,size:int>>, x string"
    paths = spark.createDataFrame([(1, None, "p"), (2, [], "p"), (None, turn, "p"), (3, turn, "p"), (3, turn, "q")], kind)
    told = [(1, []), (2, []), (3, [("user", "four")]), (3, [("user", "four")])]
    assert got(prefix_trie.prefix_trie(paths)) == trie(told)


def test_splitters_are_separators_and_bounded():
    rng = random.Random(4)
    sample = sorted((b"".join(rng.choice([b"a", b"b"]) * 16 for _ in range(rng.randint(0, 6))), k) for k in range(400))
    for most in (1 << 20, 600, 0):
        splitters = prefix_trie.choose_splitters(sample, 50, most)
        assert splitters == sorted(set(splitters)) and sum(len(p) for p, _ in splitters) <= most
        skeleton = prefix_trie.skeleton_of(splitters)
        assert len(skeleton) == len({p[:k] for p, _ in splitters for k in range(16, len(p) + 1, 16)})
        # A prefix with members on both sides of a splitter is in the skeleton.
        shards = defaultdict(set)
        for path, row in sample:
            for k in range(16, len(path) + 1, 16):
                shards[path[:k]].add(sum(s <= (path, row) for s in splitters))
        inside = {p[:k] for p, _ in splitters for k in range(16, len(p) + 1, 16)}
        assert all(p in inside for p, own in shards.items() if len(own) > 1)
