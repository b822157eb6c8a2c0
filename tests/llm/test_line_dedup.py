import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lockstep.llm import line_dedup
from tests.llm.brute import ODD_ROWS

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def expected(rows, least_chars, least_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                holders[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or i == max(holders[key(x)])]
        text = "\n".join(kept)
        out[i, len(lines), len(lines) - len(kept), text, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"], r["kept_sha256"]) for r in df.collect())


def pages(seed, n):
    rng = random.Random(seed)
    shared = ["Footer %d" % k + "!" * (k % 4) for k in range(12)] + ["", " ", "ÄÖ zwölf 😀"]
    rows = []
    for _ in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randint(0, 12))]
        lines = [rng.choice(["", " ", "\t", "\r", "\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "]) for x in lines]
        rows.append((rng.choice([None, rng.randint(0, n)]) if rng.random() < 0.2 else rng.randint(0, n), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("least_docs", [1, 2, 5])
@pytest.mark.parametrize("hot", [10**9, 1])
def test_against_the_definition(docs_of, monkeypatch, hot, least_docs):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 40)
    rows = pages(hot % 7 + least_docs, 150)
    assert got(line_dedup.line_dedup(docs_of(rows), 3, least_docs)) == expected(rows, 3, least_docs)


def test_odd_rows(docs_of):
    footer = "A FOOTER of more than forty characters in all, ends here"
    rows = ODD_ROWS + [(k % 7, f"{k}\n{footer}\r\n\n" + footer.lower()) for k in range(9)] + [(None, footer), (3, footer + "\n")]
    rows += [(100 + k, "\n".join([footer, "x"] * 20_000)) for k in range(2)]
    assert got(line_dedup.line_dedup(docs_of(rows))) == expected(rows, 40, 5)
    assert got(line_dedup.line_dedup(docs_of([]))) == Counter()
    short, full = "y" * 39, "y" * 40
    rows = [(k, short + "\n" + full + "\n " + short + " ") for k in range(5)]
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs_of(rows)).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_bitmaps_are_runs(spark):
    rng = random.Random(5)
    rows = [[]] + [sorted(rng.sample(range(60), rng.randint(1, 60))) for _ in range(40)] + [[2**31 - 2], [0, 1, 2, 70_000]]
    df = spark.createDataFrame([(x, [f"l{k}" for k in range(70)]) for x in rows], "p array<int>, lines array<string>")
    df = df.withColumn("bitmap", line_dedup.pack(F.col("p")))
    for r in df.select("p", "bitmap", line_dedup.unpack(F.col("bitmap")).alias("runs")).collect():
        assert [x for s, e in r["runs"] for x in range(s, e)] == r["p"]
        assert all(a[1] < b[0] for a, b in zip(r["runs"], r["runs"][1:])) and len(r["bitmap"]) == 8 * len(r["runs"])
    for r in df.where("coalesce(array_max(p), 0) < 70").select("p", line_dedup.kept_lines(F.col("lines"), F.col("bitmap")).alias("kept")).collect():
        assert r["kept"] == [f"l{k}" for k in range(70) if k not in r["p"]]
