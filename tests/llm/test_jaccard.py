import random
from collections import Counter

import numpy as np
import pytest

from lockstep.llm import jaccard
from tests.llm import brute
from tests.llm.brute import ODD_ROWS


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def families(seed, groups, copies, length):
    """Texts in families of edited copies, with a passage many of them share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=20)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, length))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += passage
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_against_every_pair(docs_of, size, percent):
    rows = families(size, 14, 9, 180)
    assert got(jaccard.jaccard_components(docs_of(rows), size, percent)) == brute.jaccard(rows, size, percent)


def test_blocks_and_salted_keys(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(jaccard, "BLOCK_BITMAPS", 12)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "HOT_SHARE", 0.0001)
    rows = families(7, 2, 70, 120)
    assert got(jaccard.jaccard_components(docs_of(rows), 3, 90)) == brute.jaccard(rows, 3, 90)


def test_odd_rows(docs_of):
    assert got(jaccard.jaccard_components(docs_of(ODD_ROWS), 3, 90)) == brute.jaccard(ODD_ROWS, 3, 90)
    assert got(jaccard.jaccard_components(docs_of([]), 3, 90)) == Counter()
    kept = jaccard.keep_one(docs_of(ODD_ROWS))
    assert kept.columns == docs_of([]).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8, 9007199254740993]


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (5, 9, 12, 17, 40, 150, 700):
            for _ in range(60):
                a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
                gone, new = rng.integers(0, max(1, n // 5) + 1), rng.integers(0, max(1, n // 5) + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2 ** 63, new, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(a) != both and 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(jaccard.range_keys(a, percent), jaccard.range_keys(b, percent)).size
