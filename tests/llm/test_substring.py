import random
from collections import Counter

import pytest

from lockstep.llm import substring
from tests.llm import brute
from tests.llm.brute import ODD_ROWS


def got(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def passages(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    shared = [rng.choices(vocabulary, k=rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            piece = rng.choice(shared)
            text += rng.choices(vocabulary, k=rng.randint(0, 30)) + (piece if rng.random() < 0.5 else piece[rng.randint(0, 7):rng.randint(8, 60)])
        rows.append((k, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [100_000, 15])
def test_against_the_definition(docs_of, monkeypatch, part):
    monkeypatch.setattr(substring, "PART", part)
    rows = passages(part, 120)
    assert got(substring.substring_dedup(docs_of(rows), 13)) == brute.substring(rows, 13)


@pytest.mark.parametrize("part", [100_000, 15])
def test_rows_that_repeat_an_id(docs_of, monkeypatch, part):
    monkeypatch.setattr(substring, "PART", part)
    rng = random.Random(part)
    rows = [(rng.randint(0, 25), t) for _, t in passages(part + 1, 110)]
    rows += rows[:5]
    assert got(substring.substring_dedup(docs_of(rows), 13)) == brute.substring(rows, 13)
    w, v = (" ".join(f"{x}{k}" for k in range(13)) for x in "wv")
    other, tail = (" ".join(f"{x}{k}" for k in range(20)) for x in "op")
    for rows in ([(1, w), (2, w + " tail"), (2, other)], [(1, w), (2, w + " tail"), (3, v), (2, tail[:30] + " " + v)]):
        assert got(substring.substring_dedup(docs_of(rows), 13)) == brute.substring(rows, 13)


def test_hot_header(docs_of, monkeypatch):
    monkeypatch.setattr(substring, "PART", 40)
    rng = random.Random(6)
    header = " ".join(f"h{k}" for k in range(15))
    own = [" ".join(f"t{rng.random()}" for _ in range(12)) for _ in range(70)]
    rows = [(k, header + " " + (own[k] if k % 3 else rng.choice(own))) for k in range(70)]
    assert got(substring.substring_dedup(docs_of(rows), 13)) == brute.substring(rows, 13)


def test_hot_minimisers(docs_of, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE", 1)
    rows = passages(3, 90)
    assert got(substring.substring_dedup(docs_of(rows), 13)) == brute.substring(rows, 13)


def test_odd_rows(docs_of):
    assert got(substring.substring_dedup(docs_of(ODD_ROWS), 13)) == brute.substring(ODD_ROWS, 13)
    assert got(substring.substring_dedup(docs_of([]), 13)) == Counter()
    kept = {r["doc_id"]: r["kept_text"] for r in substring.substring_dedup(docs_of([(1, "a b c"), (2, "x a b c y")]), 3).collect()}
    assert kept == {1: "a b c", 2: "x y"}


def test_automaton_knows_first_owners():
    rng = random.Random(2)
    for _ in range(60):
        automaton, texts = substring.Automaton(), []
        for owner in range(6):
            words = rng.choices(range(3), k=rng.randint(0, 25))
            for window in (2, 4):
                for before in (None, owner, 3):
                    ends = automaton.matched(words, window, before)
                    want = [k for k in range(window, len(words) + 1)
                            if any(o < (99 if before is None else before) and words[k - window:k] == t[j:j + window] for o, t in texts for j in range(len(t) - window + 1))]
                    assert ends == want
            automaton.add(words, owner)
            texts.append((owner, words))
