import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lockstep.llm import token_align
from lockstep.llm.queries import BYTE_BPE, PIECE_BPE
from tests.llm.brute import ODD_ROWS


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    plain = [x for x in range(256) if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or 0xAE <= x]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


def aligned(text, plain):
    """[(ids of A, ids of B)] of the groups of a text, one end after another."""
    if not text:
        return []
    a, b = plain
    letters = byte_letters()
    said = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    other = [(i, piece(i)) for i in b.encode(text)]
    if not (b"".join(x for _, x in said) == (" " + text).encode() == b"".join(x for _, x in other)):
        return []
    groups, ga, gb, x, y = [], [], [], 0, 0
    ia, ib = iter(said), iter(other)
    while True:
        if x <= y:
            nxt = next(ia, None)
            if nxt is None:
                break
            ga.append(nxt[0])
            x += len(nxt[1])
        else:
            i, piece_bytes = next(ib)
            gb.append(i)
            y += len(piece_bytes)
        if x == y:
            groups.append((ga, gb))
            ga, gb = [], []
    assert not ga and not gb
    return groups


def expected(rows, plain):
    told = [(i, aligned(t, plain)) for i, t in rows]
    pairs = Counter(p for _, groups in told for p in {(a, b) for ga, gb in groups for a in ga for b in gb})
    most = defaultdict(int)
    for (a, _), n in pairs.items():
        most[a] = max(most[a], n)
    out = Counter()
    for i, groups in told:
        links = Counter()
        for ga, gb in groups:
            for a, n in Counter(ga).items():
                for b, m in Counter(gb).items():
                    links[a, b] += n * m
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out[i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if pairs[p] == most[p[0]]), sum(n * pairs[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "", text] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256 groups".split()) for r in df.collect())


PIECES = ["the", "straße", "Zwölf", "naïve", "don't", "12345", "3.14", "  ", "\n", "\t ", " \n ", "▁", "😀", "日本語", "<|endoftext|>", "<s>", "</s>",
          " ", " x", "a" * 50, "\x1c", "'s", "!!!", "é", "\r\n", "<0x0A>", "\u0000", "İstanbul", "x\x85y", "﻿"]


def texts(seed, n):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("piece, batch, block, known", [(1 << 16, 1 << 20, 8 << 20, 200_000), (7, 200, 900, 10)])
def test_against_the_definition(docs_of, monkeypatch, plain, piece, batch, block, known):
    for name, value in (("PIECE", piece), ("BATCH", batch), ("BLOCK", block), ("REMEMBERED", known), ("PAIRS", 50 * piece)):
        monkeypatch.setattr(token_align, name, value)
    rows = [(k % 80 if k % 9 else None, t) for k, t in enumerate(texts(piece, 120))]
    assert got(token_align.token_alignment(docs_of(rows), BYTE_BPE, PIECE_BPE)) == expected(rows, plain)


def test_odd_rows(docs_of, plain):
    assert got(token_align.token_alignment(docs_of(ODD_ROWS), BYTE_BPE, PIECE_BPE)) == expected(ODD_ROWS, plain)
    assert got(token_align.token_alignment(docs_of([]), BYTE_BPE, PIECE_BPE)) == Counter()


def test_pieces_are_equal_and_independent():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = np.array(sorted(rng.sample(range(n), rng.randint(0, n))) + [n])
        b = np.array(sorted(rng.sample(range(n), rng.randint(0, n))) + [n])
        for piece in (1, 2, 5, 64):
            i, j = token_align.merge_path(a, b, piece)
            work = np.diff(i + j)
            assert (work >= 0).all() and work.max() <= piece + 1 and (i[-1], j[-1]) == (len(a), len(b))
            for x, y in zip(i.tolist(), j.tolist()):
                assert max([0, *a[:x], *b[:y]]) <= min([n, *a[x:], *b[y:]])
            shared = sorted(set(a.tolist()) & set(b.tolist()))
            in_a, in_b = token_align.groups_of(a, b, piece)
            assert np.cumsum(in_a).tolist() == [a.tolist().index(x) + 1 for x in shared]
            assert np.cumsum(in_b).tolist() == [b.tolist().index(x) + 1 for x in shared]


def test_pairs_of_large_groups(monkeypatch):
    monkeypatch.setattr(token_align, "PAIRS", 1000)
    rng = random.Random(9)
    n_a, n_b = np.array([3, 400, 1, 90, 2]), np.array([2, 300, 1, 95, 1])
    owner = np.array([0, 0, 1, 3, 3])
    ids_a, ids_b = (np.array(rng.choices(range(k), k=n)) for k, n in ((70, n_a.sum()), (50, n_b.sum())))
    want, x, y = Counter(), 0, 0
    for o, n, m in zip(owner.tolist(), n_a.tolist(), n_b.tolist()):
        want.update((o, a * token_align.WIDE + b) for a in ids_a[x:x + n].tolist() for b in ids_b[y:y + m].tolist())
        x, y = x + n, y + m
    found = [v.tolist() for v in token_align.link_pairs(ids_a, ids_b, n_a, n_b, owner)]
    assert list(zip(*found[:2])) == sorted(want) and found[2] == [want[k] for k in sorted(want)]
