import gc
import hashlib
import random
import weakref

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lockstep.llm import bpe
from tests.llm.brute import ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.load_vocabulary(PATH))
BITS = ["a", "b", "e", "th", "in", "ing", " ", "\n", "\x1c", "\x85", "\xa0", "Σ", "ΑΣ", "İ", "é", "é", "'s", "'T", "9", "٣",
        "<|startoftext|>", "<|endoftext|>", "😀", "漢", "-", "...", "​", "ǅ", "ﬁ", "\x00", "ß", "½", "</w>", "!!!", "lololol"]


def test_same_ids_and_text_as_the_library():
    rng = random.Random(0)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(6_000)]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 60))) for _ in range(6_000)]
    for text in texts:
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ENCODER.encode(text) == want, text
        assert ENCODER.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_pair_test_agrees_with_merging():
    rng = random.Random(1)
    tokens = [t for t in ENCODER.token.values() if t.isascii() and t.isalpha()]
    for _ in range(3_000):
        word = rng.choice(tokens) + rng.choice(tokens)
        assert list(ENCODER.encode_word(word.lower())) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_rows(docs_of, spark):
    out = bpe.encode_documents(docs_of(ODD_ROWS), PATH).collect()
    assert len(out) == len(ODD_ROWS) and {r["doc_id"] for r in out} == {i for i, _ in ODD_ROWS}
    texts = dict((i, t) for i, t in ODD_ROWS if i is not None)
    for r in out:
        if r["doc_id"] is not None:
            ids = LIBRARY.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs_of([]), PATH).collect() == []


def test_an_encoder_ends_with_its_task():
    gc.disable()  # a worker that is used again may not come to collect cycles
    try:
        encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
        assert encoder.encode("some words") and encoder.words
        left = weakref.ref(encoder)
        del encoder
        assert left() is None
    finally:
        gc.enable()


def test_rows_are_handed_on_in_parts(docs_of, monkeypatch):
    docs = docs_of(ODD_ROWS)
    whole = sorted(map(str, bpe.encode_documents(docs, PATH).collect()))
    bare = sorted(map(str, bpe.encode_documents(docs, PATH, emit_ids=False).collect()))
    monkeypatch.setattr(bpe, "HANDED_ON", 3)
    assert sorted(map(str, bpe.encode_documents(docs, PATH).collect())) == whole
    assert sorted(map(str, bpe.encode_documents(docs, PATH, emit_ids=False).collect())) == bare
