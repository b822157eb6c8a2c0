"""Byte-pair encoding by dynamic programming over prefixes, and its exact inverse on ids.

For every prefix of a word there is exactly one token that can end its encoding: a vocabulary entry
that is a suffix of the prefix and is compatible with the last token of the prefix before it, i.e.
no merge across their seam would have fired before the merges that made them.  An automaton over the
vocabulary gives the suffix matches of each position, longest first; the first compatible one is
stored, and following the stored tokens back from the end emits the ids.  Cost is linear in the word,
however long it is, and no merge loop runs.

The vocabulary file is a parameter.  The driver reads it and broadcasts its tables, whose size is
fixed by the file (tens of thousands of entries), so executors need no copy of it.
"""
from __future__ import annotations

import hashlib
import json
import unicodedata
import weakref
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from lockstep.llm.common import keyed_text, named_id

#: Words and pairs whose result a worker remembers before it forgets all of them; longer words are not remembered.
REMEMBERED_WORDS = 300_000
REMEMBERED_PAIRS = 300_000
REMEMBERED_LENGTH = 48
#: Ids a worker gathers before it hands their rows on.
HANDED_ON = 1_000_000


def load_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file with a word-end suffix, checked for the supported kind."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if (model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"]
            or spec["decoder"] is not None or kinds != ["NFC", "Replace", "Lowercase"]):
        raise ValueError(f"{path}: not a word-end BPE with NFC, blank folding, lower case and no decoder")
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"],
        "pattern": split["pattern"]["Regex"],
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Remembered(dict):
    """Ids by word, computed on first use by the encoder that owns this.

    The way back to the owner is weak: in a cycle both would outlive their task in a worker that is used again.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = weakref.proxy(encoder)

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encoder.encode_word(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts to ids and decodes ids to text, as the vocabulary's own library does."""

    def __init__(self, spec: dict):
        self.suffix = spec["suffix"]
        self.pattern = regex.compile(spec["pattern"])
        self.added = spec["added"]
        self.added_pattern = regex.compile(
            "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.token = {i: t for t, i in spec["vocab"].items()} | {i: t for t, i in self.added.items()}
        vocab = spec["vocab"]
        # Rank of the merge that makes a token (-1: a base symbol), and its two parts.
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(spec["merges"]):
            made, pair = vocab[left + right], (vocab[left], vocab[right])
            self.merge.setdefault(pair, rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, rank
        # A word is a string of byte characters whose last one is lifted above all others, so that
        # "x at the end of a word" and "x" are different symbols of the automaton.
        self.characters = byte_characters()
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            ends = text.endswith(self.suffix) and text != self.suffix
            body = text.removesuffix(self.suffix) if ends else text
            symbols = body[:-1] + chr(ord(body[-1]) + 0x1000) if ends else body
            self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words = Remembered(self)

    def _fits(self, left: int, right: int) -> bool:
        """Whether left, right can stand side by side: undo merges at the seam, latest first, and see
        that no pair across it would have merged before the step just undone."""
        rank, parts, merge = self.rank, self.parts, self.merge
        a, b = left, right
        bound = len(merge) + 1
        while True:
            across = merge.get((a, b))
            # Equal ranks cannot meet: a merge of the same rank on the left of the seam goes first.
            if across is not None and across < bound:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                # Of equal ranks the left one fires first, so one made at the seam by rb itself also wins.
                bound, b = rb + 1, parts[b][0]

    def _shown(self, word: str) -> str:
        return "".join([self.characters[b] for b in word.encode("utf-8", "surrogatepass")])

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as text."""
        shown = word if word.isascii() and word.isalpha() else self._shown(word)
        symbols = shown[:-1] + chr(ord(shown[-1]) + 0x1000)
        n = len(symbols)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        compatible = self.compatible
        if len(compatible) > REMEMBERED_PAIRS:
            compatible.clear()
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if end > length:
                if before < 0:
                    continue
                pair = (before, token)
                fits = compatible.get(pair)
                if fits is None:
                    fits = compatible[pair] = self._fits(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        if last[n] < 0:
            raise ValueError(f"the vocabulary has no token for a byte of {word!r}")
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return tuple(ids)

    def _piece(self, text: str, out: list[int]) -> None:
        # Characters are lowered one by one: no word-final form of sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        out.extend(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(text))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; strings of added tokens in it become those tokens; null and empty give none."""
        out: list[int] = []
        if not text:
            return out
        start = 0
        if self.added_pattern is not None:
            for match in self.added_pattern.finditer(text):
                self._piece(text[start:match.start()], out)
                out.append(self.added[match.group()])
                start = match.end()
        self._piece(text[start:] if start else text, out)
        return out

    def decode(self, ids) -> str:
        """Token strings joined by blanks: what the library gives for a vocabulary without a decoder."""
        token = self.token
        return " ".join([token[i] for i in ids])


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
                     emit_ids: bool = True) -> DataFrame:
    """One row per row of docs, in the partitions they come in (no shuffle): id, n_tokens, ids, ids_sha256, decoded_sha256.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the
    decoded text in UTF-8.  Null and empty texts give no ids.  A null id stays null; repeated rows
    are encoded each; other columns are ignored.  ``emit_ids=False`` leaves the array out.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = "id string, n_tokens long" + ", ids array<int>" * emit_ids + ", ids_sha256 string, decoded_sha256 string"
    columns = ["id", "n_tokens", *(["ids"] if emit_ids else []), "ids_sha256", "decoded_sha256"]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(spec.value)
        for batch in batches:
            out, held = [], 0
            for row, text in zip(batch["id"], batch["text"], strict=True):
                ids = encoder.encode(text)
                packed = np.array(ids, dtype="<u4")
                out.append((row, len(ids), *([packed.astype(np.int32)] if emit_ids else []), hashlib.sha256(packed.tobytes()).hexdigest(),
                            hashlib.sha256(encoder.decode(ids).encode()).hexdigest()))
                held += len(ids)
                if held >= HANDED_ON:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return named_id(keyed_text(docs, id_column, text_column).mapInPandas(encode, schema), docs, id_column)
