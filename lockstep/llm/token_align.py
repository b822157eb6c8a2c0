"""Alignment of two tokenizers: where tokens of A and of B end at the same byte, and which ids go together.

The byte ends of A's and of B's tokens are two ascending lists.  Merging them is cut into pieces of equal
work along diagonals of the merge path: a binary search on each diagonal, all of them at once, finds how
many ends of A and of B come before it, and a piece then needs nothing but its own two slices.  A piece
emits the ends that A and B share in it and how many tokens of either list overlap each; a group that a
piece leaves open goes on in the next one, and one running sum over the pieces stitches them into groups.
Texts of a batch lie one after another on the same line of bytes, so a very long one and many short ones
are cut into the same pieces.

Counts of id pairs over the whole corpus take two passes.  Pass one aligns and writes, per document, its
distinct pairs as positions in the list of its block, and per block each pair with the number of documents
that hold it.  Blocks are at most BLOCK code points (or one document), so a pair of a hot word is one row a block.
Those rows are added up by pair, compared with the highest count of their A id (one row an A id: broadcast),
and go back to their block, whose documents look their pairs up.  Documents meet their block by its number
in one equi-join; nothing is sent to the driver.
"""
from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import keyed_text, named_id, stored

#: Ends of both lists in a piece.
PIECE = 1 << 16
#: Code points aligned at once and in a block, about; link pairs held at once.
BATCH, BLOCK, PAIRS = 1 << 20, 8 << 20, 4 << 20
#: Distinct chunks of text whose tokens are remembered: so many new ones, and as many from before.
REMEMBERED = 250_000
#: Room for ids of B in a pair's number.
WIDE = 1 << 20

#: Before a blank that follows something else no token of A and none of B goes on.
_CUT = re.compile(r"(?<=\S)(?= )")
_DOUBLE = re.compile(r"\s ")


class Tokenizers:
    """Ids of A for space+text and of B for text (which adds that space), and the bytes of every id.

    Both split before a blank that follows a non-blank, so a text is tokenized by such chunks, and chunks
    seen before are looked up.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError("B has tokens that go on after a word: texts cannot be cut at blanks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # A lone blank: B adds its space to no empty text.
        self.b_blank = self.b.encode("a ")[len(self.b.encode("a")):]
        self.kind_a, self.kind_b = (np.min_scalar_type(len(x) - 1) for x in (self.a_bytes, self.b_bytes))
        # Packed ids of A and of B by chunk, those of the generation before, and chunks whose bytes do not come back.
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.before: tuple[dict, dict] = {}, {}
        self.odd: set[str] = set()

    def _learn(self, chunks: list[str]) -> None:
        known_a, known_b, kind_a, kind_b = self.known_a, self.known_b, self.kind_a.char, self.kind_b.char
        for start in range(0, len(chunks), 10_000):
            part = chunks[start:start + 10_000]
            found = self.a.encode_batch_fast([" " + x for x in part], add_special_tokens=False)
            all_a = [x.ids for x in found]
            all_b = [ids if chunk else self.b_blank for chunk, ids in zip(part, self.b.encode(part, num_threads=1), strict=True)]
            for chunk, ids_a, ids_b in zip(part, all_a, all_b, strict=True):
                known_a[chunk], known_b[chunk] = array(kind_a, ids_a).tobytes(), array(kind_b, ids_b).tobytes()
            # All chunks at once first; where that fails, one by one.
            said = b"".join([b" " + x.encode("utf-8", "surrogatepass") for x in part])
            sizes = [len(x.encode("utf-8", "surrogatepass")) + 1 for x in part]
            if not (self._same(all_a, self.a_bytes, sizes, said) and self._same(all_b, self.b_bytes, sizes, said)):
                self.odd.update(x for x, ids_a, ids_b in zip(part, all_a, all_b, strict=True) if not self.comes_back(x, ids_a, ids_b))

    @staticmethod
    def _same(ids: list[list[int]], table: list[bytes], sizes: list[int], said: bytes) -> bool:
        sized = [len(x) for x in table]
        return [sum([sized[i] for i in x]) for x in ids] == sizes and b"".join(map(table.__getitem__, chain.from_iterable(ids))) == said

    def _know(self, chunks: set[str]) -> None:
        """Have the tokens of all these chunks at hand."""
        new = chunks - self.known_a.keys()
        if len(self.known_a) + len(new) > REMEMBERED:
            self.before, self.known_a, self.known_b, new = (self.known_a, self.known_b), {}, {}, chunks
            self.odd &= self.before[0].keys()
        old_a, old_b = self.before
        for chunk in new & old_a.keys():
            self.known_a[chunk], self.known_b[chunk] = old_a[chunk], old_b[chunk]
        self._learn(list(new - old_a.keys()))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) for each text; both empty where the text is empty or its bytes do not come back."""
        cut = []
        for text in texts:
            spaced = " " + text
            chunks = [x[1:] for x in _CUT.split(spaced)] if _DOUBLE.search(spaced) else text.split(" ")
            cut.append(chunks if text else [])
        self._know(set().union(*cut))
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            a = np.frombuffer(b"".join(map(self.known_a.__getitem__, chunks)), dtype=self.kind_a)
            b = np.frombuffer(b"".join(map(self.known_b.__getitem__, chunks)), dtype=self.kind_b)
            if self.odd and not self.odd.isdisjoint(chunks) and not self.comes_back(text, a, b):
                a, b = a[:0], b[:0]
            out.append((a, b))
        return out

    def comes_back(self, text: str, ids_a, ids_b) -> bool:
        want = (" " + text).encode("utf-8", "surrogatepass")
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        return b"".join([a_bytes[i] for i in ids_a]) == want == b"".join([b_bytes[i] for i in ids_b])


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): ends of A and of B before each diagonal 0, piece, 2 piece, ..., and at last all; i + j is the diagonal.

    Equal ends stay together: where a diagonal falls between them, B's end comes before it too.
    """
    whole = len(a) + len(b)
    diagonals = np.append(np.arange(0, whole, piece), whole)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while True:  # the first i at which a[i] > b[diagonal - 1 - i]
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high) // 2
        before = np.zeros(len(diagonals), dtype=bool)
        at = np.nonzero(open_)[0]
        before[at] = a[mid[at]] <= b[diagonals[at] - 1 - mid[at]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    i, j = low, diagonals - low
    if len(a) and len(b):
        split = (i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)])
        j = j + split
    return i, j


def groups_of(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B) in every group, from strictly ascending ends whose last ones are equal."""
    i, j = merge_path(a, b, piece)
    counts_a, counts_b, open_a, open_b = [], [], 0, 0
    for k in range(len(i) - 1):
        own_a, own_b = a[i[k]:i[k + 1]], b[j[k]:j[k + 1]]
        if not len(own_a) or not len(own_b):
            open_a, open_b = open_a + len(own_a), open_b + len(own_b)
            continue
        # Ends that both share, as positions in either slice.
        near = np.minimum(np.searchsorted(own_b, own_a), len(own_b) - 1)
        at_a = np.nonzero(own_b[near] == own_a)[0]
        at_b = near[at_a]
        if not len(at_a):
            open_a, open_b = open_a + len(own_a), open_b + len(own_b)
            continue
        # Tokens between shared ends; the first group goes on from the piece before, the last is left open.
        here_a, here_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        here_a[0] += open_a
        here_b[0] += open_b
        counts_a.append(here_a)
        counts_b.append(here_b)
        open_a, open_b = len(own_a) - 1 - at_a[-1], len(own_b) - 1 - at_b[-1]
    if open_a or open_b:
        raise ValueError("the last ends differ")
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(counts_a or [none]), np.concatenate(counts_b or [none])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def link_pairs(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray):
    """(owner, pair, links) of distinct pairs in order of owner and pair: of each group, every id of A with every id of B.

    Groups are taken in parts of about PAIRS links; equal ids of one large group are counted before they are paired.
    """
    starts_a, starts_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > 4096
    found = []
    small = np.nonzero(~large)[0]
    parts = np.cumsum((n_a * n_b)[small]) // PAIRS
    for part in np.split(small, np.nonzero(np.diff(parts))[0] + 1) if len(small) else []:
        size_a, size_b = n_a[part], n_b[part]
        # Every token of A of these groups, repeated for the tokens of B of its group.
        token_a = np.repeat(starts_a[part], size_a) + _within(size_a)
        per_token = np.repeat(size_b, size_a)
        first_b = np.repeat(starts_b[part], size_a)
        pair = np.repeat(ids_a[token_a].astype(np.int64) * WIDE, per_token) + ids_b[np.repeat(first_b, per_token) + _within(per_token)]
        found.append(_counted(np.repeat(np.repeat(owner[part], size_a), per_token), pair, None))
    for g in np.nonzero(large)[0].tolist():
        some_a, times_a = np.unique(ids_a[starts_a[g]:starts_a[g] + n_a[g]], return_counts=True)
        some_b, times_b = np.unique(ids_b[starts_b[g]:starts_b[g] + n_b[g]], return_counts=True)
        step = max(1, PAIRS // len(some_b))
        for k in range(0, len(some_a), step):
            pair = (some_a[k:k + step].astype(np.int64)[:, None] * WIDE + some_b[None, :]).ravel()
            links = (times_a[k:k + step, None] * times_b[None, :]).ravel()
            found.append((np.full(len(pair), owner[g]), pair, links))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    if len(found) == 1:
        return found[0]
    return _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _counted(owner: np.ndarray, pair: np.ndarray, links: np.ndarray | None):
    """Distinct (owner, pair) in order, with their links added up."""
    # Owners are few and pairs take 37 bits, so both fit one number.
    key = (owner.astype(np.uint64) << np.uint64(40)) | pair.astype(np.uint64)
    if links is None:
        key, total = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        total = np.add.reduceat(links[order], first) if len(first) else links
    return (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64), total.astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.dtype(f"u{packed[0]}"), offset=1).astype(np.int64)


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        # Digits of an id with what follows it: A's ',' or '|', then B's ',' or ';'.
        a, b = range(len(tokenizers.a_bytes)), range(len(tokenizers.b_bytes))
        self.words = np.array([f"{i}{mark}".encode() for ids, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in ids])

    def align(self, texts: list[str]):
        """Per text (n_a, n_b, n_groups, n_links, groups), and (owner, pair, links) of all texts' distinct pairs."""
        known = self.tokenizers
        encoded = known.encode(texts)
        n_a = np.array([len(a) for a, _ in encoded], dtype=np.int64)
        n_b = np.array([len(b) for _, b in encoded], dtype=np.int64)
        ids_a = np.concatenate([a for a, _ in encoded])
        ids_b = np.concatenate([b for _, b in encoded])
        ends_a, ends_b = np.cumsum(known.a_sizes[ids_a]), np.cumsum(known.b_sizes[ids_b])
        in_a, in_b = groups_of(ends_a, ends_b, PIECE)
        # A text's last ends are shared, so no group spans two texts.
        last = np.cumsum(in_a)
        owner = np.searchsorted(np.cumsum(n_a), last)
        n_groups = np.bincount(owner, minlength=len(texts))
        groups_before = np.concatenate([[0], np.cumsum(n_groups)])
        links_before = np.concatenate([[0], np.cumsum(in_a * in_b)])
        n_links = links_before[groups_before[1:]] - links_before[groups_before[:-1]]
        told = self._told(ids_a, ids_b, in_a, in_b)
        tokens_before = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        # Words stand in cells of one width, filled up with zero bytes.
        groups = [told[s:e].tobytes().replace(b"\0", b"")[:-1] for s, e in zip(tokens_before, tokens_before[1:])]
        return (n_a, n_b, n_groups, n_links, groups), link_pairs(ids_a, ids_b, in_a, in_b, owner)

    def _told(self, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
        """Digits of all tokens in the order of groups, A's before B's."""
        size_a, size_b = len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
        words_a, words_b = ids_a.astype(np.int64), ids_b + np.int64(2 * size_a)
        words_a[np.cumsum(in_a) - 1] += size_a
        words_b[np.cumsum(in_b) - 1] += size_b
        before_a, before_b = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        order[np.arange(len(ids_a)) + np.repeat(before_a, in_a)] = words_a
        order[np.arange(len(ids_b)) + np.repeat(before_b, in_b)] = words_b
        return self.words[order]


@lru_cache(maxsize=2)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process: its tables and what it remembers serve all tasks that run there."""
    return Aligner(Tokenizers(a_path, b_path))


ALIGNED = ("block long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,"
           " places binary, links binary, pairs binary, documents binary")


def _align(docs: DataFrame, a_path: str, b_path: str, emit_groups: bool) -> DataFrame:
    """Rows of documents, and after each block one row with its pairs (ascending) and their numbers of documents."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = aligner_of(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        rows: list[list] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        chars = 0

        def batch_rows():
            (n_a, n_b, n_groups, n_links, groups), (owner, pair, links) = aligner.align(texts)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            for k, row in enumerate(ids):
                digest = hashlib.sha256(groups[k]).hexdigest() if n_a[k] else ""
                rows.append([row, int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), digest, groups[k].decode() if emit_groups else None])
                # Copies: slices would keep the whole batch.
                found.append((pair[bounds[k]:bounds[k + 1]].copy(), links[bounds[k]:bounds[k + 1]].copy()))

        def block_rows():
            pairs, places, documents = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True, return_counts=True)
            at, out = 0, []
            for told, (own, links) in zip(rows, found, strict=True):
                # Ascending places as steps, so that most are small; most links are 1.
                steps = np.diff(places[at:at + len(own)], prepend=0)
                at += len(own)
                out.append((block, *told, _narrow(steps), _narrow(links), None, None))
            out.append((block, *[None] * 9, pairs.tobytes(), documents.astype(np.int64).tobytes()))
            for k in range(0, len(out), 2_000):
                yield pd.DataFrame(out[k:k + 2_000], columns=names, dtype=object)

        for row, text in chain.from_iterable(zip(x["id"], x["text"], strict=True) for x in batches):
            ids.append(row)
            texts.append(text or "")
            size += len(text or "") + 16
            if size >= BATCH:
                batch_rows()
                chars += size
                ids, texts, size = [], [], 0
            if chars >= BLOCK:
                yield from block_rows()
                rows, found, chars, block = [], [], 0, block + 1
        if texts:
            batch_rows()
        if rows:
            yield from block_rows()

    return docs.mapInPandas(read, ALIGNED)


def _pair_rows(aligned: DataFrame) -> DataFrame:
    """Rows (block, pair, documents) of the blocks."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, pairs, documents in zip(batch["block"], batch["pairs"], batch["documents"], strict=True):
                pair, n = np.frombuffer(pairs, dtype=np.int64), np.frombuffer(documents, dtype=np.int64)
                for k in range(0, len(pair), 100_000):
                    yield pd.DataFrame({"block": int(block), "pair": pair[k:k + 100_000], "documents": n[k:k + 100_000]})

    return aligned.where("pairs is not null").select("block", "pairs", "documents").mapInPandas(read, "block long, pair long, documents long")


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text",
                    emit_groups: bool = True) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    A is a byte-level vocabulary of the tokenizers library, read over space+text; B a sentencepiece model with
    byte fallback that adds the space.  Both without special tokens: their strings are plain text.  Texts that
    are null or empty, or whose bytes do not come back from either list of tokens, have no tokens: zeros and
    empty strings.  Groups end where tokens of A and B end at the same byte; links are all A-B pairs of
    occurrences in one group.  A pair of ids counts the rows of docs that hold it linked, rows that repeat an
    id or have none as well; n_best counts a row's links whose pair has the highest count of its A id (ties
    included), count_sum adds the counts up over the links.  ``groups`` is written as ``a1,a2|b1;a3|b2``.
    An empty table gives no rows; other columns are ignored.
    """
    aligned = stored(_align(keyed_text(docs, id_column, text_column), a_path, b_path, emit_groups))
    pairs = stored(_pair_rows(aligned))
    counts = stored(pairs.groupBy("pair").agg(F.sum("documents").alias("count")))
    # One row an id of A: bounded by its vocabulary.
    best = F.broadcast(counts.groupBy(F.floor(F.col("pair") / WIDE).alias("a")).agg(F.max("count").alias("most")))
    told = counts.join(best, F.floor(F.col("pair") / WIDE) == F.col("a")).select(
        F.col("pair").alias("counted"), "count", (F.col("count") == F.col("most")).alias("is_best"))
    looked = pairs.join(told, F.col("pair") == F.col("counted")).select("block", "pair", "count", "is_best")
    rows = aligned.where("pairs is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "places", "links")
    out = "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * emit_groups
    names = [x.split()[0] for x in out.split(", ")]

    def finish(own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        # The places of a block are those of its pairs in ascending order.
        table = table.sort_values("pair")
        count, is_best = table["count"].to_numpy(dtype=np.int64), table["is_best"].to_numpy(dtype=bool)
        n_best, count_sum = [], []
        for places, links in zip(own["places"], own["links"], strict=True):
            at, n = np.cumsum(_wide(places)), _wide(links)
            n_best.append(int(n[is_best[at]].sum()))
            count_sum.append(int((n * count[at]).sum()))
        return own.assign(n_best=n_best, count_sum=count_sum)[names]

    found = rows.groupBy("block").cogroup(looked.groupBy("block")).applyInPandas(finish, out)
    return named_id(found, docs, id_column)
