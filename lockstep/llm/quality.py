"""Weakly supervised quality classifier.

Heuristic labellers vote good, bad or nothing on every document.  How far each can be trusted is not
known; expectation-maximisation over the vote patterns of the whole corpus estimates, for each labeller,
how often it votes what on good and on bad documents, and with that the probability that a pattern is
good.  These posteriors label a bounded sample, on which a linear scorer over hashed word-shape features
is trained; it scores every document.

Vote patterns are the sufficient statistics: counting them is one aggregation that combines before the
shuffle, and there are at most 3 ** labellers of them, so they fit the driver whatever the corpus.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import keyed_text, named_id

GOOD, NOTHING, BAD = 1, 0, -1
#: Rows the scorer is trained on at most.
TRAINING_ROWS = 20_000
#: Buckets of the hashed features.
BUCKETS = 1 << 12

# --- Fixed values: frequent function words of English, German, French and Spanish, and marks rare in prose ---
FUNCTION_WORDS = frozenset("""
the of and to in is that a for it as was with be by on not he i this are or his from at which but have an had they
you were their one all we can her has there been if more when will would who so no
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es aus
de la le et les un du une que est pour qui dans par plus pas au sur ne se ce il sont avec
el en y los del las por con una su para al lo como
""".split())
MARKS = "#$%&*|{}<>=\\~^_"
# -------------------------------------------------------------------------------------------------------------

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_REPEATED = re.compile(r"(.)\1+")


class Shapes(dict):
    """Word -> (shape, function word?, ends a sentence?, shouted?); Bad!! is Aa!, 3.5 is 9.9: runs of a kind of character count once."""

    @staticmethod
    def _kind(letters: str) -> str:
        return "A" if len(letters) > 1 and letters.isupper() else "Aa" if letters[0].isupper() else "a"

    def __missing__(self, word: str) -> tuple[str, bool, bool, bool]:
        if len(self) > 400_000:
            self.clear()
        body = word.rstrip(".,;:!?")
        if body.isalpha():
            low, shape = body.lower(), self._kind(body) + _REPEATED.sub(r"\1", word[len(body):])
        else:
            low = word.lower().strip(".,;:!?")
            shape = _REPEATED.sub(r"\1", _DIGITS.sub("9", _LETTERS.sub(lambda m: self._kind(m.group()), word)))[:24]
        value = self[word] = (shape, low in FUNCTION_WORDS, word[-1] in ".!?", word.isupper())
        return value


def _between(value: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    if good_from <= value <= good_to:
        return GOOD
    return BAD if value < bad_below or value > bad_above else NOTHING


def read_text(text: str, shapes: Shapes) -> tuple[list[int], dict[int, float]]:
    """Votes of all labellers and the hashed features (bucket -> share of words) of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [NOTHING] * len(LABELLERS), {}
    kinds = Counter(map(shapes.__getitem__, words))
    counts: Counter[str] = Counter()
    for (shape, *_), c in kinds.items():
        counts[shape] += c
    share = lambda k: sum(c for kind, c in kinds.items() if kind[k]) / n
    repeats = sum(map(eq, words[1:], words)) / n
    facts = {
        "marks": sum(map(text.count, MARKS)) / len(text),
        "shouted": share(3),
        "repeats": repeats,
        "distinct": len(set(words)) / n,
        "function": share(1),
        "length": (len(text) - n) / n,
        "ends": share(2),
        "words": n,
    }
    votes = [label(facts) for label in LABELLERS.values()]
    features: dict[int, float] = {}
    for name, part in [*((f"shape {s}", c / n) for s, c in counts.items()), ("repeated word", repeats),
                        ("function word", facts["function"]), (f"distinct {int(facts['distinct'] * 10)}", 1.0),
                        # The mean of a few words says little.
                        (f"length {min(int(facts['length']), 20) if n >= 20 else 'unknown'}", 1.0)]:
        bucket = xxhash.xxh3_64_intdigest(name.encode()) % BUCKETS
        features[bucket] = features.get(bucket, 0.0) + part
    return votes, features


#: Each labeller sees facts about a text with at least one word.
LABELLERS = {
    "few marks": lambda x: _between(x["marks"], 0, 0, 0.01, 0.05),
    "few shouted words": lambda x: _between(x["shouted"], 0, 0, 0.15, 0.4),
    "few repeated words": lambda x: _between(x["repeats"], 0, 0, 0.1, 0.25),
    "many distinct words": lambda x: _between(x["distinct"], 0.2, 0.4, 1, 1),
    "function words": lambda x: NOTHING if x["words"] < 20 else _between(x["function"], 0.03, 0.12, 0.6, 0.8),
    "word length": lambda x: NOTHING if x["words"] < 20 else _between(x["length"], 2, 3, 6, 7.5),
    "sentence ends": lambda x: NOTHING if x["words"] < 20 else _between(x["ends"], 0.005, 0.02, 0.3, 0.6),
}


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, rates[labeller, class, vote], posterior of each pattern); classes and votes ordered bad .. good.

    Starts from the majority vote, which also settles which class is the good one.
    """
    votes = patterns.astype(int) + 1
    n, k = votes.shape
    weight = counts.astype(float)
    score = patterns.sum(axis=1)
    good = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    prior, rates = 0.5, np.zeros((k, 2, 3))
    for _ in range(rounds):
        before = good
        by_class = np.stack([weight * (1 - good), weight * good])
        prior = (by_class[1].sum() + 1) / (weight.sum() + 2)
        for j in range(k):
            for v in range(3):
                rates[j, :, v] = by_class[:, votes[:, j] == v].sum(axis=1) + 1
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.log(rates)
        total = np.tile(np.log([1 - prior, prior]), (n, 1))
        for j in range(k):
            # Not voting tells little about the text and much about the labeller: it is no evidence.
            total += np.where((votes[:, j] == 1)[:, None], 0.0, logs[j][:, votes[:, j]].T)
        good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))
        if np.abs(good - before).max() < 1e-9:
            break
    return prior, rates, good


def train_scorer(features: list[dict[int, float]], labels: np.ndarray, rounds: int = 400, rate: float = 0.5,
                 shrink: float = 1e-4) -> np.ndarray:
    """Weights (BUCKETS + 1, the last for the constant) of a logistic scorer on soft labels, by adaptive gradient steps."""
    weights = np.zeros(BUCKETS + 1)
    if not features:
        return weights
    rows = np.repeat(np.arange(len(features)), [len(f) + 1 for f in features])
    columns = np.array([c for f in features for c in [*f, BUCKETS]], dtype=np.int64)
    values = np.array([v for f in features for v in [*f.values(), 1.0]])
    past = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        margin = np.bincount(rows, weights=values * weights[columns], minlength=len(features))
        wrong = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels
        gradient = np.bincount(columns, weights=values * wrong[rows], minlength=BUCKETS + 1) / len(features) + shrink * weights
        past += gradient ** 2
        weights -= rate * gradient / np.sqrt(past)
    return weights


@dataclass
class QualityModel:
    prior: float
    #: labeller -> probability that a vote it casts is right
    accuracy: dict[str, float]
    posterior: dict[tuple[int, ...], float]
    weights: np.ndarray


def _given(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return keyed_text(docs, id_column, text_column).na.fill("", "text")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", training_rows: int = TRAINING_ROWS) -> QualityModel:
    """Vote statistics over all documents; the scorer on at most ``training_rows`` of them, picked by a hash."""
    given = _given(docs, id_column, text_column)
    names = list(LABELLERS)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            tally = Counter(tuple(read_text(text, shapes)[0]) for text in batch["text"])
            yield pd.DataFrame({"votes": [list(k) for k in tally], "n": list(tally.values())})

    told = given.select("text").mapInPandas(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    told.sort(key=lambda r: tuple(r["votes"]))
    total = sum(r["n"] for r in told)
    if not total:
        return QualityModel(0.5, dict.fromkeys(names, 0.5), {}, np.zeros(BUCKETS + 1))
    patterns = np.array([r["votes"] for r in told])
    prior, rates, good = expectation_maximisation(patterns, np.array([r["n"] for r in told]))
    cast = prior * (rates[:, 1, 0] + rates[:, 1, 2]) + (1 - prior) * (rates[:, 0, 0] + rates[:, 0, 2])
    right = prior * rates[:, 1, 2] + (1 - prior) * rates[:, 0, 0]
    posterior = {tuple(p.tolist()): float(g) for p, g in zip(patterns, good, strict=True)}

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            read = [read_text(text, shapes) for text in batch["text"]]
            yield pd.DataFrame({"votes": [v for v, _ in read], "buckets": [list(f) for _, f in read], "shares": [list(f.values()) for _, f in read]})

    picked = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(min(1.0, 0.9 * training_rows / total) * (1 << 30)))
    rows = picked.select("text").mapInPandas(sample, "votes array<int>, buckets array<int>, shares array<double>").limit(training_rows).collect()
    features = [dict(zip(r["buckets"], r["shares"], strict=True)) for r in rows]
    weights = train_scorer(features, np.array([posterior[tuple(r["votes"])] for r in rows]))
    return QualityModel(prior, dict(zip(names, (right / cast).tolist(), strict=True)), posterior, weights)


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs, in its own partition: id, posterior, score, kept.

    A text without words, null texts included, has no evidence for it: score 0, not kept.  A null id
    stays null, repeated rows are scored each, an empty table gives no rows, other columns are ignored.
    The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes, own = Shapes(), shared.value
        for batch in batches:
            posterior, scores = [], []
            for text in batch["text"]:
                votes, features = read_text(text, shapes)
                posterior.append(own.posterior.get(tuple(votes), own.prior))
                margin = own.weights[BUCKETS] + sum(own.weights[b] * v for b, v in features.items())
                scores.append(float(1 / (1 + np.exp(-np.clip(margin, -50, 50)))) if features else 0.0)
            yield pd.DataFrame({"id": batch["id"], "posterior": posterior, "score": scores, "kept": [s >= threshold for s in scores]})

    rated = _given(docs, id_column, text_column).mapInPandas(rate, "id string, posterior double, score double, kept boolean")
    return named_id(rated, docs, id_column)


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows the scorer accepts, with all their columns: fit on all of docs, then one pass without a shuffle."""
    model = fit(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        weights, shapes, out = shared.value, Shapes(), []
        for text in texts:
            features = read_text(text or "", shapes)[1]
            margin = weights[BUCKETS] + sum(weights[b] * v for b, v in features.items())
            out.append(bool(features) and bool(1 / (1 + np.exp(-np.clip(margin, -50, 50))) >= threshold))
        return pd.Series(out, dtype=bool)

    return docs.where(accepted(F.col(text_column)))
