import numpy as np

from lockstep.llm import quality
from tests.llm.brute import ODD_ROWS

SF = "/root/testdata/sf0.01"


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < a) == truth, 1, -1)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, rates, good = quality.expectation_maximisation(patterns, counts)
    assert abs(prior - 0.8) < 0.03
    right = rates[:, 1, 2] / (rates[:, 1, 0] + rates[:, 1, 2])
    assert np.abs(right - accuracy).max() < 0.05
    assert len(good) == len(patterns) <= 3 ** 5


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in scored) / len(scored) > 0.95
    assert all(r["kept"] for r in scored if r["quality"] == 1 and not r["toxic"])


def test_odd_rows(docs_of):
    docs = docs_of(ODD_ROWS)
    model = quality.fit(docs)
    out = quality.score(docs, model).collect()
    assert len(out) == len(ODD_ROWS)
    assert {r["doc_id"] for r in out} == {i for i, _ in ODD_ROWS}
    assert all(r["score"] == 0 and not r["kept"] for r in out if r["doc_id"] in (3, 4, 5))
    assert quality.keep_good(docs).columns == docs.columns
    assert sorted(quality.keep_good(docs).select("doc_id").collect(), key=str) == sorted((r[:1] for r in out if r["kept"]), key=str)
    empty = docs_of([])
    assert quality.score(empty, quality.fit(empty)).collect() == [] and quality.keep_good(empty).collect() == []
