import corpus_pipeline
from lockstep.llm import quality
from lockstep.llm.common import stored
from tests.llm import brute
from tests.llm.brute import ODD_ROWS

SF = "/root/testdata/sf0.001"


def test_every_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, benchmark = docs.columns, [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stored(stage(spark, docs, SF))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen.append((name, before, after))
        if name != "BPE encoding":
            assert docs.columns == columns
    (_, before, after), exact, near, bench, last = seen
    assert len(after) < len(before)
    last_of = {}
    for i, t in exact[1]:
        last_of[brute.fold(t)] = max(i, last_of.get(brute.fold(t), i))
    assert exact[2] == set(last_of.values())
    assert near[2] == {c for _, _, c in brute.jaccard(near[1], 5, 80)}
    runs = {tuple(w[k:k + min(13, len(w))]) for w in benchmark for k in range(max(1, len(w) - 12))}
    sizes = {len(r) for r in runs}
    clean = {i for i, t in bench[1] if not any(tuple(t.lower().split()[k:k + s]) in runs for s in sizes for k in range(len(t.split()) - s + 1))}
    assert bench[2] == clean
    assert last[2] == {i for i, _ in last[1]}
    assert spark.createDataFrame([(len(last[2]),)], "n long").first()["n"] == docs.count()


def test_odd_and_empty_documents(docs_of, spark):
    for rows in (ODD_ROWS, []):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
        assert docs.count() <= len(rows)


def test_model_is_trained_on_all_documents_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs)
    assert set(model.accuracy) == set(quality.LABELLERS) and all(0.5 < a <= 1 for a in model.accuracy.values())
