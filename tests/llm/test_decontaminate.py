import numpy as np
import pandas as pd
import pytest

from lockstep.llm import decontaminate
from tests.llm.brute import ODD_ROWS

ITEM = "When Jones bought 12 kg of pears from Smith the farmer Jones paid 7 dollars to Smith in 1998."
FILL = " ".join(f"filler{k}" for k in range(30))


def pairs(docs, items):
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminated(docs, items).collect()}


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_and_new_parameters(docs_of, spark):
    docs = docs_of([
        (1, f"{FILL} {ITEM} {FILL}"), (2, FILL),
        (3, f"{FILL}. {ITEM.replace('Jones', 'Miller').replace('Smith', 'Brown').replace('12', '31').replace('1998', '2004')} {FILL}"),
        # The item names Jones twice; two names for him is another text.
        (4, f"{FILL}. {ITEM.replace('Jones bought', 'Miller bought').replace('Jones paid', 'Brown paid').replace('Smith', 'Green')} {FILL}"),
        (5, " ".join(ITEM.split()[:12])), (6, ITEM.upper())])
    out = pairs(docs, items_of(spark, [(9, ITEM)]))
    assert out == {(1, 9): "copy", (3, 9): "reparameterised", (6, 9): "copy"}


def test_short_items_and_chance_numbers(docs_of, spark):
    docs = docs_of([(1, "see one two three four here"), (2, " ".join(str(k) for k in range(40))), (3, "one two three")])
    items = items_of(spark, [(1, "One two three four."), (2, " ".join(str(k + 100) for k in range(30))), (3, None), (4, ""), (None, "one two three")])
    assert pairs(docs, items) == {(1, 1): "copy"}


def test_odd_rows(docs_of, spark):
    items = items_of(spark, [(1, "word " * 20), (1, "word " * 20)])
    assert pairs(docs_of(ODD_ROWS), items) == {(6, 1): "copy", (7, 1): "copy"}
    assert pairs(docs_of([]), items) == {} and pairs(docs_of(ODD_ROWS), items_of(spark, [])) == {}
    kept = decontaminate.keep_clean(docs_of(ODD_ROWS), items)
    assert kept.columns == docs_of([]).columns and kept.count() == len(ODD_ROWS) - 2


def test_every_planted_item_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r["doc_id"], r["text"].split()) for r in docs.collect()]
    runs = {}
    for r in items.collect():
        w = r["text"].split()
        for k in range(len(w) - 12):
            runs.setdefault(tuple(w[k:k + 13]), set()).add(r["item_id"])
    want = {(d, i) for d, w in texts for k in range(len(w) - 12) for i in runs.get(tuple(w[k:k + 13]), ())}
    assert want and want <= set(pairs(docs, items))


def test_names_that_start_sentences(docs_of, spark):
    item = "Tom has 5 apples. Tom buys 7 more at the store. Tom gives 3 apples to his sister. How many apples does Tom have now?"
    short = "Tom walks from home to the old mill and back twice a day."
    other = lambda text, name: text.replace("Tom", name)
    docs = docs_of([(1, other(item, "Anna")), (2, f"{FILL} {other(item, 'Anna').replace('5', '9')} {FILL}"), (3, f"{FILL}. {other(short, 'Will')}"), (4, item),
                    # One name of the item cannot be three.
                    (5, "Anna has 5 pears. Bert buys 7 more in a shop. Carl gives 3 away."), (6, "Anna has 5 pears. Anna buys 8 more in a shop. Anna gives 3 away.")])
    assert pairs(docs, items_of(spark, [(1, item), (2, short), (3, "Tom has 5 pears. Tom buys 7 more in a shop. Tom gives 3 away.")])) == {
        (1, 1): "reparameterised", (2, 1): "reparameterised", (3, 2): "reparameterised", (4, 1): "copy", (6, 3): "reparameterised"}


def test_glued_units_and_ordinals(docs_of, spark):
    item = "a farmer carries 12kg of pears over 5km on the 3rd day and sells the pears for $7 at noon."
    new = item.replace("12kg", "31kg").replace("5km", "8km").replace("3rd", "2nd")
    docs = docs_of([(1, new), (2, new.replace("31kg", "31 kg").replace("8km", "8 km")), (3, item),
                    (4, " ".join(f"{k}kg" for k in range(40)))])
    assert pairs(docs, items_of(spark, [(1, item), (2, " ".join(f"{k}kg" for k in range(100, 140)))])) == {
        (1, 1): "reparameterised", (2, 1): "reparameterised", (3, 1): "copy"}


def test_short_texts_go_through_the_arrays_together(monkeypatch):
    texts = [None, "", ITEM, "Tom paid 12kg, 3rd time.", "und 5 minutes ago", *(f"{ITEM} In 5km Éa ran {k}kg." for k in range(200)), FILL]
    batch = pd.DataFrame({"id": range(len(texts)), "text": texts})
    every = np.full(decontaminate.BITS // 8, 255, dtype=np.uint8)
    templates, calls = decontaminate.templates, []
    monkeypatch.setattr(decontaminate, "templates", lambda *given: calls.append(1) or templates(*given))

    def rows():
        calls.clear()
        frames = decontaminate._probe(iter([batch, batch.head(0)]), [4, 13], every)
        return sorted(tuple(map(str, row)) for frame in frames for row in frame.itertuples(index=False))

    together, n_together = rows(), len(calls)
    monkeypatch.setattr(decontaminate, "TOGETHER", 1)
    monkeypatch.setattr(decontaminate, "HANDED_ON", 7)
    assert rows() == together and len(calls) == len(texts) and n_together == 1


@pytest.mark.parametrize(("word", "parts"), [(b"12kg", [b"12", b"kg"]), (b"(5km).", [b"(5", b"km)."]), (b"5x", [b"5x"]), (b"kg", [b"kg"])])
def test_a_glued_unit_is_a_word_of_its_own(word, parts):
    words, rows, glued = decontaminate.looked_up([b"a", word, b"b", word], decontaminate.Lexicon())
    assert words == [b"a", *parts, b"b", *parts]
    assert len(rows) == len(words) and glued.sum() == (4 if len(parts) == 2 else 0)
