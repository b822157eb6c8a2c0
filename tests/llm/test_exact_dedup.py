from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lockstep.llm import exact_dedup
from lockstep.llm.common import shared_folder
from tests.llm.brute import fold
from tests.llm.brute import ODD_ROWS


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    out = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), False] += 1
        out[keep, keep, len(ids), False] -= 1
        out[keep, keep, len(ids), True] += 1
    return +out


def got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_groups(docs_of):
    assert got(exact_dedup.exact_dedup(docs_of(ODD_ROWS))) == expected(ODD_ROWS)
    assert got(exact_dedup.exact_dedup(docs_of([]))) == Counter()


def test_equal_digests_of_other_bytes_are_told_apart(docs_of):
    rows = ODD_ROWS + [(20 + k, f"text {k % 7}") for k in range(40)]
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    assert got(exact_dedup.exact_dedup(docs_of(rows), digest=weak)) == expected(rows)
    same = lambda text: F.lit(b"x")
    assert got(exact_dedup.exact_dedup(docs_of(rows), digest=same)) == expected(rows)


def test_state_goes_on_from_an_earlier_call(docs_of, spark):
    early, late = [(1, "a"), (5, "b"), (6, "c")], [(2, "A"), (4, "b"), (7, "d")]
    root = shared_folder(spark)
    assert got(exact_dedup.exact_dedup(docs_of(early), root=root)) == expected(early)
    both = exact_dedup.exact_dedup(docs_of(late), root=root, contents=docs_of(early + late))
    assert got(both) == expected(early + late)


def test_keep_one(docs_of):
    kept = exact_dedup.keep_one(docs_of(ODD_ROWS))
    assert kept.columns == docs_of([]).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k, n in expected(ODD_ROWS).items() if k[3])
