"""Documents whose further columns have the names that operators use inside."""
import pytest

from lockstep.llm import decontaminate, exact_dedup, jaccard, line_dedup, substring
from lockstep.llm.common import shared_folder, unused

NAMES = "__id __kept __digest id node text_ t t1 t2 row key keep salt shard block lost_id suspected sieve".split()
W = " ".join(f"w{k}" for k in range(30))
ROWS = [(1, W), (2, W), (3, W.upper()), (4, "other words stand here"), (None, "other words stand here"), (None, W), (None, W), (5, None)]


@pytest.fixture
def crowded(spark):
    schema = "doc_id long, text string, " + ", ".join(f"{name} string" for name in NAMES)
    return spark.createDataFrame([(i, t, *["x"] * len(NAMES)) for i, t in ROWS], schema)


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def test_stages_keep_columns_and_rows(spark, crowded):
    items = spark.createDataFrame([(1, "q " + W, "x")], "item_id long, text string, __id string")
    for kept, want in ((exact_dedup.keep_one(crowded), [3, 4, 5]), (jaccard.keep_one(crowded), [1, 4, 5, None, None, None]),
                       (decontaminate.keep_clean(crowded, items), [4, 5, None, None, None])):
        assert sorted(kept.columns) == sorted(crowded.columns)
        assert ids(kept) == sorted((i is None, i or 0) for i in want)


def test_row_operators(crowded):
    assert ids(substring.substring_dedup(crowded)) == ids(crowded)
    assert ids(line_dedup.line_dedup(crowded)) == ids(crowded)
    assert unused(crowded, "__ID") == "___ID"


def test_a_cluster_needs_a_shared_folder():
    class Settings:
        def get(self, key, other=None):
            return other

    class Session:
        conf = Settings()
        sparkContext = type("Context", (), {"master": "spark://head:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session())
