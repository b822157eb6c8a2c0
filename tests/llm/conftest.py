import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) rows, with further columns whose names the operators use inside."""
    def make(rows):
        schema = "doc_id long, text string, id string, node long, key string, digest string, kept string, source string"
        return spark.createDataFrame([(i, t, "x", 1, "k", "d", "y", "s") for i, t in rows], schema)
    return make
