import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows ``(doc_id, text)`` as a table like documents."""

    def make(rows, schema=SCHEMA):
        return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema)

    return make


@pytest.fixture
def awkward(documents):
    """Null, empty, very long and repeated texts, null and repeated ids."""
    long = "word " * 30_000
    return documents([(1, None), (2, ""), (3, long), (4, "a b c"), (4, "a b c"), (None, "a b c"), (None, None), (5, "  \n\t")])
