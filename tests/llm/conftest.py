import pytest

LONG = "lorem ipsum " * 20000


@pytest.fixture
def odd_docs(spark):
    """Null, empty, blank and very long texts, repeated rows, a null id, and
    extra columns whose names the operators use themselves."""
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "the cat sat on the mat"), (7, "12345 !!! ???"), (8, "Ünïcödé 中文 😀 \x00 end")]
    full = [(i, t, "en", None if i == 5 else "src", len(t or ""), 0.5, "x", True, "y") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, id string, keep boolean, quality_score string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
