import pytest


@pytest.fixture
def frame(spark):
    """Documents with ids, and columns that clash with the operators' own names."""

    def make(texts, first=1, **more):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 7) for i, t in enumerate(texts, first)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, n int")

    return make


ODD = [None, "", " \t\n ", "one", "word " * 30_000, "퟿\U0001f600 é ß", "same text here for all of us", "same text here for all of us"]
