import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with what operators add."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 1.0) for i, t in rows]
        return spark.createDataFrame(full, f"{DOCS}, n_words string, score double")

    return make
