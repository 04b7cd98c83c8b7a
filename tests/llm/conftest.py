import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row_id long, n string, rank string, `a b` string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those used inside."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 7, "y", "z", "w") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
