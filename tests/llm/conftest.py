import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in ((*r, "a")[:3] for r in rows)]
        return spark.createDataFrame(full, DOCS).withColumnRenamed("n_chars", "n_chars")

    return make
