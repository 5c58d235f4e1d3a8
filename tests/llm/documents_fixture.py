import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rk string, row string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text[, lang, source]); with columns whose names operators use inside."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build
