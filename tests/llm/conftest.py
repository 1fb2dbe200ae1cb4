import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of literal texts: docs("a", None, ...) has ids from 0."""

    def make(*texts, **more):
        rows = [(i, t, more.get("lang", "en"), "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, TEXT_SCHEMA)

    return make
