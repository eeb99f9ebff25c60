import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or (id, text) pairs; languages are 'en'."""
    def make(texts, schema=DOC_SCHEMA):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    return make


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
