import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, root string, shard long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with extra columns whose names the operators use inside."""

    def build(texts, ids=None, langs=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), "x", "y", 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def tokenizer():
    from flowledger.llm.queries import tokenizer

    return tokenizer
