import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A function from texts (by place, or (id, text)) to a table of documents."""

    def make(texts, langs=None):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, langs[k] if langs else "en", None, len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)

    return make


@pytest.fixture(scope="session")
def folder(spark, documents, tmp_path_factory):
    """A function from texts, benchmark texts and pages to a folder of tables."""

    def make(texts, items=(), pages=()):
        d = f"file://{tmp_path_factory.mktemp('data')}"
        documents(texts).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        return d

    return make


WORDS = [a + b + c for a in ("ba", "ke", "lu", "mo") for b in ("n", "st", "r", "l") for c in ("a", "eth", "ing", "o")]


@pytest.fixture(scope="session")
def prose():
    """A function to make repeatable text of n words."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))

    return make


#: Null, empty, blank, one word, ties, marks of several languages.
ODD = [None, "", "   \n\t ", "word", "a b c d", "ß é ñ 日本 \U0001f600", "x" * 5000, "Nul \0 byte", "<|endoftext|> is text", "\r\n\r\n", "same text here for all of us", "same text here for all of us"]
