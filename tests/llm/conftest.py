import os

import pytest
from pyspark.sql import types as T

SF = os.environ.get("LAKEWEAVE_TEST_SF", "/root/testdata/sf0.001")

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "word " * 30_000
    return make_docs(
        (1, None, "en", None), (2, "", "en", "a"), (3, " \t\n", None, "b"), (None, "text without an id here", "en", "a"), (None, None, None, None),
        (4, long, "en", "a"), (5, "x" * 200_000, "en", "b"), (6, "9" * 50_000, "en", "b"), (7, "same text of some words here", "en", "a"),
        (7, "same text of some words here", "en", "a"), (8, "same text of some words here", "en", "c"), (9, "line one is here now\n\n\nline one is here now", "fr", "c"),
        (10, "é\U0001f600 z", "fr", "c"),
    )


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same with extra columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("size", "Text2", "hash", "fp", "key", "shard", "score", "bucket", "draw", "copies", "level", "TEXT_", "c0", "n_lines", "N_dropped", "cluster", "TEXT", "Doc_ID"))])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
