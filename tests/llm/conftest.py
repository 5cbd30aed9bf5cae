import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns."""
    fields = "doc_id bigint, text string, lang string, digest string, n int, rep bigint, t string, sketch string, _draws string, kept string"
    rows = [
        (1, "Call +1 (017) 555-7713 or write a.b@mail.example.com now", "en"),
        (2, "", None),
        (3, None, "en"),
        (None, "alpha beta gamma delta epsilon zeta eta", None),
        (5, "alpha beta gamma delta epsilon zeta eta", "en"),
        (6, "alpha beta gamma delta epsilon zeta eta", "en"),
        (7, LONG, "en"),
        (8, LONG, None),
        (9, "one two", "en"),
        (10, "ONE  two", "en"),
        (11, "x" * 300_000, "en"),
        (12, "\n\n\n", "en"),
        (13, "idiot " * 5, "en"),
        (13, "idiot " * 5, "en"),
    ]
    return spark.createDataFrame([(*r, "d", 1, 2, "t", "s", "w", "k") for r in rows], fields).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
