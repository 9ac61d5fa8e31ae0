import pytest
from pyspark.sql import Row

LONG = " ".join(f"w{i}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "Alpha beta gamma delta epsilon", "en", "s", "x"),
        (1, "Alpha beta gamma delta epsilon", "en", "s", "x"),
        (2, "alpha BETA gamma delta epsilon", "en", "s", None),
        (3, None, "en", None, "x"),
        (4, "", None, "s", "x"),
        (5, LONG, "en", "t", "x"),
        (6, LONG, "en", "t", "x"),
        (None, "Alpha beta gamma delta epsilon", "en", "s", "x"),
        (7, "12 !! 34", "en", "s", "x"),
        (8, "ÉCOLE école", "fr", "u", "x"),
        (9, "école école", "fr", "u", "x"),
        (10, " \n\t\n ", "fr", "u", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").withColumnsRenamed({}).selectExpr(
        "*", "doc_id as id", "text as __text", "1 as n", "2 as shard", "3 as key", "4 as row"
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def bench(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def make(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
