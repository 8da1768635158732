import pytest

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def small_docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like results."""
    text = "One two three four five six seven eight nine ten. " * 12
    rows = [
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text.upper(), "en", None), (3, None, None, "a"), (4, "", "en", "b"),
        (5, " \t\n ", "en", "b"), (None, text + "x", "en", "a"), (None, None, None, None), (6, "short", "en", "c"),
        (7, "é" * 300 + "\n" + "token = abcdef123456\n" + text, "fr", "a"), (8, "a" * 5000, "en", "a"),
        (9, ("lorem ipsum " * 4000) + text, "en", "a"), (10, text + "\r\nlast line of it", "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n_words", "hits", "k1", "size", "n_lines", "spans"):
        df = df.withColumn(name, F.lit("x"))
    return df
