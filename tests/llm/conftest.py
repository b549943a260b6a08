import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of, the {i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "b", 1),
        (1, "one two three four five six seven eight nine ten", "en", "b", 1),
        (2, "One two  three four five six\tseven eight nine ten", "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "de", "c", 4),
        (6, "two words", "de", None, 9),
        (7, "Two words", "de", None, 9),
        (None, "one two three four five six seven eight nine ten", None, "b", 1),
        (None, None, None, None, None),
        (8, LONG, "en", "c", len(LONG)),
        (9, "x", "fr", "d", 1),
        (-5, "É́ 日本 😀 l'été\n\nzwei\n\n\ndrei", "fr", "d", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("score slot size taken kept label predicted range key bucket rep component words units first a b n").split()
    return docs.select("*", *[F.lit("clash").alias(c) for c in clashing])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0), (8, 1, 0), (9, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
