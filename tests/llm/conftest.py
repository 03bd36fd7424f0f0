import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("class_id", T.IntegerType()), T.StructField("spans", T.StringType())])

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))


def rows(texts):
    """Rows with ids from 0 and columns whose names clash with those that operators add."""
    return [(i, t, None if i % 3 else "en", None if t is None else len(t), "own", "own", 7, "own") for i, t in enumerate(texts)]


AWKWARD = [
    "the quick brown fox jumps over the lazy dog near the river bank today", None, "", " ", "\n\n \t", "...", "one", "Ünïcode straße, été; 東京 🙂 и текст",
    "a  b c d \x1c e\r\nf", "<|endoftext|> and <|startoftext|>. End", "the quick brown fox jumps over the lazy dog near the river bank today",
    LONG, LONG + " more", "x" * 200_000, "ΑΣ ΟΔΟΣ. İstanbul H̱ é, ___. a_b. 5.5, (a).",
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, a repeated row, and a null id."""
    data = rows(AWKWARD)
    data += [data[0], (None, AWKWARD[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), DOCS)
