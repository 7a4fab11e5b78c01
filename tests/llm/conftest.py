import random

import pytest
from pyspark.sql import functions as F

EDGE = [
    None, "", " ", "one", "a b", "Mixed CASE words, with. punctuation!", "ß é 漢字 🙂 and\u00a0blank", "x " * 30_000, "0" * 20_000, "\n\n\n",
    "<|endoftext|> inside", "tab\tand\x0bvertical  double", "same text", "same text",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Hard texts, with a null id, a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, "en") for i, t in enumerate(EDGE)] + [(None, "no id here", None), (3, "one", "en"), (3, "other text of one id", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("node", "score", "ids", "n_words", "found", "__clash"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def rng():
    return random.Random(7)
