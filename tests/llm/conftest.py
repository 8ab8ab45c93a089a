import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
CLASH = ("h", "fp", "block", "part", "key", "lang_pred", "copies", "_row", "_text", "score", "n")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [r.asDict() for r in documents.collect()]


def odd_rows():
    rng = random.Random(4)
    words = ["the", "of", "naïve", "Ünder", "Thing", "x", "日本語", "o'er", "ét"]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(120))
    return [
        (1, text, "en", "a"),
        (1, text, "en", "a"),  # a repeated row
        (1, text + " more", "en", "a"),  # the id again, another text
        (2, text, None, "b"),
        (3, None, "en", "a"),
        (4, "", "en", None),
        (5, " \n\t ", None, None),
        (6, long, "fr", "b"),
        (7, "...!!!", "fr", ""),
        (8, "word", "de", "c"),
        (None, "A text without an id, and some words", "en", "a"),
        (None, None, None, None),
        (-5, "Ａ wide space <|endoftext|> \x00 \x1c's", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and clashing names."""
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def none(odd):
    """The same columns, no row."""
    return odd.limit(0)
