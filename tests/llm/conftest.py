import random

import pytest
from tables import DOCS, table

@pytest.fixture
def words():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture
def odd(spark, words):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a repeated id, equal texts."""
    long = words(60_000, 1)
    rows = [
        (1, words(80, 2), "en", "a"), (1, words(80, 2), "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t", "en", None),
        (None, words(50, 3), None, None), (None, None, None, None), (5, long, "en", "a"), (6, words(80, 2), "de", "b"), (7, "one", "en", "c"),
        (8, words(40, 4) + "\n" + words(40, 4), "en", "c"), (8, words(90, 5), "en", "c"), (9, "ÉÀ ñ \u2003 \x1c x|y 日本 <|endoftext|> e\u0301", "fr", "b"),
    ]
    return table(spark, rows)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
