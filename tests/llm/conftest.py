import random

import pytest

WORDS = ["w%d" % i for i in range(400)]


def text(seed, words):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


def edited(base, seed, edits):
    r, words = random.Random(seed), base.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = "x%d" % r.randrange(10**6)
    return " ".join(words)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    long = " ".join("long%d" % (i % 5000) for i in range(60000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "b", 4),
        (4, "One", "en", "a", 3),
        (5, "one", None, "a", 3),
        (6, long, "en", None, None),
        (7, long + " tail", "en", "b", 1),
        (None, "a row without number but with a text", "en", "a", 1),
        (8, text(1, 50), "en", "a", 1),
        (8, text(1, 50), "en", "a", 1),
        (8, text(2, 50), "en", "b", 1),
        (9, "12 34 !!", "en", "c", 1),
        (10, "\U0001f600 été 中文", "fr", "c", 1),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
