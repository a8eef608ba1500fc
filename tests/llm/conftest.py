from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bundle string, `__keep` string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{k % 9973}" for k in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog sat on the rug by the fire of the house", "en", "a", 5, "x", None), (1, "the cat sat on the mat and the dog sat on the rug by the fire of the house", "en", "a", 5, "x", None),
        (2, None, "en", None, None, None, None), (3, "", None, "a", 0, "y", "k"), (None, "no id here but words", "de", "b", 3, None, None), (None, None, None, None, None, None, None),
        (4, long, "en", "a", len(long), "x", "k"), (5, " \n\t\r\x0b\x0c ", "en", "a", 7, "x", "k"), (6, "1234 5678 !!", "en", "a", 12, "x", "k"), (7, "Ünïcödé   spaces\x0cand\x0bbreaks\n\n\nÀ", "fr", "a", 9, "x", "k"),
        (8, "the cat sat on the mat and the dog sat on the rug by the fire of the house", "en", "a", 5, "x", None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
