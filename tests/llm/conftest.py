"""Tables with the awkward rows that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very short, very long and repeated texts; nulls elsewhere; columns whose names operators use."""
    lorem = "the quick brown fox jumps over the lazy dog and runs away from it. "
    rows = [
        (0, None, None, None, None, None, None),
        (1, "", "en", "a", 0, 1.0, 5),
        (2, "x", "en", "a", 1, None, None),
        (3, "Ünïcödé 日本語 🎉 text", None, "b", 20, 0.5, 7),
        (4, lorem * 3000, "en", "a", None, 0.1, 1),
        (5, lorem * 5, "en", "a", None, 0.1, 1),
        (6, lorem * 5, "en", "a", None, 0.1, 1),
        (9, "a" * 5000, "en", "c", None, None, None),
        (12, "word " * 40 + "\n\t end", "en", "c", None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
