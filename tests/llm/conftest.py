import pytest

#: id, text, lang, source: nulls, empty and white-space texts, ties, repeated rows and a clashing extra column.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", "x"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", "x"),
    (2, "ALPHA beta gamma delta epsilon zeta", "en", None, None),
    (3, None, "en", "b", None),
    (4, "", None, "b", ""),
    (5, " \t\n\x0b ", "de", "b", None),
    (6, "four words are here", "de", "c", None),
    (7, "four words are here", "de", "c", None),
    (None, "no id has this text of seven words", "en", "c", None),
    (8, "12345 67890", "en", "a", None),
    (9, "word " * 30000, "en", "a", None),
    (10, "é漢😀 ▁x  y\n\nz", None, "a", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, node string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
