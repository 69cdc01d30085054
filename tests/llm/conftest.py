import pytest

TEXTS = ["", None, "a", "One two three. " * 30, "é ñ ß 日本 \U0001f600", "word " * 5000, "same text of some words here " * 20]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, extra columns."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, "x", 2) for i, t in enumerate(TEXTS * 2)]
    rows += [rows[3], (None, "null id " * 40, "fr", "s", 1, "x", 2)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, size int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
