import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, _size int, target string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [
        (1, "Hello world, this is a text.\nSecond line here.", "en", "a", 1, 1, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 2, "y"),
        (4, "  leading and  double spaces \n\n and <|endoftext|> inside\ttabs ", "de", "b", 5, 3, "z"),
        (5, "Wörter mit Umlauten éèç 漢字 " * 3000, "de", "c", 9, None, "x"),
        (6, "same text twice", "fr", None, 1, 1, "x"),
        (6, "same text twice", "fr", None, 1, 1, "x"),
        (7, "same text twice", "fr", "b", 1, 1, "x"),
        (None, "a row without an id", "fr", "b", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)
