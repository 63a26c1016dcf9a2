import pytest

LONG = "wort " * 30000 + "\nzeile " * 50


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "The cat sat on the mat\nA Line that is shared by many\nend", "en", "a", 3.0, "x"),
        (2, "a line THAT  is shared by many \nanother one here with five words", "en", "a", None, None),
        (3, None, "en", None, 1.0, "y"),
        (4, "", None, "a", 1.0, "y"),
        (5, LONG, "de", "b", 1.0, "y"),
        (5, LONG, "de", "b", 1.0, "y"),
        (None, "The cat sat on the mat\nA Line that is shared by many\nend", None, None, None, None),
        (None, None, None, None, None, None),
        (9, " \t\n \r\n", "en", "a", 0.0, ""),
        (10, "mail a.b@c.de or 1.2.3.4 é + 日本語 'll", "en", "a", 0.0, ""),
    ]
    # score, fp, row, n, bin and the like are names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, fp string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
