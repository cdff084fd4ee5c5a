"""Tables with everything that may be wrong with a row."""

import pytest

LONG = "Der Zug fährt heute Abend später nach Süden und kommt morgen an. " * 3_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, text without words, and columns
    named as those that the operators make."""
    rows = [
        (1, "the cat sat on the mat and then it slept", "en", "s", 40),
        (1, "the cat sat on the mat and then it slept", "en", "s", 40),
        (2, None, "en", "s", None),
        (3, "", "de", "s", 0),
        (4, "  \n\t ", None, "s", 5),
        (5, LONG, "de", "s", len(LONG)),
        (None, "a row without an id says something here", "en", None, 39),
        (None, "a row without an id says something here", "en", None, 39),
        (None, None, None, None, None),
        (6, "!!! ??? ***", "xx", "s", 11),
        (7, "!!! ??? ***", "xx", "s", 11),
        (2**60 + 1, "日本語のテキスト 😀 naïve café", "ja", "s", 24),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("row", "key", "node", "row_key", "ROW_RANK", "text_statistics", "h", "g", "i", "x", "n", "k", "bin_group", "quality", "accepted", "margin")
    return df.selectExpr("*", *(f"'{c}' AS `{c}`" for c in names))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
