import pytest

#: id, text, lang, source, and a column whose name the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, id string, h long"

BASE = " ".join(f"word{k} of{k % 7} the{k} long{k} passage" for k in range(40))


@pytest.fixture
def rows():
    """Nulls in every column, empty and wordless and very long texts, copies, near copies, repeated rows."""
    long = " ".join(f"w{k * 7919 % 60_013}" for k in range(60_000))
    return [
        (1, BASE, "en", "a", "x", 1),
        (2, BASE, "en", "a", "x", 1),
        (2, BASE, "en", "a", "x", 1),
        (3, BASE + " and one more", "en", None, None, None),
        (4, None, None, "b", "y", 2),
        (5, "", "de", "b", "y", 2),
        (6, " \n\t ", "de", "b", "y", 2),
        (7, long, "fr", "c", "z", 3),
        (8, "short text", "fr", "c", "z", 3),
        (9, "Short TEXT", "fr", "c", "z", 3),
        (None, BASE, "en", "a", "x", 1),
        (None, "no id here", None, None, None, None),
        (10, "line one\nline one\n\nline # one", "es", "é", "q", 4),
        (11, "a <|endoftext|> b é漢字   c", "es", "ß", "q", 4),
    ]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
