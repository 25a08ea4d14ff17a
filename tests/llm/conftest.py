import pytest

#: Rows that every operator on documents has to take: nulls anywhere, empty and long texts, ties, repeats, clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, score string, spans string, _range int, marks string, h long"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, 1, 7, 7, "x", "y", 3, "z", 9)


@pytest.fixture(scope="session")
def odd(spark):
    long = "word " * 30_000 + "é" * 3000
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n "), row(4, "one"), row(5, "one two"), row(6, long), row(7, long), row(8, "The Quick  brown\x0bfox"),
        row(9, "the quick brown fox"), row(9, "the quick brown fox"), row(None, "no id here at all", None), row(None, None, None), row(12, "\x00\x1c nul", None), row(13, "日本語 テキスト" * 40, "é"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
