import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, tie long, kind string, size long, key long, hash long, words string"


def make(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    full = [(i, t, *(rest or ("en", "s")), None, 7, 7, "x", 9, 9, 9, "w") for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties, repeated rows, astral characters."""
    long_text = " ".join(f"w{i % 977} the" for i in range(30_000))
    return [
        (1, "one two three four five six seven", "en", "a"),
        (1, "one two three four five six seven", "en", "a"),
        (1, "another text of the same id and more", "en", "a"),
        (2, None, None, None),
        (3, "", "fr", "b"),
        (4, " \n\t ", None, "b"),
        (None, "no id here at all", "en", None),
        (None, None, None, None),
        (5, long_text, "en", "a"),
        (6, "\U0001f600 smile \U0001f600 café \x85 x\x1cy", "en", "b"),
        (7, "same text", "en", "a"),
        (8, "same text", "en", "a"),
    ]
