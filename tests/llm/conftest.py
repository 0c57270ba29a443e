import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id string, "
          "sequence_id int, id string, row string, mix_epoch int, toxic string, h int, fp int")


def fill(rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return [(i, t, g, s, len(t or ""), False, 0.5, "x", 1, "y", "z", 3, "t", 1, 2) for i, t, g, s in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    prose = "the quick brown fox jumps over the lazy dog and the small cat"
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose.upper(), "en", "b"), (3, None, "en", "a"), (4, "", None, "a"),
            (5, " \t\n ", "fr", None), (None, prose, "en", "a"), (None, "Été à Paris", None, None), (6, "été à paris", "fr", "a"),
            (7, "Été à Paris", "fr", "b"), (8, "word", "en", "a"), (9, "two words", "en", "a"), (10, "12345 67 !!", "en", "a"),
            (11, " ".join(f"long{i % 997} text{i % 89}" for i in range(60_000)), "en", "a"), (12, "日本語 текст", "de", "c")]
    blank = [(None,) * 15]
    return spark.createDataFrame(fill(rows) + blank, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
