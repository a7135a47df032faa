import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, node long, hub string, path string, keep boolean, own string, `a.b` int, ```` int, gone long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, short, long and repeated texts, and columns whose names the operators use themselves."""
    words = "the quick brown fox jumps over a lazy dog near the old river bank."
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \n\t ", "en", "b", 4), (4, "one", None, None, 3), (5, words, "en", "a", len(words)), (6, words, "en", "a", len(words)), (6, words, "en", "a", len(words)),
        (None, words, "en", None, len(words)), (7, (words + " ") * 4000, "en", "a", 0), (8, "x" * 200_000, "en", "c", 200_000), (9, "é" * 50 + " 日本語 🙂 \x00 \x1c end", "fr", "c", 0), (10, words.upper(), "en", "c", 0),
    ]
    return spark.createDataFrame([r + (1, "r", 2, "h", "p", True, "o", 3, 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
