import pytest

HARD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "a b",
    "same line\nsame line\n\nsame line",
    "the the the the the the the the the the the the the the",
    "Ünïcödé wörds — with “quotes” and 日本語 😀 text\x00nul",
    "tab\tsep\x0bvt\x0cff\rcr nbsp",
    "x" * 5000,
    " ".join(f"w{i % 97}" for i in range(4000)),
]


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with internal ones."""
    rows = [(i, t, None, "s", None, 1, 2, "x") for i, t in enumerate(HARD_TEXTS)]
    rows += [(100 + i, t, "en", None, 3, 1, 2, "x") for i, t in enumerate(HARD_TEXTS)]
    rows += [(3, "one", None, "s", None, 1, 2, "x"), (None, HARD_TEXTS[-1], "en", "s", 1, 1, 2, "x")]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, tid int, score int, spans string",
    )


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
