import pytest

CLASH = ("id", "key", "row", "grp", "part", "cluster", "band", "component_id", "kept", "digest", "tokens", "topic", "weight", "probability", "sampled", "secrets", "kinds", "score", "lang_pred", "class", "node", "h", "url_", "rule", "v", "label_", "payload", "_gone", "_n", "a", "b", "u", "m", "n")
LONG = ("word " * 9).strip() + " tail%d"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty, blank and very long texts, ties and repeated rows, and clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "s"), (1, "alpha beta gamma delta epsilon zeta", "en", "s"), (2, None, "en", "s"), (3, "", None, None),
        (None, "alpha beta gamma delta epsilon zeta", "en", "s"), (None, None, None, None), (4, " \t\n ", "de", "s"), (5, "one two", "fr", "t"), (6, "ONE  two", "fr", "t"),
        (7, long, "en", "s"), (8, long + " more", "en", None), (9, "123 456 !!", "en", "s"), (10, "日本語 のテキスト é ü 😀", None, "u"),
    ]
    wide = [r + tuple("x" for _ in CLASH) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
