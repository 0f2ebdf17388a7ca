import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, line string, k1 bigint, n_removed string, lang_pred string"
LONG_WORDS = " ".join(f"w{i % 977}" for i in range(40_000))
LONG_RUN = "x" * 150_000


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, "line", 7, "n", "zz")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n "), row(4, "\n\n"), row(5, LONG_WORDS), row(6, LONG_RUN), row(None, "no id here at all"), (None,) * 10,
        row(7, "the same words stand here twice in a row"), row(7, "the same words stand here twice in a row"), row(8, "the same words stand here twice in a row", None, None),
        row(9, "Über 12 Ärzte! 数字 😀 1.5%", "de", None), row(10, "one"), row(11, "ONE"), row(12, "a b c d"), row(13, "!!! ... ---"), row(14, LONG_WORDS),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
