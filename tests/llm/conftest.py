import pytest

EDGE_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3), (2, None), (3, ""), (4, " \t\n "), (5, "12345 !!! ###"),
    (6, "word " * 30_000), (7, "The quick brown fox jumps over the lazy dog. " * 3), (7, "The quick brown fox jumps over the lazy dog. " * 3),
    (8, "x"), (9, "tabs\tand  double  spaces and   wide ones \r\n end "), (10, "日本語 текст ñandú 😀"), (None, "an unnamed text of some words"),
]


@pytest.fixture
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that operators add."""
    rows = [(i, t, "en" if n % 2 else "de", f"s{n % 3}", "taken", 0.5, 7) for n, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string, score double, n_words long").repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
