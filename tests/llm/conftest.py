import pytest

HOSTILE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "a b c d e"), (7, "word " * 30_000), (8, "x" * 200_000), (9, "tab\tand  double \n\n lines   wide"), (10, "ÀÉ ß 漢字 🙂 <|endoftext|>"),
]


@pytest.fixture(scope="session")
def hostile(spark):
    """Null, empty, blank, repeated, very long and odd texts, with columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, "src0", -1, "clash", 5) for i, t in HOSTILE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, band string, n_removed long")
