import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, shard string, word string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with an operator's own."""
    long = " ".join(f"word{i % 977} it's ok, 12.5" for i in range(9000))
    rows = [
        (1, "The quick brown fox, it's <|endoftext|> here", "en", "a", 1, "x", "y", "z"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", "y", "z"),
        (4, long, "en", "b", 1, "x", "y", "z"),
        (5, "Ünïcode ẞtraße İstanbul 日本語 \u0000\u001c\u0085 á é 🙂🙂  \n\n tail ", "de", "a", 1, "x", "y", "z"),
        (5, "Ünïcode ẞtraße İstanbul 日本語 \u0000\u001c\u0085 á é 🙂🙂  \n\n tail ", "de", "a", 1, "x", "y", "z"),
        (None, "no id at all", "en", None, 1, "x", "y", "z"),
        *((100 + i, f"filler text number {i} " * (i % 7), "en", "hot", 1, "x", "y", "z") for i in range(60)),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
