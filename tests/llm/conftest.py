import pytest

from roaskit.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and a column named like a result."""
    rows = [(1, "the same  text\nhere", 9), (2, "the same text here", None), (2, "the same text here", None),
            (None, "the same text here", 1), (3, None, 2), (4, "", 3), (5, " \n ", 4), (None, None, None),
            (6, "word " * 60_000, 5), (7, "déjà vu, <|endoftext|> it's ½ 12 a😀b don't stop", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept int")
