import pytest
from helpers import CAT, COLUMNS, document


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and keys, copies, and columns with clashing names."""
    rows = [
        document(1, CAT), document(1, CAT), document(1, "quite another text that has the same key as the one before"), document(2, None),
        document(3, ""), document(4, "  \n\t "), document(None, "a row that has no key of its own"), document(None, None, None, None),
        document(5, "long words " * 60_000 + "end"), document(6, "日本語の文章です。" * 3, "ja"), document(7, CAT, None), document(8, "12345 !!! ???", "de", None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")
