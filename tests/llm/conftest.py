import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words array<string>, score double, h1 string"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest test table."""
    return spark.read.parquet(str(TESTDATA / "documents.parquet"))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(20_000)) + "\n" + "a" * 30_000
    rows = [
        (1, None, "en", "a", 0, None, None, None),
        (2, "", "en", None, 0, [], 0.0, "x"),
        (3, " \t\n ", None, "b", 4, None, 1.0, "x"),
        (4, "one line of some ordinary words here\none line of some ordinary words here", "en", "a", 1, ["q"], 1.0, "y"),
        (4, "one line of some ordinary words here\none line of some ordinary words here", "en", "a", 1, ["q"], 1.0, "y"),
        (5, long, "en", "a", len(long), None, None, None),
        (6, "ünïcödé 🙂 text <|endoftext|> a@b.example +1 (212) 555-0100 4111 1111 1111 1111 10.0.0.1", "de", "b", 9, None, None, None),
        (None, "a text without an id", "en", "a", 1, None, None, None),
        (7, "1 " * 3000, "fr", "c", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where(F.lit(False))
