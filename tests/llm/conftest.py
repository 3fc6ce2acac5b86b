import pytest
from pyspark.sql import Row, SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([Row(*r) for r in rows], DOCS) if rows else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture
def awkward(make_docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = "The quick brown fox. " * 8000
    return make_docs(
        [
            (1, None, None, None, None),
            (2, "", "en", "a", 0),
            (3, " \t\n", "en", "a", 3),
            (4, "one", "en", "b", 3),
            (5, long, "en", None, len(long)),
            (6, "x" * 100_000, None, "b", 100_000),
            (7, "same text here for you and me", "en", "a", 29),
            (7, "same text here for you and me", "en", "a", 29),
            (None, "a text without an id but with words", "fr", "c", 35),
            (9, "Nul\x00 byte, tabs\tand 'quotes'   and 漢字 𝔘 İJ̌", "xx", "ü", 40),
        ]
    )
