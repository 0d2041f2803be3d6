import pytest

#: Nulls in every column, empty and long texts, ties, repeated rows.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 58),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 58),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 58),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "orphan text without an id", None, "b", 25),
    (None, None, None, None, None),
    (5, "x" * 300_000, "en", None, 300_000),
    (6, "wort " * 30_000, "de", "a", 150_000),
    (7, "ünïcode 漢字 🙂 \x00 nul and \t tabs\nand lines", "xx", "c", 10),
    (7, "another text under an id that repeats", "xx", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = ["fp", "slot", "key", "row_key", "kept", "hash", "size", "taken", "label", "score", "toxic", "text_key", "__text", "media", "found", "batch"]
    return df.select("*", *(F.lit("clash").alias(c) for c in extra))


@pytest.fixture(scope="session")
def plain(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}
