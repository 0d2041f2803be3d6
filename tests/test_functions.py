"""Golden cases of the text and numeric functions."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import numeric, text


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


def test_equal_digest_and_split(spark):
    a, b = "HELLO  world\n", "hello world"
    for fn in (text.normalize, text.normalize_exact):
        assert one(spark, text.digest(fn(F.col("t"))), t=a) == one(spark, text.digest(fn(F.col("t"))), t=b)
    assert one(spark, text.split_of(text.digest(text.normalize(F.col("t")))), t=a) in [*text.HELD_OUT_SPLITS, "train"]


def test_exact_normalisation(spark):
    for t in ("Straße ﬁne", "ＡＢＣ　x", "İstanbul", "a b\x1cc"):
        assert one(spark, text.normalize_exact(F.col("t")), t=t) == " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def test_digest_bucket_is_unsigned(spark):
    assert one(spark, text.digest_bucket(F.col("d"), 1000), d="f" * 64) == int("f" * 16, 16) % 1000


@pytest.mark.parametrize("url, blocked", [("https://www.wikihow.com/x", True), ("http://es.wikihow.com", True), ("http://notwikihow.com/", False), ("http://wikihow.com:80/", False), ("http://u@wikihow.com/", False), (None, False)])
def test_blocklist(spark, url, blocked):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(text.blocked_host(text.host(F.col("u")), ["wikihow.com"]).alias("x")).first()["x"] == blocked


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("http://www.example.com/a/#heading", "https://example.com/a"),
        ("https://example.com/a?id=1", "https://example.com/a?id=1"),
        ("HTTP://WWW.Example.com", "https://example.com"),
        ("http://e.com/a+b%20c/%zz", "https://e.com/a+b%20c/%zz"),
        ("http://e.com/a+b%20c", "https://e.com/a+b c"),
        ("no authority", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, canonical):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(text.canonical_url(F.col("u")).alias("x")).first()["x"] == canonical


def test_books_threads_and_chunks(spark):
    book = "junk\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\nPara one.\r\n\r\nPara two.\n*** END OF THIS PROJECT GUTENBERG EBOOK"
    assert one(spark, text.clean_book(F.col("t")), t=book) == "Para one.\n\nPara two."
    assert one(spark, text.paragraph_chunks(F.col("t"), 12), t="a" * 10 + "\n\n" + "b" * 10) == ["a" * 10, "b" * 10]
    assert one(spark, text.paragraph_chunks(F.col("t"), 40), t="a" * 10 + "\n \n" + "b" * 10) == ["a" * 10 + "\n\n" + "b" * 10]
    thread = "(Asked by: username_1 on 2020)\nQ\n\n\n\n### Answer by username_22 on 2021\n**username_3**: yes"
    cleaned = one(spark, text.clean_thread(F.col("t")), t=thread)
    assert "username_" not in cleaned and "### Answer" in cleaned


def test_grams_and_windows(spark):
    words = " ".join(f"w{i}" for i in range(65 * 60))
    got = one(spark, text.word_windows(F.split("t", " ")), t=words)
    assert len(got) == 64 and got[63].split()[0] == f"w{int(63 * 65 / 64) * 60}"
    assert one(spark, text.grams(F.split("t", " "), 13), t=" ".join("abcdefghijkl")) == []
    assert len(one(spark, text.grams(F.split("t", " "), 13), t=" ".join("abcdefghijklm"))) == 1


def test_endings_and_capitals(spark):
    assert one(spark, text.clean_ending(F.col("t")), t=" Roof [title] a [x] b  c ") == "Roof. a b c"
    assert one(spark, text.capitalize(F.col("t")), t="hELLO There") == "Hello there"


def test_schedules(spark):
    steps = spark.range(9).select(numeric.warmup_stable_decay(F.col("id"), 1.0, 2, 0.1, 5, 3).alias("x"))
    assert [round(r["x"], 6) for r in steps.collect()] == [0.5, 1, 1, 1, 1, 0.7, 0.4, 0.1, 0.1]
    assert one(spark, numeric.perplexity(F.col("x")), x=710.0) is None
    assert math.isclose(one(spark, numeric.perplexity(F.col("x")), x=2.0), math.exp(2))


def test_permutations_against_python(spark):
    for h in (0, 1, 4294967295, 123456789):
        for i in (0, 7, 31):
            a, b = numeric.permutation(i)
            assert a % 2 == 1
            assert one(spark, numeric.permuted(F.col("h"), i), h=h) == (a * h + b) % numeric.MERSENNE & 0xFFFFFFFF
