"""Readers, sinks and streams."""

import json

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.sources import readers, sinks
from quern.streaming import incremental


def test_lines_are_read_once_whatever_the_splits(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"id": str(i), "text": "t" * (i % 9)}) + "\n" for i in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (64, 777, 10_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.json_rows(spark, "id string, text string", str(path))
            assert sorted(int(r["id"]) for r in got.collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_zstd_lines_torn_tails_and_fallback_ids(spark, tmp_path):
    import zstandard

    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"source_id": "s1", "text": "x"}\n{"id": "", "source_id": "s2"}\n'))
    df = readers.json_rows(spark, "id string, source_id string, text string", str(tmp_path / "a.jsonl.zst"))
    got = [(r["id"], r["text"], r["title"]) for r in readers.normalized_rows(df, "web").orderBy("id").collect()]
    assert got == [("s1", "x", ""), ("s2", "", "")]
    (tmp_path / "j.jsonl").write_text('{"event": "a", "step": 1}\n{"event": "b", "st')
    assert readers.journal(spark, str(tmp_path / "j.jsonl"), "event string, step long").count() == 1
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.json_rows(spark, "event string, step long", str(tmp_path / "j.jsonl")).collect()


def test_threads_books_articles(spark):
    threads = spark.createDataFrame([(1, 3, 1, "T", "body"), (2, 0, 1, "T", "b"), (3, None, 1, "T", "b"), (4, 2, 1, None, "")], "Id long, Score long, AnswerCount long, Title string, ThreadText string")
    assert [(r["id"], r["url"]) for r in readers.thread_rows(threads, F.lit("site")).collect()] == [("site:1", "https://site/questions/1")]
    books = spark.createDataFrame([("7", "a" * 1500 + "\n\n" + "b" * 900)], "id string, body string")
    assert [r["id"] for r in readers.book_rows(books, 1600, 1000).collect()] == ["gutenberg:7:0"]
    lines = [" = A = ", "one", "", " == sub == ", " = B = ", "two"]
    folded = readers.article_fold(spark.createDataFrame(list(enumerate(lines)), "o long, t string"), "o", "t")
    assert sorted(r["text"] for r in folded.collect()) == [" = A = \none\n == sub == ", " = B = \ntwo"]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([("p", 2, [5, 2]), ("p", 1, [1, 65535, 2]), ("q", 1, [3])], "part string, o long, ids array<int>")
    got = {r["part"]: r for r in sinks.shard_rows(df, "part", "o", "ids").collect()}
    assert np.frombuffer(got["p"]["shard"], "<u2").tolist() == [1, 65535, 2, 5, 2] and got["p"]["documents"] == 2
    (tmp_path / "a.bin").write_bytes(bytes(got["p"]["shard"]))
    back = readers.token_shards(spark, str(tmp_path / "a.bin")).orderBy("pos").collect()
    assert [r["token"] for r in back] == [1, 65535, 2, 5, 2]
    with pytest.raises(PySparkException):
        sinks.shard_rows(df.withColumn("ids", F.array(F.lit(70_000))), "part", "o", "ids").collect()


def test_numbered_shards_hold_whole_texts(spark):
    """250 tokens of a document are all there, in shards of 100 whatever the documents' bounds."""
    rows = [("p", 2, list(range(250))), ("p", 1, [7] * 30), ("p", 3, []), ("q", 1, [3])]
    df = spark.createDataFrame(rows, "part string, o long, ids array<int>")
    got = sorted(sinks.numbered_shards(df, "part", "o", "ids", 100).collect())
    assert [(r["part"], r["number"], r["tokens"], r["documents"]) for r in got] == [("p", 0, 100, 2), ("p", 1, 100, 0), ("p", 2, 80, 1), ("q", 0, 1, 1)]
    whole = np.concatenate([np.frombuffer(r["shard"], "<u2") for r in got[:3]])
    assert whole.tolist() == [7] * 30 + list(range(250))


def test_frozen_records_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x long")
    sinks.freeze(df, str(tmp_path / "r"))
    with pytest.raises(PySparkException):
        sinks.freeze(df, str(tmp_path / "r"))
    sinks.publish_manifest(spark, {"t": df}, str(tmp_path / "m"))
    assert sinks.open_manifest(spark, str(tmp_path / "m"))["t"].count() == 1
    sinks.publish_json(spark, str(tmp_path / "m" / "manifest.json"), {"status": "writing", "tables": {}})
    with pytest.raises(ValueError):
        sinks.open_manifest(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        sinks.publish_json(spark, str(tmp_path / "n.json"), {"x": float("nan")})
    for k in (1, 2):
        sinks.append_events(df.withColumn("writer", F.lit(k)), str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 2
    with pytest.raises(ValueError):
        readers.exactly_one(df.limit(0), "record")
    with pytest.raises(PySparkException):
        readers.required(spark.createDataFrame([("",)], "id string"), "id").collect()


def test_pinned_files():
    paths = ["b/2.parquet", "a/1.parquet", "a/0.json", "c/3.parquet"]
    assert readers.select_files(paths, suffix=".parquet", allowed={"a", "b"}) == ["a/1.parquet", "b/2.parquet"]
    seeded = readers.select_files(paths, suffix=".parquet", seed="s")
    assert sorted(seeded) == ["a/1.parquet", "b/2.parquet", "c/3.parquet"] and seeded[1:2] == readers.select_files(paths, suffix=".parquet", seed="s", first=1, count=1)


def test_stream_reads_new_files_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def start():
        stream = incremental.file_stream(spark, source, "doc_id long, text string")
        incremental.run_available(incremental.distinct_documents(stream).select("doc_id", "digest"), incremental.idempotent(out), mark)
        return spark.read.parquet(out).count()

    spark.createDataFrame([(1, "Hello  World"), (2, "other")], "doc_id long, text string").write.mode("append").parquet(source)
    assert start() == 2 and start() == 2
    spark.createDataFrame([(3, "hello world"), (4, "new")], "doc_id long, text string").write.mode("append").parquet(source)
    assert start() == 3
