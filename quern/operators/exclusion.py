"""Benchmark exclusion: documents that share an n-gram of words, or a title, with held-out texts."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions.arrays import HashSet, Words, slices
from quern.functions.text import NO_WORD, folded, gram_hashes, grams, title_key, words
from quern.runtime import cut, ship, spread

SIZE = 13
#: Hashes of the exclusion side are held by every task only where it has at most so many grams (64 MB); beyond, it is shuffled.
BROADCAST_GRAMS = 4_000_000


def gram_rows(df: DataFrame, id_col: str, text: Column, n: int = SIZE) -> DataFrame:
    """(id, gram) of every run of n words; narrow before any shuffle."""
    return df.select(id_col, F.explode(grams(words(folded(text)), n)).alias("gram"))


def index_grams(benchmark: DataFrame, *texts: Column, n: int = SIZE) -> DataFrame:
    """Distinct grams of all given text columns."""
    rows = benchmark.select(F.explode(F.array(*texts)).alias("text"))
    return rows.select(F.explode(grams(words(folded(F.col("text"))), n)).alias("gram")).distinct()


def small(df: DataFrame, most: int = BROADCAST_GRAMS) -> DataFrame:
    """With a broadcast hint where the size is checked to be small, as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _spoken(text: Column) -> Column:
    """The words of a text, parted by single blanks."""
    return F.trim(F.regexp_replace(folded(text), NO_WORD, " "))


def _hashes(grams_: DataFrame, n: int) -> DataFrame:
    """Hashes of whole grams."""
    ship(grams_.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Words(batch.column(0)).grams(n)[1].view(np.int64))], ["hash"])

    return grams_.select("gram").mapInArrow(run, "hash long")


def gram_hits(docs: DataFrame, id_col: str, index: DataFrame, n: int = SIZE) -> DataFrame:
    """(id, gram) of the runs of words whose hash is one of the index's.

    The hashes of all runs of a slice of texts come from prefix sums, and are tested in the task against the hashes of the
    index, eight bytes a gram; only what hits becomes a row.  The caller compares the grams themselves.
    """
    spark = docs.sparkSession
    ship(spark)
    listed = _hashes(index, n).toArrow()  # the caller has checked how many there are
    known = spark.sparkContext.broadcast(HashSet(listed.column("hash").combine_chunks().to_numpy().view(np.uint64) if listed.num_rows else np.zeros(0, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words_ = Words(part.column(1))
                first, hashes = words_.grams(n)
                hits = first[known.value.places(hashes)]
                if len(hits):
                    found = [words_.text(k, n) for k in hits.tolist()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(words_.owner[hits])), pa.array(found)], [id_col, "gram"])

    schema = StructType([docs.schema[id_col], StructField("gram", StringType())])
    return spread(docs.select(id_col, "text")).select(id_col, _spoken(F.col("text")).alias("text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, id_col: str, index: DataFrame, n: int = SIZE) -> DataFrame:
    """Distinct ids of documents that share a gram with the index.

    Hashes of the index are tested inside the scan where they are few enough to be held by every task, and only hits are
    joined to the grams of the index.  Beside a larger index the hashes of all grams are shuffled, eight bytes each, and the
    grams themselves are compared in the documents that hold a hash of the index.
    """
    index = cut(index)
    texts = docs.select(id_col, "text")
    if index.count() <= BROADCAST_GRAMS:
        return gram_hits(texts, id_col, index, n).join(index, "gram", "left_semi").select(id_col).distinct()
    hashes = index.select(F.xxhash64(F.split("gram", " ")).alias("hash"))
    rows = texts.select(id_col, F.explode(gram_hashes(words(folded(F.col("text"))), n)).alias("hash"))
    likely = texts.join(rows.join(hashes, "hash", "left_semi").select(id_col).distinct(), id_col, "left_semi")
    return gram_rows(likely, id_col, F.col("text"), n).join(index, "gram", "left_semi").select(id_col).distinct()


def decontaminate(docs: DataFrame, id_col: str, index: DataFrame, titles: DataFrame | None = None, title_col: str | None = None) -> DataFrame:
    kept = docs.join(contaminated(docs, id_col, index), id_col, "left_anti")
    if titles is not None and title_col:
        keyed = kept.withColumn("__title", title_key(F.col(title_col)))
        kept = keyed.join(titles.select(F.col("title").alias("__title")), "__title", "left_anti").drop("__title")
    return kept


def extend_index(index: DataFrame, loaded: DataFrame, source: str, benchmark: DataFrame, *texts: Column) -> DataFrame:
    """The index with one more source, or as it is where ``loaded`` names that source."""
    if loaded.where(F.col("source") == source).limit(1).count():
        return index
    return index.unionByName(index_grams(benchmark, *texts)).distinct()


def rolling_hashes(parts: list[str], n: int = SIZE) -> np.ndarray:
    """Polynomial hashes (base 1,000,003, modulo 2**64) of word CRCs plus one, all windows at once."""
    if len(parts) < n:
        return np.zeros(0, np.uint64)
    values = np.array([zlib.crc32(w.encode()) + 1 for w in parts], np.uint64)
    last = len(parts) - n + 1
    out = np.zeros(last, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += values[i : i + last] * np.uint64(pow(1_000_003, n - 1 - i, 1 << 64))
    return out


_EXACT_WORD = re.compile(r"\w+")


def exact_hashes(text: str | None, n: int = SIZE) -> np.ndarray:
    """Rolling hashes of a text under the exact normalisation."""
    return rolling_hashes(_EXACT_WORD.findall(" ".join(unicodedata.normalize("NFKC", text or "").casefold().split())), n)


def hashed_grams(df: DataFrame, id_col: str, text_col: str, n: int = SIZE) -> DataFrame:
    """(id, hash) with the exact normalisation and the 64-bit rolling hash, as a decimal string of the unsigned value."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [exact_hashes(t, n) for t in part.column(1).to_pylist()]
                owners = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners)), pa.array(np.concatenate(found).view(np.int64))], [id_col, "hash"])

    return df.select(id_col, text_col).mapInArrow(run, StructType([df.schema[id_col], StructField("hash", LongType())]))


def hashed_contaminated(docs: DataFrame, id_col: str, benchmark: DataFrame, bench_id: str, text_col: str = "text", n: int = SIZE) -> DataFrame:
    """(id, hits): documents that share rolling hashes with the benchmark under the exact normalisation, and how many places."""
    index = cut(hashed_grams(benchmark, bench_id, text_col, n).select("hash").distinct())
    texts = spread(docs.select(id_col, text_col))
    if index.limit(BROADCAST_GRAMS + 1).count() > BROADCAST_GRAMS:
        found = hashed_grams(texts, id_col, text_col, n).join(index, "hash", "left_semi")
        return found.groupBy(id_col).agg(F.count(F.lit(1)).alias("hits"))
    # Few enough hashes are tested in the scan, a bounded amount of text at a time; only documents that hit become rows.
    listed = index.toArrow()
    known = docs.sparkSession.sparkContext.broadcast(HashSet(listed.column("hash").combine_chunks().to_numpy().view(np.uint64) if listed.num_rows else np.zeros(0, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hits = np.array([len(known.value.places(exact_hashes(t, n))) for t in part.column(1).to_pylist()], np.int64)
                some = np.flatnonzero(hits)
                if len(some):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(hits[some])], [id_col, "hits"])

    counted = texts.mapInArrow(run, StructType([docs.schema[id_col], StructField("hits", LongType())]))
    return counted.groupBy(id_col).agg(F.sum("hits").alias("hits"))
