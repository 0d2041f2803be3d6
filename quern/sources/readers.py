"""Scans: JSON lines, threads, books, articles, journals, shards and run records as typed tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import ARTICLE_HEADING, clean_book, clean_thread, paragraph_chunks
from quern.operators.windows import sums_before
from quern.runtime import ship


def parquet_rows(spark: SparkSession, *paths: str, start: int = 0) -> DataFrame:
    """Rows of Parquet files with their file and place in it; resuming skips rows below ``start``."""
    df = spark.read.parquet(*paths)
    placed = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return placed.where(F.col("row") >= start) if start else placed


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Files under a glob of any file system that Spark knows, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile())


def figure(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a figure's data table, which holds one list for each column."""
    kinds = [k.split() for k in schema.split(", ")]
    columns = spark.read.schema(", ".join(f"{name} array<{kind}>" for name, kind in kinds)).option("multiLine", True).json(path)
    return columns.select(F.inline(F.arrays_zip(*(name for name, _ in kinds))))


def json_rows(spark: SparkSession, schema: str | StructType, *paths: str, strict: bool = True) -> DataFrame:
    """JSON lines, plain or compressed (gzip, bzip2, zstd); strict reading fails at a bad line, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(list(paths))


def normalized_rows(df: DataFrame, source: str) -> DataFrame:
    """Common columns; an empty id falls back to source_id, an absent title to an empty one."""
    have = df.columns
    ident = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "source_id") if c in have] or [F.lit(None).cast("string")]
    return df.select(
        F.coalesce(*ident).alias("id"),
        (F.col("url") if "url" in have else F.lit(None).cast("string")).alias("url"),
        (F.coalesce("title", F.lit("")) if "title" in have else F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(source).alias("source"),
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def thread_rows(df: DataFrame, site: Column) -> DataFrame:
    """Answered threads with a score of one or more."""
    kept = df.where((F.coalesce("Score", F.lit(0)) >= 1) & (F.coalesce("AnswerCount", F.lit(0)) >= 1) & (F.coalesce("ThreadText", F.lit("")) != ""))
    return kept.select(
        F.concat_ws(":", site, F.col("Id").cast("string")).alias("id"),
        F.concat(F.lit("https://"), site, F.lit("/questions/"), F.col("Id").cast("string")).alias("url"),
        F.coalesce("Title", F.lit("")).alias("title"),
        clean_thread(F.col("ThreadText")).alias("text"),
    )


def book_rows(df: DataFrame, chunk_chars: int = 20_000, least: int = 1000) -> DataFrame:
    """Chunks of books; the text column is ``text`` or else the last one."""
    ship(df.sparkSession)
    text = "text" if "text" in df.columns else df.columns[-1]
    ident = F.col("id").cast("string") if "id" in df.columns else F.monotonically_increasing_id().cast("string")
    chunks = df.select(ident.alias("book"), F.posexplode(paragraph_chunks(clean_book(F.coalesce(F.col(text), F.lit(""))), chunk_chars)).alias("j", "text"))
    return chunks.where(F.length("text") >= least).select(F.concat(F.lit("gutenberg:"), F.col("book"), F.lit(":"), F.col("j")).alias("id"), "text")


def article_fold(df: DataFrame, order: str, text: str, by: list[str] | None = None) -> DataFrame:
    """Ordered paragraphs folded into articles at level-one headings; blank rows go, the id is the digest.

    ``by`` names the streams of paragraphs (files); without it, all rows are one stream.  Articles are numbered by
    running sums over ranges, so no task holds a stream.
    """
    by = by or []
    heading = F.trim(F.col(text)).rlike(ARTICLE_HEADING).cast("long")
    numbered = sums_before(df.where(F.trim(F.col(text)) != "").withColumn("__heading", heading), by, [order], __before="__heading")
    marked = numbered.withColumn("__article", F.col("__before") + F.col("__heading"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    folded = marked.groupBy(*by, "__article").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("paragraphs"))
    return folded.select(*by, F.sha2("text", 256).alias("id"), "text", "paragraphs")


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as they are; a null or empty required field is an error that names it."""
    for c in columns:
        missing = F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
        df = df.where(F.when(missing, F.raise_error(F.lit(f"missing {c}")).cast("boolean")).otherwise(F.lit(True)))
    return df


def missing_fields(df: DataFrame, *columns: str) -> DataFrame:
    """(field, missing) of each required column: how many rows lack it."""
    counts = df.agg(*(F.count(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1)).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns))).alias("m")).select("m.field", "m.missing")


def unique_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows as they are; a key that several rows hold is an error that names it."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).collect()
    if again:
        raise ValueError(f"duplicate identity {tuple(again[0])[:-1]}")
    return df


def token_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, pos, token) of little-endian uint16 shards."""
    ship(spark)
    files = spark.read.format("binaryFile").load(list(paths))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                tokens = np.frombuffer(content, "<u2").astype(np.int32)
                for i in range(0, len(tokens), 1 << 16):
                    part = tokens[i : i + (1 << 16)]
                    yield pd.DataFrame({"file": path, "pos": np.arange(i, i + len(part)), "token": part})

    return files.select("path", "content").mapInPandas(run, "file string, pos long, token int")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event lines; a torn last line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def run_records(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row per JSON document under a glob, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("path"))


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    n = df.limit(2).count()
    if n != 1:
        raise ValueError(f"expected one {what}, found {'none' if n == 0 else 'several'}")
    return df


def load_or_gap(spark: SparkSession, sources: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables that can be read, and a status row for every source; a missing one is a recorded gap."""
    from pyspark.errors import AnalysisException

    loaded, rows = {}, []
    for name, path in sources.items():
        try:
            loaded[name] = spark.read.parquet(path)
            rows.append((name, "loaded", None))
        except AnalysisException as e:
            rows.append((name, "unavailable", str(e).split("\n")[0][:200]))
    return loaded, spark.createDataFrame(rows, "source string, status string, error string")


def select_files(paths: list[str], prefix: str = "", suffix: str = "", allowed: set[str] | None = None, seed: str = "", first: int = 0, count: int | None = None) -> list[str]:
    """Pinned files: filtered, put in a seeded order, then a slice of it."""
    import hashlib

    own = [p for p in sorted(paths) if p.startswith(prefix) and p.endswith(suffix) and (allowed is None or p.split("/")[0] in allowed)]
    if seed:
        own.sort(key=lambda p: hashlib.sha256(f"{seed}:{p}".encode()).digest())
    return own[first : None if count is None else first + count]
