"""Builds over byte ranges of large files, which go on where they were stopped.

Every range of every source is a part.  Some parts are built together as one Spark job, written each to a folder of its own,
and then entered in a ledger by one rename; a reader goes by the ledger alone.  A start builds what the ledger lacks: a part
that was written but not entered is written again in its place, and none that was entered is read a second time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import blocked_host, digest, host, normalize, panel_of
from quern.operators import tokenizing
from quern.sources import ranges, sinks
from quern.sources.readers import listed


#: Small ranges are built together until they are so many bytes.
JOB_BYTES = 2 << 30


@dataclass(frozen=True)
class Part:
    source: str
    path: str
    start: int
    end: int

    @property
    def name(self) -> str:
        """The same in every run: source, place, and a digest of the path."""
        return f"{self.source}-{hashlib.sha256(self.path.encode()).hexdigest()[:12]}-{self.start:015d}-{self.end:015d}"


def parts_of(files: dict[str, list[str]], range_bytes: int) -> list[Part]:
    """All ranges of the files, by source and file; the last of a file ends with it."""
    out = []
    for source, paths in files.items():
        for path in paths:
            size = ranges.size_of(path)
            out += [Part(source, path, a, min(size, a + range_bytes)) for a in range(0, size, range_bytes)]
    return out


def entered(spark: SparkSession, folder: str) -> set[str]:
    """Names of the parts in the ledger: a few bytes for each range of hundreds of megabytes."""
    if not listed(spark, f"{folder}/ledger/*.json"):
        return set()
    rows = spark.read.schema("parts array<string>").option("multiLine", True).json(f"{folder}/ledger/*.json")
    return {r["part"] for r in rows.select(F.explode("parts").alias("part")).collect()}


def build_parts(
    spark: SparkSession,
    files: dict[str, list[str]],
    folder: str,
    schema: str,
    work: Callable[[DataFrame], DataFrame],
    range_bytes: int = ranges.RANGE_BYTES,
    together: int | None = None,
    sources: list[str] | None = None,
) -> list[Part]:
    """Build what the ledger lacks of the given sources, ``together`` ranges a job; returns the parts that were built.

    By default a job has 64 ranges, and as many as hold 2 GB where ranges are small, as each job has its fixed cost.

    ``work`` gets the rows of JSON lines with source, part, file, start and _position, and keeps the column part.  The
    size of ranges belongs to the folder: another one there is an error.
    """
    together = together or max(64, JOB_BYTES // range_bytes)
    want = {"range_bytes": range_bytes, "schema": schema}
    if listed(spark, f"{folder}/ranges.json"):
        have = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/ranges.json").collect()))
        if have != want:
            raise ValueError("the folder holds parts of other ranges")
    else:
        sinks.publish_json(spark, f"{folder}/ranges.json", want)
    done = entered(spark, folder)
    chosen = {s: paths for s, paths in files.items() if sources is None or s in sources}
    todo = [p for p in parts_of(chosen, range_bytes) if p.name not in done]
    for source in chosen:
        own = [p for p in todo if p.source == source]
        for k in range(0, len(own), together):
            some = own[k : k + together]
            rows = work(_rows(spark, some, schema, range_bytes))
            rows.write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/parts")
            sinks.publish_json(spark, f"{folder}/ledger/{some[0].name}.json", {"parts": [p.name for p in some]})
    return todo


def _rows(spark: SparkSession, parts: list[Part], schema: str, range_bytes: int) -> DataFrame:
    """Lines that begin in the given ranges."""
    rows = ranges.json_lines(spark, schema, *(p.path for p in parts), spans=[(p.path, p.start, p.end) for p in parts], range_bytes=range_bytes)
    names = spark.createDataFrame([(p.path, p.start // range_bytes, p.source, p.name) for p in parts], "__path string, __range long, source string, part string")
    same = (F.col("file") == F.col("__path")) & (F.floor(F.col("start") / range_bytes) == F.col("__range"))
    return rows.join(F.broadcast(names), same).drop("__path", "__range")  # a row a range of one job


def built(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the parts in the ledger, and of no others."""
    names = spark.createDataFrame([(n,) for n in sorted(entered(spark, folder))], "part string")
    return spark.read.parquet(f"{folder}/parts").join(names, "part", "left_semi")


def reused_rows(blocklist: tuple[str, ...] = (), tokenizer: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Work of the reused corpus: rejected hosts go, the rest gets a digest, a panel or none, and its ids with an end."""

    def work(rows: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        made = rows.withColumns({
            "reason": F.when(blocked_host(host(F.col("url")), list(blocklist)), "domain_blocklist"),
            "digest": digest(normalize(text)),
            "chars": F.length(text),
            "origin": F.element_at(F.split("file", "/"), -1),
        })
        encoded = tokenizing.encode(made.withColumn("panel", panel_of(F.col("digest"))), "text", tokenizer)
        ids = F.when(F.col("reason").isNull(), F.col("ids")).otherwise(F.array().cast("array<int>"))
        return encoded.withColumn("ids", ids).drop("text", "file", "start", "_position")

    return work
