"""Mix sources to target weights by hash-threshold histograms, without sorting documents.

Every document has a 60-bit hash of its id.  A source takes the documents below one threshold, once
more than whole epochs of it.  The threshold comes from histograms: words are summed by source and the
leading 12 bits, a running sum finds the bucket in which the budget ends, and only that bucket is
summed again by the next 12 bits, until one hash remains.  The documents of that last hash share what
is left of the budget, so that a source's words meet its target to within rounding.

Results that are defined: a null text has size 0; a null source is a source of its own, after all
others; repeated ids have one hash and share their part evenly; empty sources take nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quern.llm.common import narrow
from quern.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
DIGIT_BITS = 12
HASH_BITS = 60
#: Weights belong to named sources, so their number has a bound; more is an error, never a silent cut.
MAX_SOURCES = 100_000


def hash60(doc_id: Column, seed: str) -> Column:
    """Leading 60 bits of MD5 over the seed and the id, 0 for a null id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to the weights, none above cap * size, that add up to share * all sizes.

    Capped sources come first by size per weight; the rest share what remains.
    """
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight = share * sum(sizes), float(sum(weights))
    targets = [0.0] * len(sizes)
    for n, i in enumerate(order):
        if cap * sizes[i] >= left * weights[i] / weight:
            for j in order[n:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = cap * sizes[i]
        left -= targets[i]
        weight -= weights[i]
    return targets


def _targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"))
    rows = [(r["source"], int(r["n"])) for r in totals.limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    each = [weights[i % len(weights)] for i in range(len(rows))]
    goal = water_fill([n for _, n in rows], each, share, cap)
    data = []
    for (source, n), target in zip(rows, goal):
        words = round(target)
        epochs = words // n if n else 0
        data.append((source, n, target, epochs, words - epochs * n))
    schema = StructType(
        [
            StructField("source", StringType()),
            StructField("source_size", LongType()),
            StructField("target", DoubleType()),
            StructField("epochs", LongType()),
            StructField("budget", LongType()),
        ]
    )
    return spark.createDataFrame(data, schema)


def _boundary(sized: DataFrame, budgets: DataFrame) -> list[tuple]:
    """(source, hash, words left at it, words with it) of the sources whose budget ends inside one."""
    spark = sized.sparkSession
    found: list[tuple] = []
    open_rows = [(r["source"], 0, r["budget"]) for r in budgets.where("budget > 0").collect()]
    shape = StructType([StructField("source", StringType()), StructField("prefix", LongType()), StructField("left", LongType())])
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        if not open_rows:
            break
        here = F.broadcast(spark.createDataFrame(open_rows, shape))  # a row a source at most
        inside = sized.join(here, sized["source"].eqNullSafe(here["source"]) & (F.shiftrightunsigned(sized["hash"], shift + DIGIT_BITS) == here["prefix"]))
        sums = inside.groupBy(here["source"], here["left"], F.shiftrightunsigned(sized["hash"], shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = sums.withColumn("upto", F.sum("n").over(run)).where("upto - n < left and left <= upto").collect()
        open_rows = []
        for r in at:
            rest = r["left"] - (r["upto"] - r["n"])
            if r["low"] == r["high"]:
                found.append((r["source"], r["low"], rest, r["n"]))
            else:
                open_rows.append((r["source"], r["bucket"], rest))
    return found


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, taken, text_key."""
    docs = narrow(df, id_col, text_col, source_col).withColumnRenamed(source_col, "source")
    sized = cut(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            hash60(F.col("doc_id"), seed).alias("hash"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        )
    )
    targets = cut(_targets(sized, weights, share, cap))
    shape = StructType([StructField("of", StringType()), *(StructField(c, LongType()) for c in ("edge", "rest", "tied"))])
    edges = sized.sparkSession.createDataFrame(_boundary(sized, targets), shape)
    plan = targets.join(edges, targets["source"].eqNullSafe(edges["of"]), "left").drop("of").withColumnRenamed("source", "of")
    joined = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(F.col("of")))
    part = (
        F.when(F.col("edge").isNull(), F.lit(0))
        .when(F.col("hash") < F.col("edge"), F.col("size"))
        .when(F.col("hash") == F.col("edge"), F.floor(F.col("size").cast("decimal(19,0)") * F.col("rest") / F.col("tied")).cast("long"))
        .otherwise(F.lit(0))
    )
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "text_key")


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word, white space as it was."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), n), "")
