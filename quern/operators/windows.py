"""Offsets, budgets, quotas, moving figures and scoring plans as window and array expressions."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import let
from quern.runtime import cut


def sums_before(df: DataFrame, by: list[str], order: list[str], **sums: str) -> DataFrame:
    """Columns (name=value) that sum a value over the rows before each row of its group; ``order`` is unique in a group.

    No task holds a group: rows are dealt to ranges of group and order, each range adds up what it holds, and a group
    that began in earlier ranges gets their totals, which are one row a range at most.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part", *by).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"__{n}") for n, v in sums.items()))
    across = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    groups = [F.col(b).alias(f"__by_{b}") for b in by]
    earlier = totals.select(F.col("__part").alias("__of"), *groups, *(F.sum(f"__{n}").over(across).alias(f"__{n}") for n in sums)).where(F.col(f"__{next(iter(sums))}").isNotNull())
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by), F.col("__part") == F.col("__of"))
    inner = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(earlier), same, "left")
    made = {n: F.coalesce(F.col(f"__{n}"), F.lit(0)) + F.coalesce(F.sum(v).over(inner), F.lit(0)) for n, v in sums.items()}
    return joined.withColumns(made).drop("__part", "__of", *(f"__by_{b}" for b in by), *(f"__{n}" for n in sums))


def exact_cut(df: DataFrame, value: str, by: list[str], order: list[str], target: int) -> DataFrame:
    """Rows up to the budget, the last one shortened to meet it: offset and taken."""
    marked = sums_before(df, by, order, offset=value).where(F.col("offset") < target)
    return marked.withColumn("taken", F.least(F.col(value), target - F.col("offset")))


def whole_rows(df: DataFrame, value: str, by: list[str], order: list[str], target: int) -> DataFrame:
    """Whole rows while the sum before them is under the budget; else surplus."""
    marked = sums_before(df, by, order, offset=value)
    return marked.withColumn("reason", F.when(F.col("offset") >= target, "surplus_train"))


def head_by(df: DataFrame, value: str, by: list[str], order: list[str], target: int) -> DataFrame:
    """Rows of each group up to and with the one that reaches the target; a group that never reaches it is an error."""
    short = df.groupBy(*by).agg(F.sum(value).alias("__sum")).where(F.coalesce("__sum", F.lit(0)) < target).limit(1).collect()
    if short:
        raise ValueError(f"{tuple(short[0])[:-1]} holds {short[0]['__sum']} of {target}")
    return sums_before(df, by, order, __at=value).where(F.col("__at") < target).drop("__at")


def quota(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group; each task takes its own first ones (WindowGroupLimit) before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def best(df: DataFrame, by: list[str], score: Column, tie: str) -> DataFrame:
    """The row with the highest score of each group, the smallest tie first."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), F.col(tie)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def last_write(df: DataFrame, key: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def moving_average(value: str, by: list[str], order: str, rows: int = 50) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0))


def score_plan(n: Column, context: int, stride: int) -> Column:
    """Windows of a document of n tokens: start, end and first target; every target is scored once.

    The first token of a window has no context there, so windows must overlap: stride < context.
    """
    if not 0 < stride < context:
        raise ValueError("every target is scored once only where 0 < stride < context")
    last = F.greatest(F.ceil((n - context) / stride), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)

    def one(s: Column) -> Column:
        previous = F.when(s == 0, 1).otherwise(F.least(s - stride + context, n))
        return F.struct(s.cast("long").alias("start"), F.least(s + context, n).cast("long").alias("end"), F.greatest(previous, s + 1).cast("long").alias("first_target"))

    return F.when(n >= 2, F.filter(F.transform(starts, one), lambda w: w["end"] > w["first_target"])).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,first_target:bigint>>")
    )


def eval_chunks(tokens: Column, context: int) -> Column:
    """Chunks of context + 1 tokens that overlap by one."""

    def made(t: Column) -> Column:
        starts = F.when(F.size(t) >= 2, F.sequence(F.lit(0), F.greatest(F.size(t) - 2, F.lit(0)), F.lit(context))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(t, s + 1, context + 1))

    return let(tokens, made)


def shifted_pairs(tokens: Column) -> Column:
    """(input, target) of each next-token prediction."""
    n = F.size(tokens)
    return F.when(n >= 2, F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("x"), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("y"))).otherwise(
        F.array().cast("array<struct<x:int,y:int>>")
    )


def circular(position: Column, total: int) -> tuple[Column, Column]:
    """(cycle, cursor) of a position in an endlessly repeated sequence."""
    return F.floor(position / total).cast("long"), F.pmod(position, F.lit(total)).cast("long")


def stream_signature(shards: list[tuple[str, int]]) -> str:
    """Digest of the files and lengths that a stream of tokens runs over."""
    return hashlib.sha256(json.dumps([[name, n] for name, n in shards]).encode()).hexdigest()


def stream_state(shards: list[tuple[str, int]], consumed: int) -> dict:
    """State of a circular stream after so many tokens."""
    total = sum(n for _, n in shards)
    return {"signature": stream_signature(shards), "cycles": consumed // total, "cursor": consumed % total, "consumed": consumed}


def resumed(state: dict, shards: list[tuple[str, int]]) -> int:
    """Tokens consumed by a saved state; another set of shards or figures that disagree are errors."""
    total = sum(n for _, n in shards)
    if state["signature"] != stream_signature(shards):
        raise ValueError("the stream's shards are not those of the saved state")
    if not 0 <= state["cursor"] < total or state["cycles"] * total + state["cursor"] != state["consumed"]:
        raise ValueError("the saved state disagrees with itself")
    return state["consumed"]
