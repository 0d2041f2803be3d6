"""Deterministic samples and shuffles: all randomness is a hash of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of MD5, the same in Spark and in SQL engines."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id_col.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shuffled(df: DataFrame, id_col: str, seed: str) -> DataFrame:
    """A total order that depends on seed and id alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)


def weighted_sample(df: DataFrame, id_col: str, weight: Column, n: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """n rows without replacement, in proportion to weight, by exponential keys; a bounded top-n, no full sort."""
    rows = df if exclude is None else df.join(exclude.select(id_col).distinct(), id_col, "left_anti")
    keyed = rows.where(weight > 0).withColumn("key", -F.log(uniform(F.col(id_col), seed)) / weight)
    return keyed.orderBy("key", id_col).limit(n)


def mixture_draw(positions: DataFrame, position: str, weights: dict[str, float], seed: str) -> DataFrame:
    """A source for each position, independently, with the given weights."""
    u, total, upto = uniform(F.col(position), seed), sum(weights.values()), 0.0
    chosen = None
    for name, w in weights.items():
        upto += w / total
        chosen = F.when(u < upto, name) if chosen is None else chosen.when(u < upto, name)
    return positions.withColumn("source", chosen.otherwise(list(weights)[-1]))


def thinned(df: DataFrame, id_col: str, seed: str, keep_one_in: int) -> DataFrame:
    return df.where(uniform(F.col(id_col), seed) < 1.0 / keep_one_in)


def group_cap(df: DataFrame, by: list[str], id_col: str, seed: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, in hash order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(uniform(F.col(id_col), seed), F.col(id_col)))
    return df.withColumn("rank", rank).where(F.col("rank") <= cap)


def epoch_budget(needs: DataFrame, most_epochs: float) -> DataFrame:
    """(source, consumed, need, available) where all sources stay within their epochs; else an error before any advance."""
    over = F.col("consumed") + F.col("need") > F.col("available") * most_epochs
    worst = needs.agg(F.max(F.when(over, F.col("source"))).alias("__over"))
    checked = needs.crossJoin(F.broadcast(worst))
    return checked.where(F.when(F.col("__over").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("epoch budget: "), F.col("__over"))).cast("boolean"))).drop("__over")


def matched_passages(docs: DataFrame, id_col: str, words: Column, lengths: DataFrame, seed: str) -> DataFrame:
    """A passage of each document whose length is drawn from ``lengths(nth, length)``, by hash; one lookup a document."""
    n = lengths.count()
    u = uniform(F.col(id_col), seed)
    drawn = docs.withColumn("__w", words).withColumn("nth", F.floor(u * n).cast("long"))
    joined = drawn.join(lengths, "nth")
    room = F.greatest(F.lit(1), F.size("__w") - F.col("length"))
    start = F.floor(uniform(F.concat(F.col(id_col).cast("string"), F.lit("/start")), seed) * room).cast("int")
    return joined.select(id_col, "length", start.alias("start"), F.array_join(F.slice("__w", start + 1, F.col("length").cast("int")), " ").alias("passage"))
