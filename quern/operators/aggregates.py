"""Corpus figures, metrics and reports as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numeric import perplexity
from quern.operators.windows import sums_before
from quern.runtime import cut


def corpus_stats(df: DataFrame, by: list[str], tokens: str, chars: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum(chars).alias("chars"))


def shares(df: DataFrame, value: str) -> DataFrame:
    """Each row's share of the total; the total is one row, so the join is a broadcast of a known size."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.col(value) / F.col("__total")).drop("__total")


def histogram(df: DataFrame, by: list[str], key: Column, name: str) -> DataFrame:
    return df.groupBy(*by, key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top_k(counts: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """The k largest counts of each group, ties by name."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col(name)))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def top_share(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.max("n").alias("top"), F.sum("n").alias("documents")).withColumn("share", F.col("top") / F.col("documents"))


def source_losses(records: DataFrame) -> DataFrame:
    """Per source: losses and tokens summed, then divided; never a mean of means."""
    sums = records.groupBy("source").agg(F.sum("nll_sum").alias("nll_sum"), F.sum("token_count").alias("token_count"), F.count(F.lit(1)).alias("documents"))
    nll = F.col("nll_sum") / F.col("token_count")
    return sums.withColumn("nll", nll).withColumn("perplexity", perplexity(nll))


def mixture_loss(records: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Fixed-weight mixture of source losses; unknown and empty sources and bad weights are errors."""
    if any(not w > 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must be positive and add up to one")
    spark = records.sparkSession
    table = F.broadcast(spark.createDataFrame(list(weights.items()), "source string, weight double"))
    joined = table.join(source_losses(records), "source", "full")
    bad = F.col("weight").isNull() | F.coalesce(F.col("token_count"), F.lit(0)).__le__(0)
    checked = joined.withColumn("weight", F.when(bad, F.raise_error(F.concat(F.lit("unexpected or empty source: "), F.col("source"))).cast("double")).otherwise(F.col("weight")))
    loss = F.sum(F.col("weight") * F.col("nll"))
    return checked.agg(loss.alias("nll")).withColumn("perplexity", perplexity(F.col("nll")))


def rank_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks of ties, from sums by distinct score.

    Scores are aggregated first; the running count runs over buckets of scores, so no task holds all rows.
    """
    by = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    lower = running(by, score, "n").withColumn("lower", F.col("upto") - F.col("n"))
    return lower.agg(
        ((F.sum(F.col("pos") * (F.col("lower") + (F.col("n") + 1) / 2)) - F.sum("pos") * (F.sum("pos") + 1) / 2) / (F.sum("pos") * (F.sum("n") - F.sum("pos")))).alias("auc")
    )


def running(df: DataFrame, order: str, value: str, descending: bool = False, parts: int | None = None) -> DataFrame:
    """A global running sum ``upto`` without a single task: range partitions, their totals, then sums within."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order).desc() if descending else F.col(order).asc()
    ranged = df.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id())
    # The totals are one row a partition; they name the partition, so both reads must see the same ranges.
    from quern.runtime import cut

    ranged = cut(ranged)
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    offset = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__part", offset.alias("__offset"))
    inner = F.sum(value).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(offsets), "__part").withColumn("upto", F.col("__offset") + inner).drop("__part", "__offset")


def weighted_threshold(scored: DataFrame, score: str, weight: Column, fraction: float) -> DataFrame:
    """The score at which the weight of the best-scored rows first reaches the fraction of all weight."""
    by = scored.groupBy(score).agg(F.sum(weight).alias("w"))
    total = by.agg(F.sum("w").alias("__total"))
    marked = running(by, score, "w", descending=True).crossJoin(F.broadcast(total))
    return marked.where(F.col("upto") >= fraction * F.col("__total")).agg(F.max(score).alias("threshold"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sorted[n // 2] of each group, exactly, nulls first.

    Equal values are added up before the shuffle, and the numbers before each value are sums over ranges of (group, value),
    so no task holds or sorts a group, however hot it is.
    """
    counted = cut(df.groupBy(*(F.col(b).alias(b) for b in by), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__k")))
    totals = counted.groupBy(*(F.col(b).alias(f"__of_{b}") for b in by)).agg(F.sum("__k").alias("__n"))
    placed = sums_before(counted, by, ["__v"], __at="__k")
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"__of_{b}")) for b in by))
    middle = F.floor(F.col("__n") / 2)
    found = placed.join(totals, same).where((F.col("__at") <= middle) & (middle < F.col("__at") + F.col("__k")))
    return found.select(*by, F.col("__v").alias("median"))


def parameter_mean(models: DataFrame) -> DataFrame:
    """Mean of each parameter over models of (model, name, idx, value); differing shapes are an error."""
    n = models.select("model").distinct().count()
    mean = models.groupBy("name", "idx").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col("__n") == n, F.col("value")).otherwise(F.raise_error(F.lit("models differ in shape")).cast("double"))
    return mean.select("name", "idx", checked.alias("value"))


def interpolate(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) * a + alpha * b by (name, idx); a parameter of one side alone is an error."""
    joined = a.withColumnRenamed("value", "__a").join(b.withColumnRenamed("value", "__b"), ["name", "idx"], "full")
    missing = F.col("__a").isNull() | F.col("__b").isNull()
    value = F.when(missing, F.raise_error(F.lit("models differ in shape")).cast("double")).otherwise((1 - alpha) * F.col("__a") + alpha * F.col("__b"))
    return joined.select("name", "idx", value.alias("value"))


def table_digest(df: DataFrame) -> DataFrame:
    """An order-insensitive digest of all rows, and their number."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("digest"), F.count(F.lit(1)).alias("n"))


def with_means(rows: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Rows (by, name, value) and one more of each group, named mean."""
    means = rows.groupBy(*by).agg(F.avg(value).alias(value)).withColumn(name, F.lit("mean"))
    return rows.select(*by, name, value).unionByName(means.select(*by, name, value))
