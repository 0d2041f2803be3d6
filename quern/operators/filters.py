"""Predicates and reject reasons; a null operand gives a reason or False, never a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import blocked_host, canonical_url, host

LEAST_CHARS, MOST_CHARS = 240, 200_000


def length_ok(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds; null where none does."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in cases))


def drop_blocked(df: DataFrame, url_col: str, domains: list[str]) -> DataFrame:
    return df.where(~blocked_host(host(F.col(url_col)), domains))


def prefer_origin(df: DataFrame, url_col: str, is_origin: Column, marker: str) -> DataFrame:
    """Rows of other sources whose canonical URL lies at the preferred origin are left out."""
    return df.where(is_origin | ~F.coalesce(F.contains(canonical_url(F.col(url_col)), F.lit(marker)), F.lit(False)))


def tokens_valid(tokens: Column, vocabulary: int) -> Column:
    return F.forall(tokens, lambda t: (t >= 0) & (t < vocabulary))


def without_special(tokens: Column, last_special: int = 3) -> Column:
    return F.filter(tokens, lambda t: t > last_special)


def truncate_tokens(tokens: Column, limit: int, end_id: int) -> Column:
    """At most ``limit`` ids with the end id last."""
    return F.when(F.size(tokens) > limit, F.concat(F.slice(tokens, 1, limit - 1), F.array(F.lit(end_id)))).otherwise(tokens)


def funnel(df: DataFrame, by: list[str], reason_col: str = "reason", kept: str = "kept") -> DataFrame:
    """Rows by reason; those without one count as kept."""
    return df.groupBy(*by, F.coalesce(reason_col, F.lit(kept)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stages(rows: DataFrame, reason: str, order: list[str]) -> DataFrame:
    """(stage, documents_in, documents_out) of a cascade: what each reason, in order, had before it and left."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(reason) == r, 1)).alias(f"r{i}") for i, r in enumerate(order)))
    made, left = [], F.col("n")
    for i, r in enumerate(order):
        made.append(F.struct(F.lit(r).alias("stage"), left.alias("documents_in"), (left - F.col(f"r{i}")).alias("documents_out")))
        left = left - F.col(f"r{i}")
    return counts.select(F.explode(F.array(*made)).alias("s")).select("s.*")
