"""Registration of queries beside their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.runtime import read as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL twin of the portable normalisation, for a column or expression.
NORMAL = r"trim(regexp_replace(replace(lower({0}),'ß','ss'),'\s+',' ','g'))"
WORDS = r"regexp_extract_all({0},'[\p{{L}}\p{{N}}_]+')"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def normal(column: str) -> str:
    return NORMAL.format(column)


def words(column: str) -> str:
    return WORDS.format(column)


def grams_of(words_column: str, n: int = 13) -> str:
    """SQL twin of the list of n-grams of a word list."""
    return f"list_transform(range(1, len({words_column}) - {n - 2}), lambda i: array_to_string(list_slice({words_column}, i, i + {n - 1}), ' '))"


__all__ = ["ORACLE_SQL", "QUERIES", "grams_of", "normal", "query", "table", "words"]
