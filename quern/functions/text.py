"""Text functions as columns: normalisation, digests, words, grams, URLs, cleaners.

Two normalisations exist.  ``normalize`` uses built-in functions and has a SQL twin; ``normalize_exact``
applies NFKC and full case folding in an Arrow UDF.  They agree but for compatibility characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and names that results depend on.
WORD = r"[\p{L}\p{N}_]+"
NO_WORD = r"[^\p{L}\p{N}_]+"
MARK = r"([^\p{L}\p{N}_\s])"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
HELD_OUT_SPLITS = [
    "controller_0_proposal",
    "controller_0_confirm",
    "controller_1_proposal",
    "controller_1_confirm",
    "controller_2_proposal",
    "controller_2_confirm",
    "selection",
    "final",
    "monitor",
]
PANELS = ["monitor", "development", "selection", "final"]
BOOK_START = r"(?i)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG[^\n]*\n"
BOOK_END = r"(?i)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG"
ARTICLE_TITLE = r"^\s*=\s+([^=]+?)\s+=\s*$"
ARTICLE_HEADING = r"^\s*=\s+[^=].*?\s+=\s*$"


def normalize(text: Column) -> Column:
    """Lower case with sharp s spelt out, single blanks."""
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


@F.arrow_udf(StringType())
def normalize_exact(text: pa.Array) -> pa.Array:
    """NFKC, full case folding and single blanks; 16 texts are held as Python strings at a time."""
    done = []
    for k in range(0, len(text), 16):
        done.append(pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in text.slice(k, 16).to_pylist()], pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def digest(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def digest_bucket(hexadecimal: Column, buckets: int, digits: int = 16) -> Column:
    """Leading hex digits as an unsigned number, modulo the buckets; 64 bits do not fit a long, so decimal."""
    value = F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("decimal(20,0)")
    return (value % F.lit(buckets).cast("decimal(20,0)")).cast("int")


def named_bucket(hexadecimal: Column, names: list[str], buckets: int, default: str | None) -> Column:
    """The name of a small bucket, the default for all others."""
    bucket = digest_bucket(hexadecimal, buckets)
    listed = F.element_at(F.array(*map(F.lit, names)), F.least(bucket + 1, F.lit(len(names))))
    return F.when(bucket < len(names), listed).otherwise(F.lit(default).cast("string"))


def split_of(hexadecimal: Column) -> Column:
    return named_bucket(hexadecimal, HELD_OUT_SPLITS, 100, "train")


def panel_of(hexadecimal: Column, panels: list[str] | None = None) -> Column:
    return named_bucket(hexadecimal, panels or PANELS, 1000, None)


def is_development(name: Column, text: Column, fraction: float = 0.2) -> Column:
    """A stable share of benchmark items, by the digest of name and text."""
    return digest_bucket(F.sha2(F.concat(name, F.lit("\n"), text), 256), 1000, digits=8) < int(fraction * 1000)


def folded(text: Column) -> Column:
    """Lower case with sharp s spelt out; ``normalize`` without the single blanks, which words do not need."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(normalized: Column) -> Column:
    """Runs of word characters, by a split at the runs of others, which is faster than a match of each."""
    return F.array_remove(F.split(normalized, NO_WORD), "")


def word_and_mark_list(text: Column) -> Column:
    """Words and single punctuation marks of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_OR_MARK})"), F.lit(1))


def words_and_marks(text: Column) -> Column:
    """Words and single punctuation marks of the lower-cased text, joined by blanks; marks are set apart, without a match a word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), MARK, " $1 "), r"[ \t\n\x0B\f\r]+", " "))


def split_words(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, although inner functions refer to it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def gram_hashes(parts: Column, n: int) -> Column:
    """XXH64 of all runs of n words, a long each; none of shorter texts."""

    def made(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(last >= 1, every).otherwise(F.array().cast("array<bigint>"))

    return let(parts, made)


def grams(parts: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; none of shorter texts."""

    def made(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))

    return let(parts, made)


def word_windows(parts: Column, size: int = 60, limit: int = 64) -> Column:
    """Runs of ``size`` words; of more than ``limit``, that many evenly spaced ones."""

    def made(w: Column) -> Column:
        n = F.ceil(F.size(w) / size).cast("int")
        taken = F.least(n, F.lit(limit))
        step = F.when(n > limit, n / F.lit(limit)).otherwise(F.lit(1.0))
        at = F.transform(F.sequence(F.lit(0), F.greatest(taken - 1, F.lit(0))), lambda i: F.floor(i * step).cast("int"))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(parts, made)


_BETWEEN = re.compile(r"\n[ \t\n\x0b\f\r]*\n")
_BLANKS = " \t\n\x0b\f\r"


def packed_paragraphs(text: str | None, size: int) -> list[str] | None:
    """Greedy packing of paragraphs: a chunk ends before the paragraph that takes it over ``size``; each costs 2 more."""
    if text is None:
        return None
    done: list[str] = []
    now: list[str] = []
    used = 0
    for paragraph in _BETWEEN.split(text):
        paragraph = paragraph.strip(_BLANKS)
        if not paragraph:
            continue
        if now and used + len(paragraph) > size:
            done.append("\n\n".join(now))
            now, used = [], 0
        now.append(paragraph)
        used += len(paragraph) + 2
    return [*done, "\n\n".join(now)] if now else done


def paragraph_chunks(text: Column, size: int) -> Column:
    """Chunks of packed paragraphs, in an Arrow UDF: one pass over a book of any length."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed_paragraphs(t, size))

    return chunks(text)


_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def host(url: Column) -> Column:
    """Authority with port and user, lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """https, the host, the decoded path without trailing slashes, the query; empty without an authority."""
    url = F.coalesce(url, F.lit(""))
    path = F.regexp_extract(url, _PATH, 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    query = F.regexp_extract(url, _QUERY, 1)
    whole = F.concat(F.lit("https://"), host(url), F.regexp_replace(decoded, "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.regexp_extract(url, _AUTHORITY, 1) == "", "").otherwise(whole)


def blocked_host(name: Column, domains: list[str]) -> Column:
    """The domain itself or one below it; a fixed list, so no join."""
    found = F.lit(False)
    for d in domains:
        found = found | (name == d) | name.endswith("." + d)
    return F.coalesce(found, F.lit(False))


def clean_thread(text: Column) -> Column:
    """A question-and-answer thread without user names."""
    text = F.regexp_replace(text, r"(?m)^\(Asked by: username_\d+ on [^)]*\)\s*$", "")
    text = F.regexp_replace(text, r"(?m)^### Answer by username_\d+ on [^\n]*$", "### Answer")
    text = F.regexp_replace(text, r"\*\*username_\d+\*\*:?", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_book(text: Column) -> Column:
    """The body between a book's start and end markers."""
    after = F.element_at(F.split(text, BOOK_START, 2), -1)
    before = F.element_at(F.split(after, BOOK_END, 2), 1)
    return F.regexp_replace(F.replace(before, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def clean_ending(text: Column) -> Column:
    """Bracketed notes removed from a commonsense item, double blanks halved once."""
    text = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(text, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalize(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def title_key(title: Column) -> Column:
    return normalize(F.replace(title, F.lit("_"), F.lit(" ")))
