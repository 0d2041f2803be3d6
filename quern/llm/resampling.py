"""Importance resampling towards a target: a dictionary of distinct n-grams, bucket gains, Gumbel scores.

N-gram strings are counted over the whole corpus, each task's own dictionary first, so that a shuffle carries every
string once a task and not once an occurrence.  Each distinct string is hashed once, its count goes to its bucket, and
raw and target buckets give a gain each.  The gains (one number a bucket, a bounded table) are then joined back to the
n-grams of each document through the dictionary of a slice of texts, where a string is hashed once as well: the hash
of a pair of words is combined from the hashes of the words.  No n-gram of a document is ever shuffled.

Results that are defined: a null text counts as an empty one; a document without words weighs 0 and is never drawn;
ties of a score go to the smaller id, a null id before all others; rows that repeat an id each get their row and rank;
a null id hashes like an empty one; a text of any length is read in pieces; extra columns are ignored, whatever their
names; an empty table gives no rows, an empty target is a target of no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from quern.llm.common import map_text, narrow, slices, utf8_buffers
from quern.operators.windows import sums_before
from quern.runtime import cut, ship

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
#: Texts are read in slices, and one long text in pieces, of about so many bytes.
PIECE = 4 << 20
#: Slices over which a task adds up strings before they are shuffled.
SUMMED = 4 << 20
#: Deals among which the strings of one first word are split, a power of two.
SPLIT = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, letters, and all of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_BLANK = np.array([0x20], np.uint8)


class Piece:
    """The words of some texts as a dictionary, and which word stands where."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, carried: bool):
        raw = _LOWER[raw]
        inside = _WORD[raw]
        before = np.r_[False, inside[:-1]]
        begins = at[:-1][at[:-1] < len(raw)]
        before[begins] = False
        start = np.flatnonzero(inside & ~before)
        after = np.r_[inside[1:], False]
        after[begins[begins > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        encoded = words.dictionary_encode()
        self.words: pa.Array = encoded.dictionary
        self.ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        #: First word of each text, and one past the last text's.
        self.first = np.searchsorted(start, at)
        #: A word that an earlier piece has counted stands first, for the pair that it begins.
        self.skip = int(carried)
        same = np.ones(max(0, len(start) - 1), bool)
        cuts = self.first[1:-1]
        same[cuts[(cuts > 0) & (cuts < len(start))] - 1] = False
        self.left = np.flatnonzero(same)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of words (left, right), and for each pair of neighbours its number among them."""
        keys = self.ids[self.left] * len(self.words) + self.ids[self.left + 1]
        encoded = pa.array(keys).dictionary_encode()
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False)
        return distinct // max(1, len(self.words)), distinct % max(1, len(self.words)), encoded.indices.to_numpy(zero_copy_only=False)


def pieces(raw: np.ndarray, at: np.ndarray, size: int = PIECE) -> Iterator[Piece]:
    """The texts as one piece, or one long text as several, each behind the last word of what came before."""
    if len(at) != 2 or len(raw) <= size:
        yield Piece(raw, at, False)
        return
    begin, carry = 0, np.zeros(0, np.uint8)
    while begin < len(raw):
        stop = min(begin + size, len(raw))
        while stop < len(raw):  # to the end of the word
            outside = np.flatnonzero(~_WORD[_LOWER[raw[stop : stop + size]]])
            stop = stop + int(outside[0]) if len(outside) else min(stop + size, len(raw))
            if len(outside):
                break
        part = np.concatenate([carry, _BLANK, raw[begin:stop]]) if len(carry) else raw[begin:stop]
        piece = Piece(part, np.array([0, len(part)]), len(carry) > 0)
        yield piece
        if len(piece.ids):
            carry = np.frombuffer(piece.words[int(piece.ids[-1])].as_py(), np.uint8)
        begin = stop


def _crcs(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.uint32, len(words))


@lru_cache(maxsize=256)
def _shift(length: int) -> np.ndarray:
    """Four tables that move a CRC32 past so many bytes: the CRC of a joined string is the moved one of its left part,
    combined with that of its right part."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    # zlib.crc32(zeros, x) is affine in x; its linear part is what moves a checksum.
    bits = [zlib.crc32(zeros, 1 << b) ^ base for b in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for v in range(256):
            for b in range(8):
                if v >> b & 1:
                    table[byte, v] ^= np.uint32(bits[byte * 8 + b])
    return table


def pair_crcs(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC32 of strings joined from a part of CRC ``left`` and one of CRC ``right`` and that length in bytes."""
    out = np.empty(len(left), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, starts = np.unique(length[order], return_index=True)
    for n, a, b in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        some, t = order[a:b], _shift(n)
        x = left[some]
        out[some] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24] ^ right[some]
    return out


def _lines(p: Piece, deals: int) -> pa.RecordBatch:
    """(deal, lines): the distinct strings of a piece, a line for each first word: ``first:n last:n last ...``.

    The number behind a word counts the string that ends with it; without one, it is once.  Lines of a first word go to
    ``SPLIT`` deals by their last words, so none of these grows with a frequent word alone.
    """
    v = len(p.words)
    crc = _crcs(p.words)
    alone = np.arange(v)
    i, j, which = p.pairs()
    n = np.r_[np.bincount(p.ids[p.skip :], minlength=v), np.bincount(which, minlength=len(i))]
    deal = np.r_[crc, crc[i] ^ (crc[j] & np.uint32(SPLIT - 1))].astype(np.int64) % deals
    # Of a first word and a deal, the word alone comes first, where the deal is its own.
    i, j, pair = np.r_[alone, i], np.r_[alone, j], np.r_[np.zeros(v, bool), np.ones(len(i), bool)]
    order = np.lexsort((pair, i, deal))
    i, j, n, deal, pair = i[order], j[order], n[order], deal[order], pair[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (deal[1:] != deal[:-1])]
    words = p.words.cast(pa.binary())
    counted = pc.binary_join_element_wise(words.take(pa.array(j)), pa.array(n).cast(pa.string()).cast(pa.binary()), pa.scalar(b":", pa.binary()))
    token = pc.if_else(pa.array((n != 1) | ~pair), counted, words.take(pa.array(j)))
    # A line that lacks the word alone begins with it all the same, counted as none.
    bare = np.flatnonzero(new & pair)
    named = pc.binary_join_element_wise(words.take(pa.array(i[bare])), pa.array([b"0"] * len(bare), pa.binary()), pa.scalar(b":", pa.binary()))
    head = pc.binary_join_element_wise(named, token.take(pa.array(bare)), pa.scalar(b" ", pa.binary()))
    token = pc.replace_with_mask(token, pa.array(new & pair), head)
    blank = pa.scalar(b" ", pa.binary())
    starts = np.flatnonzero(new)
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(i)], pa.int32()), token), blank)
    first = np.flatnonzero(np.r_[True, deal[starts][1:] != deal[starts][:-1]])
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[first, len(starts)], pa.int32()), line), pa.scalar(b"\n", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(deal[starts][first]), lines.cast(pa.string())], ["deal", "lines"])


def feature_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(feature, n): every distinct run of one or two words with its count over all texts.

    A task adds up its own texts, a slice at a time, before the shuffle, which carries the strings that begin alike in
    one line and many lines in one row; so a string costs little more than its last word.
    """
    spark = docs.sparkSession
    ship(spark)
    deals = 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SUMMED):
                at, raw = utf8_buffers(part.column(0))
                for p in pieces(raw, at, SUMMED):
                    if len(p.words):
                        yield _lines(p, deals)

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "deal long, lines string").repartition("deal")
    line = rows.select("deal", F.explode(F.split("lines", "\n")).alias("line"))
    first = F.substring_index("line", ":", 1)
    each = line.select("deal", first.alias("first"), F.posexplode(F.split("line", " ")).alias("place", "token"))
    count = F.when(F.instr("token", ":") > 0, F.substring_index("token", ":", -1).cast("long")).otherwise(1)
    word = F.when(F.col("place") > 0, F.substring_index("token", ":", 1))
    feature = F.concat_ws(" ", "first", word)
    return each.select("deal", feature.alias("feature"), count.alias("n")).where("n > 0").groupBy("deal", "feature").agg(F.sum("n").alias("n")).select("feature", "n")


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the dictionary of all features, each of which is hashed once."""
    named = feature_counts(docs, text_col).select((F.crc32("feature") % buckets).cast("int").alias("bucket"), "n")
    return named.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: how much likelier they are in the target, in thousandths, smoothed by one."""
    counted = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    by = cut(counted.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    totals = by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return by.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_words, n_features and weight, the floored mean of the gains of a text's features."""
    buckets = len(gains)

    def compute(column: pa.Array) -> list[pa.Array]:
        at, raw = utf8_buffers(column)
        n_words, n_pairs, total = (np.zeros(len(column), np.int64) for _ in range(3))
        for p in pieces(raw, at):
            if not len(p.words):
                continue
            crc = _crcs(p.words)
            single = gains[crc % buckets][p.ids]
            single[: p.skip] = 0
            i, j, which = p.pairs()
            behind = np.fromiter((zlib.crc32(b" ", int(c)) for c in crc), np.uint32, len(crc))
            size = pc.binary_length(p.words).to_numpy(zero_copy_only=False)
            double = gains[pair_crcs(behind[i], crc[j], size[j]) % buckets][which]
            added = np.r_[0, np.cumsum(single)]
            paired = np.zeros(len(p.ids) + 1, np.int64)
            paired[p.left + 1] = double
            np.cumsum(paired, out=paired)
            there = np.zeros(len(p.ids) + 1, np.int64)
            there[p.left + 1] = 1
            np.cumsum(there, out=there)
            a, b = p.first[:-1], p.first[1:]
            n_words += b - a
            n_words[:1] -= p.skip
            n_pairs += there[b] - there[a]
            total += added[b] - added[a] + paired[b] - paired[a]
        n = n_words + n_pairs
        return [pa.array(n_words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

    fields = [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]
    return map_text(docs, keep, text_col, compute, fields, PIECE)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """A standard Gumbel number of an id, in thousandths; the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_features, weight, score, rank (null where not drawn)."""
    docs = narrow(df, id_col, text_col)
    raw = bucket_counts(docs, "text", buckets)
    wanted = bucket_counts(target.select(F.col(f"`{target_text}`").alias("text")), "text", buckets)
    by = bucket_gains(raw, wanted, buckets).collect()  # one row a bucket
    gains = np.zeros(buckets, np.int64)
    gains[[r["bucket"] for r in by]] = [r["gain"] for r in by]
    scored = weights(docs, gains, ["doc_id"])
    scored = cut(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    drawn = scored.agg(F.floor(F.count(F.when(F.col("n_words") >= least_words, 1)) * share / 100).cast("long").alias("n")).first()["n"]
    return ranked(scored, drawn, least_words)


def ranked(scored: DataFrame, drawn: int, least_words: int) -> DataFrame:
    """A ``rank`` column over the rows with words enough, up to ``drawn``; no task holds more than a range of scores."""
    able = F.col("n_words") >= least_words
    keyed = scored.where(able).withColumns({"down": -F.col("score"), "one": F.lit(1).cast("long"), "row": F.monotonically_increasing_id()})
    placed = sums_before(keyed, [], ["down", "doc_id", "n_features", "row"], place="one")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
