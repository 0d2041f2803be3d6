"""SimHash near-duplicates: bit-sliced comparison inside pigeonhole buckets, then components.

Fingerprints that differ in at most two of 64 bits agree on at least two of four 16-bit blocks, so
every link lies in one of six buckets.  Only distinct fingerprints are compared.  A bucket above
``bucket_limit`` is dealt again by thirds of its free bits (a link agrees on at least one), which ends
at 14 free bits: no task ever holds more than 2**14 fingerprints, and no link is lost.

Within a bucket the fingerprints lie as bit planes: plane ``b`` holds bit ``b`` of 64 fingerprints a
word.  Carry-save counters add up differences for a block of queries against a block of lanes at
once; queries whose lanes all exceed the radius are abandoned.

``similarity`` adds links between texts that share that much (Jaccard) of their distinct five-word shingles,
which 64 bits cannot tell; ``shingle_links`` finds them through the same bit-sliced comparison and verifies each.

Results that are defined: a null text equals an empty one, and a text without words has fingerprint
zero, linked like any other; ids that are null never name a component; rows that repeat an id or a text each
get their row; a text of any length is read in blocks of bounded size; extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quern.llm.bitslice import as_rows, within
from quern.llm.common import map_text, narrow, texts_as_bytes
from quern.llm.shingle_links import SEED, band_keys, minima, shingle_set, signature, similar_edges, word_blocks
from quern.runtime import cut, release, ship

BITS = 64
RADIUS = 2
#: Lanes and queries that are compared at a time.
BLOCK = 512


def _digests(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of all shingles of at least ``shingle`` words."""
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last)], np.dtype(">u8"))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, a bounded block of words at a time."""
    total, n, tail = np.zeros(BITS, np.int64), 0, []

    def add(hashes: np.ndarray) -> None:
        nonlocal n
        n += len(hashes)
        for i in range(0, len(hashes), 1 << 16):
            total[:] += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)

    for words in word_blocks(text):
        words = tail + words
        if len(words) >= shingle:
            add(_digests(words, shingle))
        tail = words[max(0, len(words) - shingle + 1) :]
    if not n and tail:
        add(_digests(tail, len(tail)))
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def _spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the labels of linked positions; a label is the smallest position of its component."""
    while True:
        x, y = labels[a], labels[b]
        wrong = x != y
        if not wrong.any():
            return
        low, high = np.minimum(x, y)[wrong], np.maximum(x, y)[wrong]
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def bucket_edges(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links among distinct fingerprints, blocks of lanes at a time."""
    labels, rows = np.arange(len(prints)), as_rows(prints)
    for i in range(0, len(prints), BLOCK):
        for j in range(i, len(prints), BLOCK):
            a, b = within(rows[i : i + BLOCK], rows[j : j + BLOCK], radius)
            if len(a):
                _spanning(labels, a + i, b + j)
    child = np.nonzero(labels != np.arange(len(prints)))[0]
    return prints[child], prints[labels[child]]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(radius: int = RADIUS, blocks: int = 4) -> list[tuple[int, list[int]]]:
    """Top masks: all choices of blocks - radius blocks; each entry gives the ids of what refines it."""
    from itertools import combinations

    width = BITS // blocks
    level = [sum(((1 << width) - 1) << (width * b) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    tree: list[tuple[int, list[int]]] = [(m, []) for m in level]
    todo, depth = list(range(len(tree))), 0
    while depth < 2:
        fresh = []
        for i in todo:
            mask = tree[i][0]
            free = [b for b in range(BITS) if not mask >> b & 1]
            parts = radius + 1
            for p in range(parts):
                more = free[p * len(free) // parts : (p + 1) * len(free) // parts]
                tree.append((mask | sum(1 << b for b in more), []))
                tree[i][1].append(len(tree) - 1)
                fresh.append(len(tree) - 1)
        todo, depth = fresh, depth + 1
    return tree


def _keys(rows: DataFrame, tree: list[tuple[int, list[int]]], ids: list[int]) -> DataFrame:
    made = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(tree[i][0])).cast("long")).alias("val")) for i in ids]
    return rows.select("fp", F.explode(F.array(*made)).alias("k")).select("fp", "k.mask", "k.val")


def buckets(reps: DataFrame, bucket_limit: int, radius: int = RADIUS) -> DataFrame:
    """(fp, mask, val) rows; every link shares a (mask, val), and none of these holds over the limit unless it cannot be split."""
    tree = masks(radius)
    roots = list(range(comb(4, 4 - radius)))
    rows = _keys(reps, tree, roots)
    done: list[DataFrame] = []
    for _ in range(2):
        heavy = rows.groupBy("mask", "val").count().where(F.col("count") > bucket_limit).select("mask", "val")
        heavy = cut(heavy)
        if heavy.isEmpty():
            break
        done.append(rows.join(heavy, ["mask", "val"], "left_anti").select("fp", "mask", "val"))
        large = rows.join(heavy, ["mask", "val"], "left_semi")
        split = F.create_map(*(x for i, (_, kids) in enumerate(tree) if kids for x in (F.lit(i), F.array(*map(F.lit, kids)))))
        bits = F.create_map(*(x for i, (m, _) in enumerate(tree) for x in (F.lit(i), F.lit(_signed(m)).cast("long"))))
        rows = large.select("fp", F.explode(split[F.col("mask")]).alias("mask")).withColumn("val", F.col("fp").bitwiseAND(bits[F.col("mask")]))
        rows = rows.select("fp", "mask", "val")
    return reduce(DataFrame.unionByName, [*done, rows])


def edges(reps: DataFrame, bucket_limit: int = 4096, radius: int = RADIUS) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints."""
    ship(reps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(prints: np.ndarray) -> pa.RecordBatch:
            u, v = bucket_edges(prints, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held: list[np.ndarray] = []  # whole buckets that wait to fill a block
        size = 0
        tail_key, tail = None, np.zeros(0, np.uint64)  # the bucket that may go on in the next batch

        def batches_then_end() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    yield tuple(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fp", "mask", "val"))

        for fp, mask, val in batches_then_end():
            new = np.r_[True, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])]
            starts = np.nonzero(new)[0]
            ends = np.r_[starts[1:], len(fp)]
            fp = fp.astype(np.int64).view(np.uint64)
            for a, b in zip(starts.tolist(), ends.tolist()):
                key = (int(mask[a]), int(val[a]))
                if key == tail_key:
                    tail = np.concatenate([tail, fp[a:b]])
                    continue
                if len(tail) > 1:
                    if size + len(tail) > BLOCK and held:
                        yield made(np.unique(np.concatenate(held)))
                        held, size = [], 0
                    held.append(tail)
                    size += len(tail)
                tail_key, tail = key, fp[a:b]
        if len(tail) > 1:
            held.append(tail)
        if held:
            yield made(np.unique(np.concatenate(held)))

    schema = StructType([StructField("u", LongType()), StructField("v", LongType())])
    rows = buckets(reps, bucket_limit, radius)
    return rows.repartition("mask", "val").sortWithinPartitions("mask", "val").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every u that is not its own root, by alternating large and small stars.

    The rounds of a chain grow with the logarithm of its length, and end by themselves.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Settled: every u has one v, and no v is a u.
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        loose = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count(F.when((F.col("up") > 1) | (F.col("up") * F.col("down") > 0), 1)))
        if not loose.first()[0]:
            return now.withColumnRenamed("v", "root")
        # Large star: every larger neighbour of u moves to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: u and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = RADIUS,
    bucket_limit: int = 4096,
    similarity: float | None = None,
) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (hex), component_id, kept, text_key.

    ``similarity`` also links texts of that similarity of five-word shingles.
    ``kept`` marks one row of each component: the smallest id, and of rows that repeat it the first.
    """
    docs = narrow(df, id_col, text_col)
    docs = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = texts_as_bytes(column)
        prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        made = [pa.array(prints.view(np.int64), pa.int64())]
        if similarity is not None:
            sets = [shingle_set(t) for t in texts]
            least = [minima(x) if len(x) else None for x in sets]
            node = [xxhash.xxh64_intdigest(p.tobytes() + x.tobytes(), SEED) for p, x in zip(prints, sets)]
            made.append(pa.array(np.array(node, np.uint64).view(np.int64), pa.int64()))
            made.append(pa.array([None if x is None else band_keys(x) for x in least], pa.list_(pa.int64())))
            made.append(pa.array([None if x is None else signature(x).tobytes() for x in least], pa.binary()))
            made.append(pa.array([len(x) for x in sets], pa.int64()))
        return made

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, shingles) of a table of (node, text_key), read again from one text of each."""
        again = docs.select("text_key", "text").join(nodes, "text_key")
        found = map_text(again, ["node"], "text", lambda c: [pa.array([shingle_set(t).tobytes() for t in texts_as_bytes(c)], pa.binary())], [StructField("shingles", BinaryType())])
        return found.groupBy("node").agg(F.first("shingles").alias("shingles"))

    fields = [StructField("fp", LongType())]
    if similarity is not None:
        fields += [StructField("node", LongType()), StructField("bands", ArrayType(LongType())), StructField("signature", BinaryType()), StructField("n_shingles", LongType())]
    rows = map_text(docs, ["doc_id", "text_key"], "text", compute, fields).withColumn("row_key", F.monotonically_increasing_id())
    rows = cut(rows if similarity is not None else rows.withColumn("node", F.col("fp")))
    # Nulls sort last here: an id that is null names a component only where there is no other.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_key"))).alias("lead")
    # Rows of one fingerprint are one node; for the similarity, rows of one fingerprint and one set of shingles.
    more = [] if similarity is None else [F.min("text_key").alias("text_key"), *(F.first(c).alias(c) for c in ("bands", "signature", "n_shingles"))]
    reps = cut(rows.groupBy("node").agg(lead, F.first("fp").alias("fp"), *more))
    if similarity is None:
        links = edges(reps.select("fp"), bucket_limit, radius)
    else:
        least = cut(reps.groupBy("fp").agg(F.min("node").alias("least")))
        close = edges(least.select("fp"), bucket_limit, radius)
        for side in ("u", "v"):
            close = close.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node")), side)
        same = reps.join(least, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        links = close.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).unionByName(same).unionByName(similar_edges(reps, sets_of, components, similarity))
    roots = components(links)
    del links
    release(df.sparkSession)
    placed = reps.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    first = cut(placed.groupBy("root").agg(F.min("lead").alias("first")))
    named = cut(cut(placed).join(first, "root").select("node", "first"))
    return rows.join(named, "node").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("first.row_key") == F.col("row_key")).alias("kept"),
        "text_key",
    )
