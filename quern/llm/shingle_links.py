"""Links between texts that share enough of their distinct five-word shingles.

Candidates: 128 MinHash values in 32 bands of four deal the texts to buckets, whose keys are 64-bit digests, so
that buckets do not fill as the corpus grows.  A pair at 0.8 shares no bucket with probability 5e-8, whatever
the number of rows.  Verification: a candidate is a link only if the Jaccard similarity of its shingles says so.

All rows of a bucket are compared, by these steps.

1. The buckets of the first bands are cut into parts of bounded size.  A part is settled in one task, beside a
   few pivots of its bucket, which tie the parts together.  A pair that is in one component already is not
   verified again, so a group of copies costs a few verifications a row.
2. Buckets of all bands that still hold several components are compared between these.  Rows of a bucket's
   largest component meet the other rows alone.  Large buckets are dealt to blocks; no task holds more than two
   parts.  A pair is compared in the first bucket that it shares.  Signatures come first, bit-sliced: one byte of
   each MinHash value, counters of differing values, queries abandoned once all lanes differ too often (five
   standard errors are allowed).  Only rows with a candidate partner are read again with their shingles.

Nothing but spanning links leaves a task, so no stage makes rows by the square of a group.  What does grow with
the square is the comparison of signatures within one bucket whose texts are alike to less than the bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.bitslice import within
from quern.runtime import cut, release, ship

SEED = 42
#: MinHash bands and the values of each; the first byte of every value is the signature.
BANDS = 32
BAND_ROWS = 4
#: Bands whose buckets are settled in parts before all bands are compared.
FIRST_BANDS = 4
#: A part holds rows of so much weight; a row weighs one, and one more for every WEIGHT shingles.
PART = 1024
WEIGHT = 512
PIVOTS = 8
#: Small blocks are compared together up to so many rows; queries are compared so many at a time.
TOGETHER = 256
QUERIES = 64
_ODD = (np.arange(BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LINKS = StructType([StructField("u", LongType()), StructField("v", LongType())])


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words (A-Z alone; blanks are \\x20 and \\x09-\\x0D), in lists of bounded bytes."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + size) if at + size < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[at:end].lower().split()
        at = end


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> np.uint64(32)
    values *= _MIX
    values ^= values >> np.uint64(32)
    return values


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; empty without words.

    A shingle's hash combines the XXH64 of its words in order; a text of fewer words is one shingle.
    """
    parts: list[np.ndarray] = []
    hashes = np.zeros(0, np.uint64)

    def combined(width: int) -> np.ndarray:
        made = np.full(len(hashes) - width + 1, width, np.uint64)
        for i in range(width):
            made = _mixed((made ^ hashes[i : len(hashes) - width + 1 + i]) * _ODD[1])
        return np.unique(made)

    for words in word_blocks(text):
        fresh = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        hashes = np.concatenate([hashes, fresh])
        if len(hashes) >= shingle:
            parts.append(combined(shingle))
            hashes = hashes[len(hashes) - shingle + 1 :]
    if not parts:
        return combined(len(hashes)) if len(hashes) else hashes
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the shingles."""
    least = np.full(len(_ODD), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 256):
        np.minimum(least, _mixed(shingles[i : i + 256, None] * _ODD[None, :]).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A digest of each band's number and values."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = _mixed((key ^ column) * _ODD[1])
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    return (least & np.uint64(0xFF)).astype(np.uint8)


def most_differing(similarity: float) -> int:
    """Values of a signature in which texts of a similarity differ at most, five standard errors allowed."""
    n = BANDS * BAND_ROWS
    return n - int(n * similarity - 5 * np.sqrt(n * similarity * (1 - similarity)))


def alike(a: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sorted, non-empty sets reach the Jaccard similarity with ``a``."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.searchsorted(a, flat)
    hit = a[np.minimum(at, len(a) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return both >= similarity * (len(a) + size - both) - 1e-9


# ------------------------------------------------------------------- within a task


def candidate_pairs(block: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, band: np.ndarray, keys: np.ndarray, marks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of rows of one block and different labels whose signatures are near enough.

    Rows with ``own == low`` stand on the left of their block, those with ``own == high`` on the right.  Pairs that
    share a bucket of an earlier band are left to that.
    """
    left, right = np.nonzero(own == low)[0], np.nonzero(own == high)[0]
    for i in range(0, len(left), QUERIES):
        q, lane = within(marks[left[i : i + QUERIES]], marks[right], radius, 8)
        x, y = left[i + q], right[lane]
        usable = (block[x] == block[y]) & (label[x] != label[y]) & ((low[x] != high[x]) | (x < y))
        x, y = x[usable], y[usable]
        for at in range(0, len(x), 1 << 14):
            a, b = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            before = np.arange(keys.shape[1])[None, :] < band[a, None]
            fresh = ~((keys[a] == keys[b]) & before).any(axis=1)
            yield a[fresh], b[fresh]


def settle(pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, sets: list[np.ndarray], similarity: float) -> None:
    """Merge the labels of candidate pairs whose sets are alike; pairs of one label are not looked at."""
    size = np.array([len(s) for s in sets], np.int64)
    for x, y in pairs:
        fits = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
        x, y = x[fits], y[fits]
        starts = np.nonzero(np.r_[True, x[1:] != x[:-1]])[0] if len(x) else []
        for a, b in zip(starts, [*starts[1:], len(x)]):
            one, rest = int(x[a]), y[a:b]
            while len(rest := rest[label[rest] != label[one]]):
                some, rest = rest[:32], rest[32:]
                for other in some[alike(sets[one], [sets[j] for j in some], similarity)].tolist():
                    label[label == label[other]] = label[one]


def stars(node: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the labels ``before`` into those ``after``: the least node of each to the least of all."""
    order = np.lexsort((node, before, after))
    node, before, after = node[order], before[order], after[order]
    first = np.r_[True, (after[1:] != after[:-1]) | (before[1:] != before[:-1])]
    node, after = node[first], after[first]
    new = np.r_[True, after[1:] != after[:-1]]
    starts = np.nonzero(new)[0]
    least = np.minimum.reduceat(node, starts)[np.cumsum(new) - 1]
    return node[node != least], least[node != least]


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    found = {c: rows.column(c).to_numpy() for c in ("key", "low", "high", "own", "band", "node", "root")}
    found["marks"] = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    found["keys"] = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of sorted rows; small ones come together."""
    held: list[pa.Table] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = [table.column(c).to_numpy() for c in ("key", "low", "high")]
        starts = np.nonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])[0].tolist()
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            key = tuple(int(k[a]) for k in keys)
            if key != last and rows + b - a > TOGETHER and held:
                yield pa.concat_tables(held).combine_chunks()
                held, rows = [], 0
            held.append(table.slice(a, b - a))
            rows, last = rows + b - a, key
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _labelled(at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the blocks, and labels of the components within them."""
    block = np.cumsum(np.r_[0, np.logical_or.reduce([at[c][1:] != at[c][:-1] for c in ("key", "low", "high")])])
    order = np.lexsort((at["root"], block))
    new = np.r_[0, (block[order][1:] != block[order][:-1]) | (at["root"][order][1:] != at["root"][order][:-1])]
    label = np.empty(len(block), np.int64)
    label[order] = np.cumsum(new)
    return block, label


def _compared(rows: DataFrame, similarity: float, verify: bool) -> DataFrame:
    """Links (u, v) that span the components of each block or, without verification, the rows (key, node) that have a candidate partner."""
    ship(rows.sparkSession)
    radius = most_differing(similarity)
    names = ["u", "v"] if verify else ["key", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            at = _columns(table)
            block, label = _labelled(at)
            pairs = candidate_pairs(block, at["own"], at["low"], at["high"], label, at["band"], at["keys"], at["marks"], radius)
            if verify:
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
                before = label.copy()
                settle(pairs, label, sets, similarity)
                made = stars(at["node"], before, label)
            else:
                marked = np.zeros(len(block), bool)
                for x, y in pairs:
                    marked[x] = marked[y] = True
                made = [at["key"][marked], at["node"][marked]]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names)

    by = ["key", "low", "high"]
    schema = StructType([StructField(n, LongType()) for n in names])
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


# ------------------------------------------------------------------- buckets, parts and blocks


def _in_parts(rows: DataFrame) -> DataFrame:
    """Rows (key, node, ...) of each bucket in parts of bounded weight, the bucket's pivots in every part."""
    pivots = F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)))
    sized = cut(rows.groupBy("key").agg(F.ceil(F.sum("weight") / PART).cast("long").alias("parts"), pivots.alias("pivots")))
    joined = rows.join(sized, "key").withColumn("all", F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    where = F.when(F.array_contains("pivots", F.col("node")), F.col("all")).otherwise(F.array(F.pmod(F.xxhash64("node", "band"), "parts")))
    return joined.withColumn("own", F.explode(where)).drop("parts", "pivots", "all").withColumns({"low": F.col("own"), "high": F.col("own")})


def _between_components(rows: DataFrame) -> DataFrame:
    """Rows (key, node, root, ...) of buckets with several components, in blocks that hold every pair between these.

    Parts of the largest component come last and meet the parts of the others alone.
    """
    by_root = rows.groupBy("key", "root").agg(F.sum("weight").alias("w"))
    total, top = F.sum("w").alias("total"), F.max(F.struct("w", "root")).alias("top")
    sized = cut(by_root.groupBy("key").agg(total, top, F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots"))
    joined = rows.join(sized, "key")
    single = F.col("total") <= PART
    joined = joined.withColumn("others", F.when(single, 1).otherwise(F.ceil((F.col("total") - F.col("top.w")) / PART)).cast("long"))
    joined = joined.withColumn("parts", F.when(single, 1).otherwise(F.col("others") + F.ceil(F.col("top.w") / PART)).cast("long"))
    first = single | (F.col("root") != F.col("top.root"))
    own = F.when(first, F.pmod(F.xxhash64("node"), "others")).otherwise(F.col("others") + F.pmod(F.xxhash64("node"), F.greatest(F.col("parts") - F.col("others"), F.lit(1))))
    joined = joined.withColumn("own", own).withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.when(first, F.col("parts")).otherwise(F.col("others")) - 1)))
    sides = {"low": F.least("own", "meets"), "high": F.greatest("own", "meets")}
    return joined.withColumns(sides).drop("total", "top", "others", "parts", "meets")


def similar_edges(reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Spanning links (u, v) of nodes whose shingles are alike.

    ``reps`` has node, text_key, bands, signature and n_shingles; ``sets_of`` gives (node, shingles) of (node, text_key);
    ``components`` gives (u, root) of links.
    """
    bands = reps.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
    shared = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    members = cut(bands.join(shared, "key").select("key", "band", "node"))
    weight = 1 + F.col("n_shingles") / WEIGHT
    wanted = cut(reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_key", F.col("bands").alias("keys"), F.col("signature").alias("marks"), weight.alias("weight")))
    sets = cut(sets_of(wanted.select("node", "text_key")))
    about = wanted.drop("text_key")
    first = members.where(F.col("band") < FIRST_BANDS).join(about, "node").withColumn("root", F.col("node"))
    near = cut(_compared(_in_parts(cut(first)).join(sets, "node"), similarity, True))
    roots = components(near).withColumnRenamed("u", "node")
    placed = cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    del first, shared, members, bands, roots
    release(reps.sparkSession)
    light = _between_components(placed.withColumn("weight", F.lit(1.0)))
    partners = cut(_compared(light.join(about.drop("weight"), "node"), similarity, False).distinct())
    left = cut(placed.join(partners, ["key", "node"], "left_semi").join(about, "node"))
    del light, partners, placed
    release(reps.sparkSession)
    rest = _compared(_between_components(left).join(sets, "node"), similarity, True)
    return near.unionByName(cut(rest))
