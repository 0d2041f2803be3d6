"""First-wins deduplication in a total order: exact digests, URLs, and MinHash near copies.

Exact and URL repeats have closed forms: the least order of each key, taken before the shuffle, joined back to the
rows.  Near copies form a lexicographic greedy set: a row goes where an earlier row that stays is near it; rounds
settle rows whose earlier neighbours are settled, over the rows that have a neighbour at all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import Words, md5_heads, slices
from quern.functions.numeric import BANDS, COMPONENTS, LOW, MERSENNE, ROWS, SEED, permutation
from quern.functions.text import normalize
from quern.runtime import cut, ship, spread

SHINGLE = 5
LEAST_EQUAL = 28
#: Distinct sketches of a bucket that are compared as they are; larger buckets are dealt again.
BUCKET = 512


def mark_repeated(df: DataFrame, key: str, order: str, name: str = "again", usable: Column | None = None) -> DataFrame:
    """``df`` (narrow rows) with a column: whether a row that comes before in ``order`` has the same key.

    Rows without a usable key never repeat; rows of equal order are the same row.
    """
    return _mark(cut(df), key, order, name, usable)


def _mark(rows: DataFrame, key: str, order: str, name: str, usable: Column | None = None) -> DataFrame:
    usable = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    groups = rows.where(usable).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Keys that repeat are few; where they are not, a hot key's rows are split by AQE, as both sides are written tables.
    firsts = cut(groups.where("__n > 1").select("__key", "__first", F.lit(0).cast("long").alias("__side")))
    # Rows without a usable key meet no group, and are dealt out by their order.
    side = F.when(usable, F.lit(0).cast("long")).otherwise(F.xxhash64(order).bitwiseOR(F.lit(1)))
    joined = rows.withColumn("__of", side).join(firsts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__of") == F.col("__side")), "left")
    return joined.withColumn(name, F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__key", "__first", "__side", "__of")


def exact_and_url_reasons(df: DataFrame, digest_col: str, url_col: str, order: str) -> DataFrame:
    """A ``reason`` column: exact_document, else same_url, both over all rows; null for rows that stay."""
    marked = _mark(cut(df), digest_col, order, "__exact")
    marked = _mark(marked, url_col, order, "__url", F.col(url_col) != "")
    reason = F.when(F.col("__exact"), "exact_document").when(F.col("__url"), "same_url")
    return marked.withColumn("reason", reason).drop("__exact", "__url")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key the seen table lacks."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def _shingles(parts: list[str]) -> list[str]:
    return [" ".join(parts[i : i + SHINGLE]) for i in range(len(parts) - SHINGLE + 1)]


def _least(hashes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(group, component) minima of ((a * h + b) mod 2**61 - 1) mod 2**32; groups begin at ``starts``, none is empty.

    The remainder comes from two folds of the product, which wraps at 64 bits.
    """
    h, bits, m = hashes.astype(np.uint64), np.uint64(61), np.uint64(MERSENNE)
    out = np.empty((len(starts), COMPONENTS), np.int64)
    x, high = np.empty_like(h), np.empty_like(h)
    with np.errstate(over="ignore"):
        for i in range(COMPONENTS):
            np.multiply(h, np.uint64(a[i]), out=x)
            x += np.uint64(b[i])
            np.right_shift(x, bits, out=high)
            x &= m
            x += high
            np.add(x, np.uint64(1), out=high)
            high >>= bits
            x += high
            x &= np.uint64(LOW)
            out[:, i] = np.minimum.reduceat(x, starts)
    return out


def _sketched(column: pa.Array, hashed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Sketches of texts whose words are parted by single blanks; all zero for a text under five words."""
    out = np.zeros((len(column), COMPONENTS), np.int64)
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    done = 0
    for part in slices(batch, 0, 1 << 18):
        found = Words(part.column(0))
        last = len(found.start) - SHINGLE + 1
        if last > 0:
            first = np.flatnonzero(found.owner[:last] == found.owner[SHINGLE - 1 :])
            for k in range(0, len(first), 1 << 16):  # a long text a block at a time
                some = first[k : k + (1 << 16)]
                owners, starts = np.unique(found.owner[some], return_index=True)
                least = _least(hashed(found.raw, found.start[some], found.end[some + SHINGLE - 1]), starts, a, b)
                before = out[done + owners]
                out[done + owners] = np.where(before.any(axis=1, keepdims=True), np.minimum(before, least), least)
        done += part.num_rows
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), COMPONENTS).cast(pa.list_(pa.int64()))


def with_sketch(df: DataFrame, normal_col: str, name: str = "sketch") -> DataFrame:
    """``df`` with the portable sketch of a column that is normalised already: 32-bit MD5 of five-word shingles."""
    ship(df.sparkSession)

    @F.arrow_udf("array<long>")
    def sketch(texts: pa.Array) -> pa.Array:
        a, b = (np.array(x, np.uint64) for x in zip(*map(permutation, range(COMPONENTS))))
        return _sketched(texts, md5_heads, a, b)

    return df.withColumn(name, sketch(F.col(normal_col)))


def sketches(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, sketch) with the portable hash family over five-word shingles of the normalised text.

    Normalised in generated code, sketched by array arithmetic over slices of a column, without a row for each shingle
    and without a shuffle; a text under five words has an all-zero sketch.
    """
    normal = spread(df.select(id_col, text_col)).select(id_col, normalize(F.coalesce(F.col(text_col), F.lit(""))).alias("__normal"))
    return with_sketch(normal, "__normal").select(id_col, "sketch")


def _exact_family() -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.RandomState(SEED)
    multipliers = draws.randint(1, 2**32, size=COMPONENTS, dtype=np.uint64) | np.uint64(1)
    return multipliers, draws.randint(0, 2**32, size=COMPONENTS, dtype=np.uint64)


def _xxh32(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    import xxhash

    whole = raw.tobytes()
    return np.fromiter((xxhash.xxh32_intdigest(whole[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def exact_column(texts: pa.Array) -> pa.Array:
    normal = pa.array([" ".join(unicodedata.normalize("NFKC", t or "").casefold().split()) for t in texts.to_pylist()], pa.string())
    return _sketched(normal, _xxh32, *_exact_family())


def exact_sketch(text: str | None) -> list[int]:
    """32-bit xxHash shingles of the exactly normalised text under 64-bit permutations."""
    return exact_column(pa.array([text], pa.string()))[0].as_py()


def exact_sketches(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, sketch) of the exact family, in one Arrow UDF and without a shuffle."""
    ship(df.sparkSession)

    @F.arrow_udf("array<long>")
    def sketch(texts: pa.Array) -> pa.Array:
        return exact_column(texts)

    return spread(df.select(id_col, text_col)).select(id_col, sketch(F.col(text_col)).alias("sketch"))


def band_rows(sketched: DataFrame, id_col: str) -> DataFrame:
    """(id, band, key): eight bands of four components; 28 of 32 equal leaves at least four whole bands."""
    keys = F.array(*(F.struct(F.lit(b).alias("band"), F.array_join(F.slice("sketch", b * ROWS + 1, ROWS), ",").alias("key")) for b in range(BANDS)))
    return sketched.select(id_col, F.explode(keys).alias("k")).select(id_col, "k.band", "k.key")


def equal_components(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))


def shared_buckets(classes: DataFrame, id_col: str, most: int = BUCKET) -> DataFrame:
    """(id, mask, value): buckets in which every two sketches meet that differ in at most four of 32 components.

    Such sketches share at least four of the eight bands, and agree on all components of one of five residues of
    their places.  So a bucket of more than ``most`` sketches is dealt again by one more band, up to four, and last by
    the residues: what is left in one bucket agrees on 16 components and more.
    """
    # The low bits of a mask name bands; above them stands the residue of places, from one on, or zero.
    chosen = F.expr(f"filter(sketch, (x, i) -> (shiftright(mask, cast(i div {ROWS} as int)) & 1) = 1 or shiftright(mask, {BANDS}) = i % 5 + 1)")

    def valued(rows: DataFrame) -> DataFrame:
        return rows.withColumn("value", F.xxhash64(chosen))

    rows = valued(classes.select(id_col, "sketch", F.explode(F.array(*(F.lit(1 << b) for b in range(BANDS)))).alias("mask")))
    done: list[DataFrame] = []
    for level in range(5):
        counts = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = cut(rows.join(counts, ["mask", "value"]))
        if level == 4 or rows.where(F.col("n") > most).isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows.drop("n")])
        done.append(rows.where(F.col("n") <= most).drop("n"))
        large = rows.where(F.col("n") > most).drop("n", "value")
        if level < 3:
            more = F.filter(F.array(*(F.lit(1 << b) for b in range(BANDS))), lambda m: F.col("mask").bitwiseAND(m) == 0)
            deeper = F.transform(more, lambda m: F.col("mask").bitwiseOR(m))
        else:
            deeper = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda g: F.col("mask") + g * (1 << BANDS))
        rows = valued(large.select(id_col, "sketch", F.explode(deeper).alias("mask")).dropDuplicates([id_col, "mask"]))
    raise AssertionError("the last level returns")


def near_pairs(sketched: DataFrame, id_col: str, least: int = LEAST_EQUAL, most: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct sketches' first rows that agree on enough components (28 of 32 or more).

    Rows with equal sketches are one class, stood for by its first row, so hot classes make no pairs.
    """
    if least < LEAST_EQUAL:
        raise ValueError(f"buckets hold every pair only from {LEAST_EQUAL} equal components on")
    classes = cut(sketched.groupBy("sketch").agg(F.min(id_col).alias(id_col)))
    rows = shared_buckets(classes, id_col, most)
    left, right = (rows.select(F.col(id_col).alias(x), F.col("sketch").alias(f"s{x}"), "mask", "value") for x in "ab")
    same = equal_components(F.col("sa"), F.col("sb"))
    return left.join(right, ["mask", "value"]).where("a < b").select("a", "b", same.alias("equal")).where(F.col("equal") >= least).distinct()


def keep_first(pairs: DataFrame, rounds: int = 12) -> DataFrame:
    """(id, kept) of every row in a pair: kept unless an earlier kept row is its neighbour.

    Rounds settle rows whose earlier neighbours are settled.  A chain gains a row a round; what is open after ``rounds``
    is settled in order, one component of open rows a task at a time.
    """
    pairs = cut(pairs.select("a", "b"))
    # A row that is never the later one of a pair stays.
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("late")), F.struct(F.col("b").alias("id"), F.lit(True).alias("late")))).alias("s")).select("s.*")
    status = cut(sides.groupBy("id").agg(F.max("late").alias("late")).select("id", F.when(~F.col("late"), True).alias("kept")))
    for _ in range(rounds):
        if status.where("kept is null").isEmpty():
            return status
        joined = status.join(_earlier(pairs, status), "id", "left")
        decided = F.when(F.coalesce("near_kept", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        status = cut(joined.select("id", F.coalesce("kept", decided).alias("kept")))
    return _in_order(pairs, status) if not status.where("kept is null").isEmpty() else status


def _earlier(pairs: DataFrame, status: DataFrame) -> DataFrame:
    """(id, near_kept, open): whether an earlier neighbour is kept, and whether one is open."""
    known = status.withColumnRenamed("id", "a").withColumnRenamed("kept", "ka")
    return pairs.join(known, "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce(F.col("ka"), F.lit(False))).alias("near_kept"), F.max(F.col("ka").isNull()).alias("open"))


def _in_order(pairs: DataFrame, status: DataFrame) -> DataFrame:
    """Settle open rows by walking each component's pairs in the order of their later row."""
    ship(pairs.sparkSession)
    open_rows = status.where("kept is null").select("id")
    inner = pairs.join(open_rows.withColumnRenamed("id", "a"), "a", "left_semi").join(open_rows.withColumnRenamed("id", "b"), "b", "left_semi")
    numbered = open_rows.withColumn("n", F.xxhash64("id"))
    links = inner.join(numbered.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(numbered.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    roots = connected(links.select(F.col("na").alias("u"), F.col("nb").alias("v")))
    placed = numbered.join(roots.withColumnRenamed("u", "n"), "n", "left").select("id", F.coalesce("root", "n").alias("root"))
    # A row that the last round left without an earlier open one may have a kept neighbour since.
    before = _earlier(pairs, status).where("near_kept").select("id", "near_kept")
    alone = placed.join(before, "id", "left").select("root", F.col("id").alias("b"), F.lit(None).cast(placed.schema["id"].dataType).alias("a"), F.coalesce("near_kept", F.lit(False)).alias("near"))
    listed = inner.join(placed.withColumnRenamed("id", "b"), "b").select("root", "b", "a", F.lit(False).alias("near")).unionByName(alone)
    texts = listed.select("root", "b", F.to_json(F.struct("b")).alias("kb"), F.when(F.col("a").isNotNull(), F.to_json(F.struct(F.col("a").alias("b")))).alias("ka"), "near")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, kept, now, near = None, set(), None, False
        out: list[tuple[str, bool]] = []
        for batch in batches:
            for r, kb, ka, settled in zip(batch["root"], batch["kb"], batch["ka"], batch["near"]):
                if (r, kb) != now:
                    if now is not None:
                        out.append((now[1], not near))
                        if not near:
                            kept.add(now[1])
                    if r != root:
                        root, kept = r, set()
                    now, near = (r, kb), False
                near = near or settled or ka in kept
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=["key", "kept"])
                out = []
        if now is not None:
            out.append((now[1], not near))
        if out:
            yield pd.DataFrame(out, columns=["key", "kept"])

    walked = texts.repartition("root").sortWithinPartitions("root", "b").select("root", "kb", "ka", "near").mapInPandas(walk, "key string, kept boolean")
    settled = cut(walked).withColumnRenamed("kept", "late")
    keyed = status.withColumn("key", F.to_json(F.struct(F.col("id").alias("b"))))
    return cut(keyed.join(settled, "key", "left").select("id", F.coalesce("kept", "late").alias("kept")))


def connected(links: DataFrame) -> DataFrame:
    """(u, root) for every u that is not the least of its component, by alternating large and small stars."""
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


def _bands_of(classes: DataFrame) -> DataFrame:
    """(row, band, key): the eight bands of each sketch, eight bytes a key."""
    keys = F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("sketch", b * ROWS + 1, ROWS)).alias("key")) for b in range(BANDS)))
    return classes.select("row", F.explode(keys).alias("k")).select("row", "k.band", "k.key")


def crowds(classes: DataFrame, most: int = BUCKET, rounds: int = 6) -> tuple[DataFrame, DataFrame | None]:
    """(rest, settled): settle the rows of crowded buckets without pairs; ``settled`` is (row, kept), or none.

    The first row of all its buckets stays whatever else happens, as no earlier row can be near it.  So every other row is
    compared with the first rows of its eight buckets alone, where these are such leaders, and goes where one is near.  What
    is left has been compared with all leaders it shares a bucket with, so the same holds for it again.  A crowd of mutual
    near copies is settled in one round, by as many comparisons as it has rows; rounds end when no bucket is crowded, or
    when a round settles less than a tenth.  Rows are structs (late, id); those that are not late always stay.
    """
    rest, settled = classes, None
    for _ in range(rounds):
        keyed = _bands_of(rest)
        buckets = cut(keyed.groupBy("band", "key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        if buckets.where(F.col("n") > most).isEmpty():
            break
        met = cut(keyed.join(buckets, ["band", "key"]).select("row", "first"))
        # Rows that meet no other are settled as well: nothing is near them.
        behind = met.groupBy("row").agg(F.max(F.col("row") != F.col("first")).alias("behind"))
        placed = cut(rest.join(behind, "row", "left").withColumn("behind", F.coalesce("behind", F.lit(False))))
        leaders = placed.where("NOT behind").select(F.col("row").alias("first"), F.col("sketch").alias("leader"))
        pairs = met.where((F.col("row") != F.col("first")) & (F.col("row.late") == 1)).distinct()
        compared = pairs.join(leaders, "first").join(rest, "row").where(equal_components(F.col("sketch"), F.col("leader")) >= LEAST_EQUAL)
        gone = compared.select("row", F.lit(True).alias("gone")).distinct()
        marked = cut(placed.join(gone, "row", "left").withColumn("kept", F.when(F.col("gone"), False).when(~F.col("behind"), True)))
        now = marked.where("kept IS NOT NULL").select("row", "kept")
        settled = now if settled is None else settled.unionByName(now)
        rest = marked.where("kept IS NULL").select("row", "sketch")
        open_rows, done = rest.count(), now.count()
        if done * 9 < open_rows or not open_rows:
            break
    return rest, settled


def near_reasons(sketched: DataFrame, id_col: str, prior: DataFrame | None = None, most: int = BUCKET) -> DataFrame:
    """(id, near): true where an earlier kept row has an equal or near sketch.

    All rows of ``prior``, with the same columns, come before and are kept.
    """
    rows = sketched.select(F.struct(F.lit(1).alias("late"), F.col(id_col).alias("id")).alias("row"), "sketch")
    if prior is not None:
        rows = rows.unionByName(prior.select(F.struct(F.lit(0).alias("late"), F.col(id_col).alias("id")).alias("row"), "sketch"))
    rows = cut(rows)
    classes = cut(rows.groupBy("sketch").agg(F.min("row").alias("row")))
    rest, settled = crowds(classes, most)
    pairs = near_pairs(rest, "row", most=most)
    if prior is not None:
        # Prior rows are kept whatever lies near them: among themselves they make no pairs.
        pairs = pairs.where("b.late = 1")
    status = keep_first(pairs)
    if settled is not None:
        status = status.unionByName(settled.withColumnRenamed("row", "id"))
    firsts = classes.withColumnRenamed("row", "first")
    placed = rows.where("row.late = 1").join(firsts, "sketch").join(status.withColumnRenamed("id", "first"), "first", "left")
    return placed.select(F.col("row.id").alias(id_col), ((F.col("row") != F.col("first")) | ~F.coalesce("kept", F.lit(True))).alias("near"))


def near_any(sketched: DataFrame, prior: DataFrame, id_col: str) -> DataFrame:
    """(id, near): whether a row's sketch is equal or near to one of the prior rows'."""
    both = cut(sketched.select(id_col, "sketch", F.lit(1).alias("late")).unionByName(prior.select(id_col, "sketch", F.lit(0).alias("late"))))
    classes = cut(both.groupBy("sketch").agg(F.min("late").alias("late"), F.min(F.struct("late", id_col)).alias("row")))
    pairs = near_pairs(classes.select("sketch", "row"), "row")
    found = pairs.where("a.late = 0").select(F.col("b").alias("row")).distinct().withColumn("found", F.lit(True))
    placed = classes.join(found, "row", "left").select("sketch", ((F.col("late") == 0) | F.coalesce("found", F.lit(False))).alias("near"))
    return both.where("late = 1").join(placed, "sketch").select(id_col, "near")


def with_prior(new: DataFrame, prior: DataFrame, order: list[str]) -> DataFrame:
    """Prior rows first, so that they win; the ``prior`` flag tells them apart."""
    return reduce(DataFrame.unionByName, [prior.withColumn("prior", F.lit(0)), new.withColumn("prior", F.lit(1))]).withColumn(
        "__order", F.struct("prior", *order)
    )
