"""Embedding near-duplicates by spherical-cap filters: product codes, list decoding, a join on filters, exact cosines.

A vector is turned at random and split into blocks; each block has a small random code, and every combination of one
code word a block is a filter direction.  The best sums over blocks are listed without looking at all combinations: a
partial sum that even the best rest cannot carry over the threshold is dropped.  A vector belongs to all filters whose
direction it exceeds the threshold with, about ``listed`` on average and ``fewest`` at least.  Vectors of one label that
share a filter are compared, in double precision, in blocks of bounded size; the number of directions grows with the
rows of the largest label, so that a filter holds about ``load`` of them however large the table is.

A pair meets in many filters.  It counts in the first one that both are listed in, so no pair ever leaves a task: what
leaves are a number of links for each vector and a spanning forest of each block.  Equal vectors are one class with a
number.  A filter above ``block`` rows is compared in pairs of blocks.

Results that are defined: a vector that is null, empty, zero, or has a null or non-finite component, and one without a
label, links with nothing; vectors of different lengths do not link; rows that repeat an id each get their row, and an
id that is null never names a component, unless there is no other; extra columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quern.llm.simhash import _spanning, components
from quern.runtime import cut, release, ship

LEAST = 0.98
LISTED = 20
FEWEST = 6
LOAD = 64
BLOCK = 2048
#: Rows and columns that are compared at a time.
TILE = 512
SEED = 42


@lru_cache(maxsize=8)
def code(dim: int, size: int, blocks: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and code words (size, width) of each block, so that whole directions have length one."""
    draws = np.random.default_rng([seed, dim, size, blocks])
    turn = np.linalg.qr(draws.standard_normal((dim, dim)))[0]
    made = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        words = draws.standard_normal((size, len(part)))
        made.append(words / np.linalg.norm(words, axis=1, keepdims=True) * np.sqrt(len(part) / dim))
    return turn, made


def scores(units: np.ndarray, size: int, blocks: int, seed: int) -> list[np.ndarray]:
    """Inner products of unit vectors with the code words of each block."""
    turn, words = code(units.shape[1], size, blocks, seed)
    turned, at, out = units @ turn, 0, []
    for w in words:
        out.append(turned[:, at : at + w.shape[1]] @ w.T)
        at += w.shape[1]
    return out


def decode(found: list[np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions whose sum over the blocks reaches the row's bound, by row and direction."""
    rest = [np.zeros(len(bound))]
    for v in reversed(found[1:]):
        rest.append(rest[-1] + v.max(axis=1))
    rest.reverse()
    row, direction, total = np.arange(len(bound)), np.zeros(len(bound), np.int64), np.zeros(len(bound))
    for v, best in zip(found, rest):
        rows, words, sums = [], [], []
        step = max(1, (1 << 21) // v.shape[1])
        for i in range(0, len(row), step):
            r = row[i : i + step]
            s = total[i : i + step, None] + v[r]
            a, b = np.nonzero(s >= (bound[r] - best[r])[:, None])
            rows.append(r[a])
            words.append(direction[i : i + step][a] * v.shape[1] + b)
            sums.append(s[a, b])
        row, direction, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, words, sums))
    order = np.lexsort((direction, row))
    return row[order], direction[order]


@lru_cache(maxsize=8)
def threshold(dim: int, size: int, blocks: int, seed: int, listed: int) -> float:
    """The inner product that ``listed`` directions exceed for a random vector, on average."""
    draws = np.random.default_rng([seed, 1])
    some = draws.standard_normal((256, dim))
    found = scores(some / np.linalg.norm(some, axis=1, keepdims=True), size, blocks, seed)
    if size ** len(found) <= listed:
        return -1.0
    low, high = -1.0, 1.0
    # From above, so that the lists stay short.
    while high - low > 1e-3:
        middle = high - min(0.05, (high - low) / 2)
        if len(decode(found, np.full(len(some), middle))[0]) < listed * len(some):
            high = middle
        else:
            low = middle
    return high


def filters(units: np.ndarray, size: int, blocks: int, seed: int, listed: int, fewest: int) -> list[np.ndarray]:
    """The sorted directions that each vector is listed in."""
    found = scores(units, size, blocks, seed)
    bound = np.full(len(units), threshold(units.shape[1], size, blocks, seed, listed))
    fewest = min(fewest, size ** len(found))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
    todo = np.arange(len(units))
    while len(todo):
        row, direction = decode([v[todo] for v in found], bound[todo])
        ends = np.searchsorted(row, np.arange(len(todo) + 1))
        short = np.diff(ends) < fewest
        for k in np.flatnonzero(~short):
            out[todo[k]] = direction[ends[k] : ends[k + 1]]
        todo = todo[short]
        bound[todo] -= 0.02
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large and small components neither overflow nor vanish."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as arrays; none where a vector can't have a cosine."""
    offsets, inner = column.offsets.to_numpy(), column.values
    values, holes = inner.to_numpy(zero_copy_only=False), inner.is_null().to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        v = values[a:b]
        good = there[k] and b > a and not holes[a:b].any() and np.isfinite(v).all() and v.any()
        out.append(v if good else None)
    return out


def _first_meetings(early: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) have no earlier filter in common."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sizes = np.fromiter((len(early[r]) for r in rows), np.int64, len(rows))
    if not sizes.any():
        return np.ones(len(a), bool)
    names, which = np.unique(np.concatenate([early[r] for r in rows]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    owner = np.repeat(np.arange(len(rows)), sizes)
    if len(rows) ** 2 * len(names) <= 600 * len(a) * 64:
        held = np.zeros((len(rows), len(names)), np.float32)
        held[owner, which] = 1
        return (held @ held.T)[x, y] == 0
    table = np.full((len(rows), int(sizes.max())), -1, np.int64)
    table[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = which
    again = np.zeros(len(a), bool)
    for k in range(0, len(a), 65_536):
        left, right = table[x[k : k + 65_536]], table[y[k : k + 65_536]]
        for c in range(left.shape[1]):
            again[k : k + 65_536] |= ((left[:, c, None] == right) & (left[:, c, None] >= 0)).any(axis=1)
    return ~again


def compare(units: np.ndarray, weight: np.ndarray, early: list[np.ndarray], side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row that no earlier filter has shown, and a spanning forest (child, root) of all links.

    ``side`` tells the two blocks of a large filter apart, which are compared with each other alone; where all rows
    are of one side, all are compared.
    """
    links, labels = np.zeros(len(units), np.int64), np.arange(len(units))
    both = side.min() != side.max()
    first, second = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if both else (np.arange(len(units)),) * 2
    for i in range(0, len(first), TILE):
        for j in range(0 if both else i, len(second), TILE):
            p, q = first[i : i + TILE], second[j : j + TILE]
            near = units[p] @ units[q].T >= least
            if not both and i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = p[a], q[b]
            _spanning(labels, np.minimum(a, b), np.maximum(a, b))
            fresh = _first_meetings(early, a, b)
            a, b = a[fresh], b[fresh]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
    child = np.flatnonzero(labels != np.arange(len(units)))
    return links, child, labels[child]


_RESULT = StructType([StructField(c, LongType()) for c in ("node", "links", "root")])


def cap_links(classes: DataFrame, least: float, size: int, blocks: int, listed: int, fewest: int, block: int, seed: int) -> DataFrame:
    """(node, links, root): numbers of links (root null), and links of a spanning forest (links null), of classes
    (node, label, dim, weight, raw, wide)."""
    ship(classes.sparkSession)

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [np.float64 if w else np.float32 for w in batch.column(batch.schema.get_field_index("wide")).to_pylist()]
            vectors = [np.frombuffer(x, k) for x, k in zip(batch.column(batch.schema.get_field_index("raw")).to_pylist(), kinds)]
            dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
            out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vectors)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for k in range(0, len(at), 1024):
                    some = at[k : k + 1024]
                    for r, f in zip(some, filters(unit(np.array([vectors[x] for x in some], np.float64)), size, blocks, seed, listed, fewest)):
                        out[r] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])

    placed = cut(classes.mapInArrow(list_all, StructType([*classes.schema.fields, StructField("filters", ArrayType(LongType()))])))
    key = ["label", "dim", "filter"]
    large = cut(placed.select("label", "dim", F.explode("filters").alias("filter")).groupBy(*key).count().where(F.col("count") > block))
    each = placed.select("label", "dim", "node", "weight", "wide", "raw", F.col("filters").alias("all"), F.posexplode("filters").alias("place", "filter"))
    each = each.withColumn("early", F.slice("all", F.lit(1), F.col("place"))).drop("all", "place")
    if large.isEmpty():
        dealt = each.withColumns({"side": F.lit(0), "one": F.lit(0), "two": F.lit(0)})
    else:
        # Block b of g meets block k for all k; the rows of a pair of blocks are one group.
        marked = each.join(large, key, "left").withColumn("g", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
        marked = marked.withColumn("side", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        dealt = marked.withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")}).drop("count", "g", "other")
    group = [*key, "one", "two"]

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            side = rows.column("side").to_numpy()
            one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
            if rows.num_rows < 2 or (one != two and side.min() == side.max()):
                return
            kind = [np.float64 if w else np.float32 for w in rows.column("wide").to_pylist()]
            units = unit(np.array([np.frombuffer(x, k) for x, k in zip(rows.column("raw").to_pylist(), kind)], np.float64))
            listed_early = rows.column("early").combine_chunks()
            at, values = listed_early.offsets.to_numpy(), listed_early.values.to_numpy()
            early = [values[a:b] for a, b in zip(at[:-1], at[1:])]
            node = rows.column("node").to_numpy()
            links, child, root = compare(units, rows.column("weight").to_numpy(), early, side, least)
            some = np.flatnonzero(links)
            if len(some) or len(child):
                none = [None] * len(child)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[node[some], node[child]]), pa.array(links[some].tolist() + none, pa.int64()), pa.array([None] * len(some) + node[root].tolist(), pa.int64())],
                    ["node", "links", "root"],
                )

        held: list[pa.Table] = []  # the group that may go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            new = np.zeros(batch.num_rows, bool)
            for c in group:
                v = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                now = tuple(table.column(c)[a].as_py() for c in group)
                if now != last and held:
                    yield from made(pa.concat_tables(held))
                    held = []
                last = now
                held.append(table.slice(a, b - a))
        if held:
            yield from made(pa.concat_tables(held))

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare_all, _RESULT)


def embedding_components(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    least: float = LEAST,
    blocks: int = 2,
    listed: int = LISTED,
    fewest: int = FEWEST,
    load: int = LOAD,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links (other vectors linked directly), component_id, kept."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("vec"))
    if rows.schema["vec"].dataType.elementType.simpleString() not in ("float", "double"):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    wide = rows.schema["vec"].dataType.elementType.simpleString() == "double"

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _usable(batch.column(2))
            raw = [None if v is None else (v + 0.0).tobytes() for v in vectors]  # one zero, whatever its sign
            digest = [None if x is None else hashlib.sha256(x).digest() for x in raw]
            dims = [None if v is None else len(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digest, pa.binary()), pa.array(dims, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "label", "digest", "dim", "raw"])

    kept = [rows.schema["vec_id"], rows.schema["label"], StructField("digest", BinaryType()), StructField("dim", LongType()), StructField("raw", BinaryType())]
    rows = cut(rows.mapInArrow(as_bytes, StructType(kept)))
    usable = F.col("digest").isNotNull() & F.col("label").isNotNull()
    lead = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("lead")
    grouped = rows.where(usable).groupBy("label", "digest").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("weight"), lead)
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    size = max(4, int(np.ceil((largest * listed / load) ** (1 / blocks))))
    narrow = classes.select("node", "label", "dim", "weight", "raw", F.lit(wide).alias("wide"))
    found = cut(cap_links(narrow, least, size, blocks, listed, fewest, block, seed))
    links = found.where("root is not null").select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(links)
    numbers = found.where("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    release(df.sparkSession)
    joined = classes.select("label", "digest", "node", "weight", "lead").join(roots.withColumnRenamed("u", "node"), "node", "left").join(numbers, "node", "left")
    placed = cut(joined.select("label", "digest", "lead", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    first = cut(placed.groupBy("root").agg(F.min("lead").alias("first")))
    named = cut(placed.join(first, "root").select("label", "digest", "n_links", F.col("first.vec_id").alias("component_id")))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where(usable).join(named, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
