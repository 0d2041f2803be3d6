"""Exact deduplication by composable polynomial fingerprints.

A fingerprint is (length, four residues).  Residue ``j`` of bytes ``b[0..n)`` is
``sum(b[i] * B_j**(n-1-i)) mod 2**31-1``.  It composes: ``H(a+b) = H(a) * B**len(b) + H(b)``, so
chunks are hashed in parallel (those of a huge text by many tasks) and joined by length-shifted arithmetic.
Equal fingerprints are not
trusted: the texts that share one are compared chunk by chunk in a stream, and a fingerprint that two
different texts share is split by their SHA-256.

Results that are defined: a null text equals an empty one; of rows that repeat an id within a group,
exactly one is kept; null ids sort below all others; a text of any length is hashed in segments; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from quern.llm.common import map_text, narrow, slices, texts_as_bytes
from quern.runtime import cut, ship

PRIME = (1 << 31) - 1
CHUNK = 1024
SEGMENT = 1 << 18
#: Bits of the bounded map of repeated fingerprints: 2 MB, whatever the size of the corpus.
MAP_BITS = 24
#: Longer texts are hashed in pieces of this size by many tasks.
HUGE = 16 << 20
#: Copies of one text are dealt over so many tasks before their representatives meet.
SALTS = 64


@dataclass(frozen=True)
class Hasher:
    """Bases of the residues; tests use few and small ones to force collisions."""

    bases: tuple[int, ...] = (1103515245, 1664525069, 69069691, 1812433253)
    prime: int = PRIME
    powers: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        table = np.ones((CHUNK, len(self.bases)), np.int64)
        for j, base in enumerate(self.bases):
            value = 1
            for i in range(CHUNK - 1, -1, -1):
                table[i, j] = value
                value = value * base % self.prime
        # 255 * 2**31 * 1024 < 2**53: the products of a chunk add up exactly in float64.
        object.__setattr__(self, "powers", table.astype(np.float64))

    def segments(self, parts: list[bytes]) -> np.ndarray:
        """Residues of each part (at most SEGMENT bytes), all chunks in one matrix product."""
        rows = np.array([max(1, -(-len(p) // CHUNK)) for p in parts], np.int64)
        ends = np.cumsum(rows)
        grid = np.zeros(int(ends[-1]) * CHUNK, np.uint8)
        for p, end in zip(parts, ends.tolist()):
            grid[end * CHUNK - len(p) : end * CHUNK] = np.frombuffer(p, np.uint8)
        chunks = (grid.reshape(-1, CHUNK).astype(np.float64) @ self.powers).astype(np.int64) % self.prime
        behind = np.repeat(ends, rows) - 1 - np.arange(int(ends[-1]))
        out = np.empty((len(parts), len(self.bases)), np.int64)
        starts = ends - rows
        for j, base in enumerate(self.bases):
            step = pow(base, CHUNK, self.prime)
            shift = np.ones(int(behind.max()) + 1, np.int64)
            for i in range(1, len(shift)):
                shift[i] = shift[i - 1] * step % self.prime
            out[:, j] = np.add.reduceat(chunks[:, j] * shift[behind] % self.prime, starts) % self.prime
        return out

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """Fingerprint of a text from those of its two parts; the first item is the length."""
        return (a[0] + b[0], *((x * pow(base, b[0], self.prime) + y) % self.prime for x, y, base in zip(a[1:], b[1:], self.bases)))

    def many(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """Fingerprints of texts; some segments of them at a time."""
        out: list[tuple[int, ...]] = [(0, *(0 for _ in self.bases))] * len(texts)
        pieces = ((i, t[a : a + SEGMENT]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT))
        held: list[tuple[int, bytes]] = []
        size = 0

        def add() -> None:
            for (i, part), residues in zip(held, self.segments([p for _, p in held]).tolist()):
                own = (len(part), *residues)
                out[i] = self.join(out[i], own) if out[i][0] else own

        for piece in pieces:
            held.append(piece)
            size += -(-len(piece[1]) // CHUNK) * CHUNK
            if size >= 4 * SEGMENT:
                add()
                held, size = [], 0
        if held:
            add()
        return out

    def key(self, whole: tuple[int, ...]) -> bytes:
        return whole[0].to_bytes(8, "big") + b"".join(x.to_bytes(4, "big") for x in whole[1:])

    def keys(self, texts: list[bytes]) -> list[bytes]:
        return [self.key(whole) for whole in self.many(texts)]


def _slot(key: bytes) -> int:
    """Place in the bounded map, from the residues and the length together."""
    return int.from_bytes(hashlib.blake2b(key, digest_size=4).digest(), "big") >> (32 - MAP_BITS)


_PRINT = [StructField("fp", BinaryType()), StructField("slot", LongType()), StructField("text_sha256", StringType())]


def fingerprints(df: DataFrame, hasher: Hasher | None = None, huge: int = HUGE) -> DataFrame:
    """doc_id, text_key, fp, slot, text_sha256 of every row of (doc_id, text).

    Texts above ``huge`` bytes are cut into pieces that many tasks hash; their fingerprints are composed from these.
    """
    hasher = hasher or Hasher()

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = texts_as_bytes(column)
        keys = hasher.keys(texts)
        return [
            pa.array(keys, pa.binary()),
            pa.array([_slot(k) for k in keys], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        ]

    keyed = df.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    large = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    usual = map_text(keyed.where(~large), ["doc_id", "text_key"], "text", compute, _PRINT)
    return usual.unionByName(_composed(keyed.where(large), hasher, huge))


def _composed(df: DataFrame, hasher: Hasher, piece: int) -> DataFrame:
    """The same columns for huge texts: pieces are dealt out, hashed, and composed in order."""
    keep = [df.schema["doc_id"], df.schema["text_key"], StructField("text_sha256", StringType()), StructField("row", LongType()), StructField("part", LongType())]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for one in slices(batch, 2, 0):
                text = texts_as_bytes(one.column(2))[0]
                row += 1
                digest = hashlib.sha256(text).hexdigest()
                for part, a in enumerate(range(0, len(text), piece)):
                    values = [pa.array([digest]), pa.array([row], pa.int64()), pa.array([part], pa.int64()), pa.array([text[a : a + piece]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *values], [*(f.name for f in keep), "body"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hasher.many(texts_as_bytes(batch.column(5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.list_(pa.int64()))], [*(f.name for f in keep), "print"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hasher.key(reduce(hasher.join, (tuple(p["print"]) for p in parts))) for parts in batch.column(3).to_pylist()]
            slots = pa.array([_slot(k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary()), slots, batch.column(2)], ["doc_id", "text_key", "fp", "slot", "text_sha256"])

    ship(df.sparkSession)
    pieces = df.select("doc_id", "text_key", "text").mapInArrow(dealt, StructType([*keep, StructField("body", BinaryType())]))
    prints = pieces.repartition("row", "part").mapInArrow(hashed, StructType([*keep, StructField("print", ArrayType(LongType()))]))
    # A piece's fingerprint takes some fifty bytes, so the list of a text of the longest kind stays small.
    parts = F.sort_array(F.collect_list(F.struct("part", "print"))).alias("parts")
    whole = prints.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "text_key", "text_sha256")), parts).drop("row")
    return whole.mapInArrow(joined, StructType([*keep[:2], *_PRINT]))


def _repeated_map(groups: DataFrame) -> np.ndarray:
    """Bitmap over the slots of repeated fingerprints; its size is fixed by MAP_BITS."""
    words = groups.groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in words.toLocalIterator():
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def _same(a: bytes, b: bytes, step: int = 1 << 16) -> bool:
    """Chunkwise comparison that stops at the first difference."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + step] == y[i : i + step] for i in range(0, len(a), step))


def _candidates(df: DataFrame, hasher: Hasher, table: np.ndarray) -> DataFrame:
    """Texts whose fingerprint may be repeated, each with a salt that deals copies over tasks."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 0):
                texts = texts_as_bytes(part.column(0))
                fps, out, salts = [], [], []
                for t, k in zip(texts, hasher.keys(texts)):
                    slot = _slot(k)
                    if int(bits[slot >> 6]) >> (slot & 63) & 1:
                        turn += 1
                        fps.append(k)
                        out.append(t)
                        salts.append(turn % SALTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps, pa.binary()), pa.array(salts, pa.int64()), pa.array(out, pa.binary())], ["fp", "salt", "body"]
                )

    schema = StructType([StructField("fp", BinaryType()), StructField("salt", LongType()), StructField("body", BinaryType())])
    return df.select("text").mapInArrow(run, schema)


def _compare(rows: DataFrame, *by: str) -> DataFrame:
    """Stream the rows of each key past its first text; give that text and whether another differed."""
    schema = StructType([StructField("fp", BinaryType()), StructField("body", BinaryType()), StructField("differs", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, differs = None, b"", False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.binary()), pa.array([first], pa.binary()), pa.array([differs], pa.bool_())], ["fp", "body", "differs"]
            )

        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*by, "differs")}
            bodies = texts_as_bytes(batch.column(batch.schema.get_field_index("body")))
            for body, seen, *key in zip(bodies, columns["differs"], *(columns[c] for c in by)):
                if key != at:
                    if at is not None:
                        yield made()
                    at, first, differs = key, body, seen
                else:
                    differs = differs or seen or not _same(first, body)
        if at is not None:
            yield made()

    keys = [F.col(c) for c in by]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def collided(df: DataFrame, hasher: Hasher, groups: DataFrame) -> DataFrame:
    """Fingerprints that different texts share: first within a salt, then between the salts' firsts."""
    rows = _candidates(df, hasher, _repeated_map(groups)).withColumn("differs", F.lit(False))
    firsts = _compare(rows, "fp", "salt")
    return _compare(firsts, "fp").where("differs").select("fp")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Hasher | None = None, huge: int = HUGE) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, fingerprint, text_key, row_key."""
    hasher = hasher or Hasher()
    docs = narrow(df, id_col, text_col)
    prints = cut(fingerprints(docs, hasher, huge).withColumn("row_key", F.monotonically_increasing_id()))

    def grouped(rows: DataFrame) -> DataFrame:
        best = F.max(F.struct("doc_id", "row_key")).alias("best")
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), best, F.first("slot").alias("slot")).where("group_size > 1")

    keyed = prints.withColumn("key", F.col("fp"))
    # Both sides of the join below are written tables, so that AQE can split the task of a hot text.
    groups = cut(grouped(keyed))
    shared = cut(collided(docs, hasher, groups))
    if not shared.isEmpty():
        keyed = (
            keyed.join(shared.withColumn("split", F.lit(True)), "fp", "left")
            .withColumn("key", F.when(F.col("split"), F.concat("fp", F.col("text_sha256").cast("binary"))).otherwise(F.col("fp")))
            .drop("split")
        )
        groups = cut(grouped(keyed))
    joined = keyed.join(groups.drop("slot"), "key", "left")
    lone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("best.row_key") == F.col("row_key"))).alias("kept"),
        "text_sha256",
        F.lower(F.hex("fp")).alias("fingerprint"),
        "text_key",
        "row_key",
    )
