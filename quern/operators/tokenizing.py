"""Byte-level tokens as Arrow UDFs, and the counts of pre-tokens; no tokenizer is trained here.

The default vocabulary is the 256 bytes behind the special ids, so nothing needs to be at hand; a
tokenizer file of the ``tokenizers`` library may take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.functions.arrays import buffers, slices
from quern.functions.text import normalize
from quern.runtime import ship

PAD, BOS, EOS, UNK = range(4)
SPECIAL = 4


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _flat_ids(texts: pa.Array, path: str | None, end_id: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of all texts, each closed by the end id; a null text counts as empty."""
    if path is None:
        at, raw = buffers(texts)
        ends = at[1:] + np.arange(len(texts))
        ids = np.insert(raw.astype(kind) + kind(SPECIAL), at[1:], kind(end_id))
        return np.r_[0, ends + 1], ids
    lists = [e.ids for e in _load(path).encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    offsets = np.r_[0, np.cumsum([len(x) + 1 for x in lists])].astype(np.int64)
    wide = np.full(int(offsets[-1]), end_id, np.int64)
    for x, a in zip(lists, offsets.tolist()):
        wide[a : a + len(x)] = x
    return offsets, checked_ids(wide) if kind is np.uint16 else wide.astype(kind)


def checked_ids(ids: np.ndarray) -> np.ndarray:
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("token id outside uint16")
    return ids.astype(np.uint16)


def packed_array(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """uint16 ids as binary cells."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])


def _by_slices(texts: pa.Array, made: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``made`` of a bounded amount of text at a time."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    done = [made(part.column(0)) for part in slices(batch, 0)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def encode(df: DataFrame, text_col: str, path: str | None = None, end_id: int = EOS) -> DataFrame:
    """An ``ids`` column that closes with the end id; the tokenizer is loaded once a worker."""
    ship(df.sparkSession)

    def made(texts: pa.Array) -> pa.Array:
        offsets, ids = _flat_ids(texts, path, end_id, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, made, pa.list_(pa.int32()))

    return df.withColumn("ids", ids(F.col(text_col)))


def encode_packed(df: DataFrame, text_col: str, path: str | None = None, end_id: int = EOS) -> DataFrame:
    """A ``packed`` column: the ids of ``encode`` as little-endian uint16, half as wide; ids above 65,535 are an error."""
    ship(df.sparkSession)

    def made(texts: pa.Array) -> pa.Array:
        return packed_array(*_flat_ids(texts, path, end_id, np.uint16))

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, made, pa.binary())

    return df.withColumn("packed", ids(F.col(text_col)))


def packed(df: DataFrame, ids_col: str) -> DataFrame:
    """A ``packed`` column of a column of id lists, as ``encode_packed`` makes it."""
    ship(df.sparkSession)

    @F.arrow_udf("binary")
    def narrow(ids: pa.Array) -> pa.Array:
        lists = ids.fill_null([]) if ids.null_count else ids
        flat = checked_ids(lists.flatten().to_numpy(zero_copy_only=False))
        return packed_array(np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64), flat)

    return df.withColumn("packed", narrow(F.col(ids_col)))


def unpacked(df: DataFrame, name: str = "ids") -> DataFrame:
    """The ids of the column ``packed`` as lists, under ``name`` and in its place."""
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def wide(cells: pa.Array) -> pa.Array:
        at, raw = buffers(cells)
        return pa.ListArray.from_arrays(pa.array(at // 2, pa.int32()), pa.array(np.frombuffer(raw.tobytes(), "<u2").astype(np.int32)))

    return df.withColumn(name, wide(F.col("packed"))).drop("packed")


def moved_blanks(context: str | None, continuation: str | None) -> tuple[str, str]:
    """Blanks at the end of a context belong to what follows; an empty context is an error."""
    if not context:
        raise ValueError("a pair without a context")
    bare = context.rstrip()
    return bare, context[len(bare) :] + (continuation or "")


def encode_pairs(df: DataFrame, context: str, continuation: str, path: str | None = None) -> DataFrame:
    """``df`` with ``context_ids`` and ``continuation_ids``: both texts are encoded as one, and the context's ids cut off.

    So a token at the border reads as it does in the whole text.  Slices of bounded text go through at a time; without a
    tokenizer file the ids are bytes.
    """
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in ("context_ids", "continuation_ids"))])
    first, second = df.columns.index(context), df.columns.index(continuation)

    def listed(ids: list[np.ndarray]) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        if path is None:
            return [np.frombuffer(t.encode(), np.uint8).astype(np.int32) + SPECIAL for t in texts]
        return [np.array(e.ids, np.int32) for e in _load(path).encode_batch(texts, add_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, first, 1 << 19):
                moved = [moved_blanks(a, b) for a, b in zip(part.column(first).to_pylist(), part.column(second).to_pylist())]
                begun, whole = ids_of([a for a, _ in moved]), ids_of([a + b for a, b in moved])
                rest = [w[len(c) :] for c, w in zip(begun, whole)]
                yield pa.RecordBatch.from_arrays([*part.columns, listed(begun), listed(rest)], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str, path: str | None = None) -> DataFrame:
    """A ``decoded`` column; special ids are left out."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        if path is None:
            return ids.map(lambda x: bytes(i - SPECIAL for i in x if i >= SPECIAL).decode("utf-8", "replace"))
        return ids.map(lambda x: _load(path).decode([i for i in x if i >= SPECIAL]))

    return df.withColumn("decoded", text(F.col(ids_col)))


def decoded_bytes(ids: Column) -> Column:
    """The text of byte tokens, in generated code."""
    digits = F.transform(ids, lambda i: F.lpad(F.hex((i - SPECIAL).cast("long")), 2, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-8")


def pretoken_counts(df: DataFrame, text_col: str, digits: bool = False) -> DataFrame:
    """White-space pre-tokens with their counts, partly summed before the shuffle; on request every digit stands alone."""
    text = normalize(F.col(text_col))
    if digits:
        text = F.regexp_replace(text, r"(\p{Nd})", " $1 ")
    words = df.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bytes_per_token(df: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    counted = encode(df, text_col, path).select(F.octet_length(text_col).alias("b"), (F.size("ids") - 1).alias("k"))
    return counted.agg((F.sum("b") / F.sum("k")).alias("bytes_per_token"))
