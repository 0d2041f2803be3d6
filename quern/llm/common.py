"""Arrow plumbing shared by the operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.runtime import shared_folder, ship

#: A slice handed to a Python function holds at most so many bytes of text, unless one text is longer.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, dtype=dtype)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    at, raw = utf8_buffers(column)
    whole, at = raw.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(at[:-1], at[1:])]


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of bounded text (its ``text``-th column); a single text is never cut."""
    at, _ = utf8_buffers(batch.column(text))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), first + SLICE_ROWS, n)
        yield batch.slice(first, last - first)
        first = last


def map_text(
    df: DataFrame,
    keep: list[str],
    text: str,
    fn: Callable[[pa.Array], list[pa.Array]],
    fields: list[StructField],
    size: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns unchanged beside the columns that ``fn`` computes from each slice of texts."""
    ship(df.sparkSession)
    names = [*keep, *(f.name for f in fields)]
    schema = StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), size):
                columns = part.columns
                yield pa.RecordBatch.from_arrays([*columns[:-1], *fn(columns[-1])], names)

    columns = [F.col(f"`{c}`") for c in (*keep, text)]
    return df.select(*columns[:-1], columns[-1].alias(unused(keep) + "text")).mapInArrow(run, schema)


def unused(columns: list[str]) -> str:
    """A prefix that no column begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def narrow(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the needed columns, under names of our own, whatever else the table holds."""
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *(F.col(f"`{c}`").alias(c) for c in more),
    )


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet, which is smaller than a checkpoint, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(path)
    return spark.read.parquet(path)
