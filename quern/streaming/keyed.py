"""First-wins deduplication over a stream with keyed state: digests, URLs and the bands of sketches.

One stateful operator (``transformWithState`` on a RocksDB store) holds, by key, what was seen: a digest or a URL that
any row has had, and under each band the sketches of rows that stayed.  A batch looks up its own keys alone, so its work
does not grow with the state.  Which rows stay is decided among the rows of the batch that repeat nothing seen; their
bands come back as a second, internal stream, which the next batch stores before it looks anything up.

Output and bands of a batch overwrite folders of their own and the state store keeps a version a batch, so a batch that
runs twice counts once and a stream that is stopped anywhere goes on where the last finished batch ended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quern.functions.numeric import COMPONENTS, ROWS
from quern.functions.text import canonical_url, digest, normalize
from quern.operators import dedup
from quern.runtime import cut, ship
from quern.streaming.incremental import file_stream

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys, each of which is one call of the operator in a batch; fixed for the life of a stream.
GROUPS = 64

#: A near copy differs in so many components less one at most and each spoils one band, so one of these bands is equal.
STORED_BANDS = COMPONENTS - dedup.LEAST_EQUAL + 1
#: Bits of a group's filter, a power of two: 256 KB, whatever the state.
FILTER_BITS = 1 << 21

_HITS = "pos long, key string, hit boolean, payload string"


def _places(marks: np.ndarray, size: int = FILTER_BITS) -> list[np.ndarray]:
    """Two bits of a filter for each 64-bit hash; its low bits name the group."""
    hashes = marks.astype(np.int64).view(np.uint64)
    return [((hashes >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64) for shift in (22, 43)]


class Seen(StatefulProcessor):
    """Stores keys and tells which were there before.

    Input rows are (grp, mark, stored, key, pos, sketch, payload): stored rows of a band add their sketch; other rows ask.
    Keys without a sketch are stored by asking.  Rows with a payload always come out, others only where they hit.

    Every key that is looked up or stored costs a call to the store, so a filter of fixed size tells of most new keys that
    they are not there; where it fills, more keys are looked up and the result is the same.
    """

    def __init__(self, size: int = FILTER_BITS):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "sketches binary")
        self.filter = handle.getValueState("filter", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        places = _places(batch["mark"].to_numpy(), self.size)
        if (kept := self.filter.get()) is not None:
            bits = np.frombuffer(bytes(kept[0]), np.uint8).copy()
        else:
            # State of a stream that began without a filter is looked up key by key.
            bits = np.full(self.size // 8, 255 if self.keys.exists() else 0, np.uint8)
        batch["there"] = np.logical_and(*((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1 for p in places))
        held: dict[str, bytes | None] = {}

        def get(name: str, there: bool) -> bytes | None:
            if name not in held:
                value = self.keys.getValue((name,)) if there else None
                held[name] = None if value is None else bytes(value[0])
            return held[name]

        new: dict[str, tuple[bool, list[bytes]]] = {}
        for name, there, sketch in batch.loc[batch["stored"], ["key", "there", "sketch"]].itertuples(index=False):
            new.setdefault(name, (there, []))[1].append(np.asarray(sketch, "<u4").tobytes())
        for name, (there, sketches) in new.items():
            held[name] = (get(name, there) or b"") + b"".join(sketches)
            self.keys.updateValue((name,), (held[name],))
        out, asked = [], {}
        for pos, name, there, sketch, payload in batch.loc[~batch["stored"], ["pos", "key", "there", "sketch", "payload"]].itertuples(index=False):
            before = get(name, there)
            if sketch is None:
                hit = before is not None
                if not hit:
                    asked[name] = b""
            else:
                hit = bool(before) and bool(((np.frombuffer(before, "<u4").reshape(-1, COMPONENTS) == np.asarray(sketch, "<u4")).sum(axis=1) >= dedup.LEAST_EQUAL).any())
            if hit or payload is not None:
                out.append((pos, name, hit, payload))
        for name, value in asked.items():
            self.keys.updateValue((name,), (value,))
        # Bands are in the store once their sketches are; keys without a sketch once they were asked for.
        added = (batch["stored"] | batch["sketch"].isna()).to_numpy()
        for p in places:
            np.bitwise_or.at(bits, p[added] >> 3, np.left_shift(1, p[added] & 7).astype(np.uint8))
        self.filter.update((bits.tobytes(),))
        yield pd.DataFrame(out, columns=["pos", "key", "hit", "payload"])

    def close(self) -> None:
        pass


def _bands(sketch: Column) -> list[Column]:
    return [F.concat(F.lit(f"band{b}:"), F.array_join(F.slice(sketch, b * ROWS + 1, ROWS), ",")) for b in range(STORED_BANDS)]


def _key(name: Column, pos: Column | None, sketch: Column | None = None, payload: Column | None = None) -> Column:
    return F.struct(
        name.alias("key"),
        (F.lit(None) if pos is None else pos).cast("long").alias("pos"),
        (F.lit(None) if sketch is None else sketch).cast("array<long>").alias("sketch"),
        (F.lit(None) if payload is None else payload).cast("string").alias("payload"),
    )


def _asked(stream: DataFrame, order: str, text_col: str, url_col: str) -> DataFrame:
    """The keys of each row; what decides about it and the file that holds it travel with the key of its digest."""
    url = canonical_url(F.col(url_col)) if url_col in stream.columns else F.lit("")
    normal = normalize(F.coalesce(F.col(text_col), F.lit("")))
    rows = stream.select(F.col(order).cast("long").alias("pos"), F.coalesce(url, F.lit("")).alias("u"), F.col("_metadata.file_path").alias("file"), normal.alias("normal"))
    known = dedup.with_sketch(rows, "normal").withColumn("digest", digest(F.col("normal")))
    payload = F.to_json(F.struct("digest", "u", "sketch", "file"))
    first = [_key(F.concat(F.lit("digest:"), "digest"), F.col("pos"), payload=payload), _key(F.concat(F.lit("url:"), F.when(F.col("u") != "", F.sha2("u", 256))), F.col("pos"))]
    keys = F.filter(F.array(*first, *(_key(b, F.col("pos"), F.col("sketch")) for b in _bands(F.col("sketch")))), lambda k: k["key"].isNotNull())
    return known.select(F.explode(keys).alias("k"))


def _rows(keys: DataFrame, stored: bool, groups: int) -> DataFrame:
    mark = F.xxhash64("k.key")
    return keys.select(F.pmod(mark, F.lit(groups)).cast("int").alias("grp"), mark.alias("mark"), F.lit(stored).alias("stored"), "k.key", "k.pos", "k.sketch", "k.payload")


def decided(hits: DataFrame) -> DataFrame:
    """(pos, digest, u, sketch, file) of the rows of a batch that stay, from what the state said of their keys (a written table)."""
    parsed = hits.where("payload IS NOT NULL").select("pos", F.from_json("payload", "digest string, u string, sketch array<long>, file string").alias("p"))
    rows = cut(parsed.select("pos", "p.*"))
    fresh = dedup.exact_and_url_reasons(rows.select("pos", "digest", "u"), "digest", "u", "pos").where("reason IS NULL").select("pos")
    open_rows = rows.join(fresh, "pos").join(hits.where("hit").select("pos").distinct(), "pos", "left_anti")
    open_rows = cut(open_rows)
    near = dedup.near_reasons(open_rows.select("pos", "sketch"), "pos").where("NOT near").select("pos")
    return cut(open_rows.join(near, "pos"))


def _literal(url: str) -> str:
    """The path of a file, as Spark's metadata give it, for a reader, which would take some signs for a glob's."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(url))


def keyed_dedup(spark: SparkSession, source: str, schema: StructType, folder: str, order: str = "doc_id", text_col: str = "text", url_col: str = "url", files: int | None = None, groups: int = GROUPS, size: int = FILTER_BITS) -> None:
    """Read what is new under ``source`` and write the rows that repeat nothing before them to ``folder``/out/batch=N.

    A row repeats an earlier one of equal digest or URL, whether that stayed or not, or one that stayed and whose sketch
    is near.  Rows of a batch come in the order of ``order``, which is unique; batches in their own order.
    ``size``, the bits of a group's filter, is fixed for the life of a stream.
    """
    ship(spark)
    back = f"{folder}/bands"
    marked = "key string, sketch array<long>"
    spark.createDataFrame([], marked).write.mode("ignore").parquet(f"{back}/batch=start")

    def write(hits: DataFrame, number: int) -> None:
        hits = cut(hits)
        # A batch that only stores bands writes nothing: an empty file of bands would call for a batch of its own.
        if hits.isEmpty() or (kept := decided(hits)).isEmpty():
            return
        # Texts pass neither the state nor a checkpoint: rows that stay are read again from the files of the batch.
        rows = spark.read.schema(schema).parquet(*(_literal(r["file"]) for r in kept.select("file").distinct().collect()))
        rows = rows.join(kept.select("pos"), F.col(order).cast("long") == F.col("pos"), "left_semi")
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        bands = kept.select(F.explode(F.array(*_bands(F.col("sketch")))).alias("key"), "sketch")
        bands.write.mode("overwrite").parquet(f"{back}/batch={number}")

    asked = _rows(_asked(file_stream(spark, source, schema, files=files), order, text_col, url_col), False, groups)
    known = file_stream(spark, f"{back}/batch=*", spark.createDataFrame([], marked).schema)
    stored = _rows(known.select(_key(F.col("key"), None, F.col("sketch")).alias("k")), True, groups)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        hits = asked.unionByName(stored).groupBy("grp").transformWithStateInPandas(Seen(size), _HITS, "Append", "None")
        query = hits.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
