"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams (ASCII lower case, lengths 3 to 6) with value log(1 + count).  Over
the labelled training rows each feature gets a log-count ratio r = log(p / |p|) - log(q / |q|) of its
smoothed sums in class 1 and 0; features whose counts differ by fewer than ``min_z`` standard errors
are left out.  A logistic regression is fitted on r * value, so the weight of a feature is r * w.

``max_labelled`` bounds the labelled rows that the classifier is fitted on (those with the smallest
hash of their id and, where rows repeat an id, of their text); scoring reads every row and every whole text.

Results that are defined: a null text scores like an empty one; labels that are null are not learnt
from; rows that repeat an id are each learnt from and scored; where one class has no labelled row, every score
is 0; a text of any length is read in parts of bounded size; extra columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from quern.llm.common import map_text, narrow, slices, utf8_buffers
from quern.runtime import cut, ship

SIZES = (3, 4, 5, 6)
HASH_BITS = 18
MAX_LABELLED = 20_000
FOLDS = 5
#: Bytes whose n-grams are counted at a time; a longer text is counted in parts.
PART = 1 << 20
#: Bytes of short texts whose n-grams are counted together; a worker needs some 200 bytes for each.
SLICE = 1 << 18


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of every hashed feature; 0: not used
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _lower(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def _codes(framed: np.ndarray) -> Iterator[np.ndarray]:
    """For each length of :data:`SIZES` the features of all n-grams that begin at a byte, in order."""
    values = framed.astype(np.uint64)
    rolling = np.zeros(len(values), np.uint64)
    for k in range(1, max(SIZES) + 1):
        if len(values) < k:
            return
        rolling = rolling[: len(values) - k + 1] * np.uint64(1000003) + values[k - 1 :]
        if k in SIZES:
            yield (((rolling + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _long(raw: np.ndarray, used: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of one text, a bounded part of it at a time."""
    counts = np.zeros(1 << HASH_BITS, np.int64)
    reach = max(SIZES) - 1
    for a in range(0, len(raw) + 2, PART):
        b = min(a + PART + reach, len(raw) + 2)  # the last n-grams of a part reach into the next
        framed = np.full(b - a, 32, np.uint8)
        first, last = max(a - 1, 0), min(b - 1, len(raw))
        framed[first + 1 - a : last + 1 - a] = _lower(raw[first:last])
        for code in _codes(framed):
            counts += np.bincount(code[:PART], minlength=1 << HASH_BITS)
    if used is not None:
        counts[~used] = 0
    code = np.nonzero(counts)[0]
    return code, counts[code]


def features(at: np.ndarray, raw: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the texts raw[at[i]:at[i + 1]], each framed by blanks; ``used`` keeps some features."""
    size = np.diff(at)
    n = len(size)
    if n == 1 and size[0] > min(PART, SLICE):
        code, counts = _long(raw, used)
        return np.zeros(len(code), np.int64), code, counts
    framed = np.full(int(at[-1]) + 2 * n, 32, np.uint8)
    start = at[:-1] + 2 * np.arange(n)
    row = np.repeat(np.arange(n), size + 2)
    place = np.arange(int(at[-1])) + 2 * np.repeat(np.arange(n), size) + 1
    framed[place] = _lower(raw)
    end = np.repeat(start + size + 2, size + 2)
    rows, codes = [], []
    for k, code in zip(SIZES, _codes(framed)):
        inside = np.arange(len(code)) + k <= end[: len(code)]
        if used is not None:
            inside &= used[code]
        keep = np.nonzero(inside)[0]
        rows.append(row[keep])
        codes.append(code[keep])
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    both, counts = np.unique((np.concatenate(rows) << HASH_BITS) | np.concatenate(codes), return_counts=True)
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1), counts


def _sums(sample: DataFrame) -> DataFrame:
    """Per feature: sums of values and numbers of documents in either class."""
    ship(sample.sparkSession)
    names = ["feature", "p", "q", "dp", "dq"]
    schema = StructType([StructField("feature", LongType()), *(StructField(c, DoubleType()) for c in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((4, 1 << HASH_BITS))
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                row, code, count = features(*utf8_buffers(part.column(1)))
                toxic = part.column(0).to_numpy(zero_copy_only=False)[row] == 1
                value = np.log1p(count)
                for i, which in enumerate((toxic, ~toxic)):
                    table[i] += np.bincount(code, value * which, minlength=1 << HASH_BITS)
                    table[2 + i] += np.bincount(code, which, minlength=1 << HASH_BITS)
        seen = np.nonzero(table[2] + table[3])[0]
        for i in range(0, len(seen), 1 << 16):
            own = seen[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(table[j][own]) for j in range(4))], names)

    return sample.select("toxic", "text").mapInArrow(run, schema).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _ratios(sums: DataFrame, rows: int, positive: int, alpha: float, min_z: float, min_docs: int) -> dict[int, float]:
    """Log-count ratios of the features that the classes differ in."""
    total = sums.agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return {}
    share = positive / rows
    mass = total["p"] / max(total["p"] + total["q"], 1e-9)
    docs, value = F.col("dp") + F.col("dq"), F.col("p") + F.col("q")
    by_docs = (F.col("dp") - docs * share) / F.sqrt(docs * share * (1 - share) + 1e-9)
    by_value = (F.col("p") - value * mass) / F.sqrt(F.greatest(value, F.lit(1.0)) * share * (1 - share))
    ratio = F.log((F.col("p") + alpha) / (total["p"] + alpha * total["n"])) - F.log((F.col("q") + alpha) / (total["q"] + alpha * total["n"]))
    kept = sums.where((docs >= min_docs) & (F.greatest(F.abs(by_docs), F.abs(by_value)) > min_z))
    return {r["feature"]: r["r"] for r in kept.select("feature", ratio.alias("r")).collect()}  # at most 2**HASH_BITS


def _values(sample: DataFrame, used: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Labels, and by batch the used features of each labelled row; the number of rows has a bound and so has that of features."""
    shared = sample.sparkSession.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                row, code, count = features(*utf8_buffers(part.column(1)), shared.value)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (code, count)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), *lists], ["toxic", "codes", "counts"])

    schema = StructType(
        [StructField("toxic", IntegerType()), StructField("codes", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType()))]
    )
    table = sample.select("toxic", "text").mapInArrow(run, schema).toArrow()
    y = table.column(0).to_numpy().astype(float)
    sizes = [np.diff(c.offsets.to_numpy()) for c in table.column(1).chunks]
    codes, counts = ([c.flatten().to_numpy() for c in table.column(i).chunks] for i in (1, 2))
    return y, sizes, codes, counts


def _logistic(values: tuple, ratio: np.ndarray, rounds: int, l2: float) -> Model:
    """Full-batch AdaGrad on balanced classes; the same rows in another order give the same model up to rounding.

    Only the Arrow batches stay in memory; rows and values are made anew for a batch at a time.
    """
    y, sizes, codes, counts = values
    size, n = len(ratio), len(y)
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    value_of = np.log1p(np.arange(1 << 12))
    starts = np.cumsum([0, *map(len, sizes)])

    def parts():
        for i, (own, code, count) in enumerate(zip(sizes, codes, counts)):
            value = value_of[np.minimum(count, len(value_of) - 1)]
            if len(count) and count.max() >= len(value_of):
                value = np.log1p(count)
            yield slice(starts[i], starts[i + 1]), np.repeat(np.arange(len(own)), own), code, value * ratio[code]

    w, bias, past, past_bias = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        step, total = l2 * w / n, 0.0
        for rows, row, code, value in parts():
            z = np.bincount(row, w[code] * value, minlength=rows.stop - rows.start) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]) * each[rows]
            step += np.bincount(code, error[row] * value, minlength=size)
            total += error.sum()
        past += step * step
        w -= 0.05 * step / np.sqrt(past)
        past_bias += total**2
        bias -= 0.2 * total / np.sqrt(past_bias)
    return Model(w * ratio, float(bias))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    alpha: float = 1.0,
    min_z: float = 5.0,
    min_docs: int = 5,
    rounds: int = 100,
    l2: float = 1.0,
) -> Model:
    """Fit on the labelled rows of (doc_id, text) outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # The bound on labelled rows bounds what is broadcast: two numbers a row.
    sample = cut(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b")))
    if sample.count() > max_labelled:  # rows repeat an id
        # A key may be shared by equal rows, which give equal features; the last key's rows are cut to the bound.
        edge = sample.select("a", "b").orderBy("a", "b").limit(max_labelled).agg(F.max(F.struct("a", "b")).alias("m")).first()["m"]
        key = F.struct("a", "b")
        last = F.struct(F.lit(edge["a"]).alias("a"), F.lit(edge["b"]).alias("b"))
        below = sample.where(key < last)
        sample = cut(below.unionByName(sample.where(key == last).limit(max_labelled - below.count())))
    rows, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    none = Model(np.zeros(1 << HASH_BITS), -np.inf)
    if positive in (0, rows):
        return none
    ratios = _ratios(cut(_sums(sample)), rows, positive, alpha, min_z, min_docs)
    ratio = np.zeros(1 << HASH_BITS)
    ratio[list(ratios)] = list(ratios.values())
    return _logistic(_values(sample, ratio != 0), ratio, rounds, l2)


def predict(column: pa.Array, model: Model) -> np.ndarray:
    at, raw = utf8_buffers(column)
    row, code, count = features(at, raw, model.weights != 0)
    z = np.bincount(row, np.log1p(count) * model.weights[code], minlength=len(at) - 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))) if np.isfinite(model.bias) else np.zeros(len(z))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, keep, text, lambda column: [pa.array(predict(column, shared.value))], [StructField(name, DoubleType())], SLICE)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted."""
    docs = narrow(df, id_col, text_col)
    marks = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "toxic")
    scored = score(docs, train(docs, marks, **options), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
