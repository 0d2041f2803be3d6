"""Window classifiers, routing, injected scorers and soups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import Words, murmurs, slices
from quern.functions.text import words_and_marks
from quern.runtime import ship, spread


def routed(df: DataFrame, pool: list[str], score: Column, threshold: float) -> DataFrame:
    """Pool documents at the threshold or above go to the targeted bucket; others have no score."""
    pooled = F.col("source").isin(pool)
    return df.withColumn("score", F.when(pooled, score)).withColumn("bucket", F.when(pooled & (F.col("score") >= threshold), "targeted").otherwise(F.col("source")))


def train_windows(labelled: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """(text, label): logistic regression over hashed one- and two-word grams."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="w1", pattern=" ", toLowercase=False),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        HashingTF(numFeatures=features, inputCol="w1", outputCol="f1"),
        HashingTF(numFeatures=features, inputCol="w2", outputCol="f2"),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


#: Words of so many windows are looked up at a time, however long a text is.
_WINDOWS = 1024


def _window_scores(found: Words, first: np.ndarray, n: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of each window of n words from ``first`` on; windows ascend."""
    half = len(weights) // 2
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    window = np.repeat(np.arange(len(n)), n)
    inner = np.ones(len(place), bool)
    inner[np.cumsum(n) - 1] = False
    paired = place[inner]
    low, high = found.start[place[0]], found.end[place[-1]]
    raw = found.raw[low:high]
    total = np.bincount(window, weights[murmurs(raw, found.start[place] - low, found.end[place] - low) % half], len(n))
    # Two words that follow each other stand one blank apart, as in the gram.
    total += np.bincount(window[inner], weights[half + murmurs(raw, found.start[paired] - low, found.end[paired + 1] - low) % half], len(n))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(total + bias)))


def _window_means(texts: pa.Array, weights: np.ndarray, bias: float, size: int, limit: int | None) -> np.ndarray:
    """The mean probability over the windows of each text of words parted by blanks: all of them, or with a limit those of ``word_windows``."""
    found = Words(texts)
    means, windows, owners = np.zeros(len(texts)), [], []
    words = np.bincount(found.owner, minlength=len(texts))
    for row, (first, n) in enumerate(zip(np.cumsum(words) - words, words)):
        all_windows = -(-n // size)
        most = limit or max(1, all_windows)
        at = np.floor(np.arange(min(all_windows, most)) * max(1.0, all_windows / most)).astype(np.int64) * size
        windows.append(np.c_[first + at, np.minimum(size, n - at)])
        owners.append(np.full(len(at), row))
    (first, n), owner = np.concatenate(windows).T, np.concatenate(owners)
    if not len(first):
        return means
    scores = np.concatenate([_window_scores(found, first[i : i + _WINDOWS], n[i : i + _WINDOWS], weights, bias) for i in range(0, len(first), _WINDOWS)])
    counts = np.bincount(owner, minlength=len(texts))
    return np.divide(np.bincount(owner, scores, len(texts)), counts, out=means, where=counts > 0)


def document_scores(model: PipelineModel, docs: DataFrame, id_col: str, size: int = 60, limit: int | None = 64) -> DataFrame:
    """The mean positive probability over a document's windows, all of them if ``limit`` is None; 0 for a document without words.

    A row's windows are scored where its text is read, by array arithmetic over slices of a column, without a row each.
    """
    ship(docs.sparkSession)
    weights, bias = model.stages[-1].coefficients.toArray(), float(model.stages[-1].intercept)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        done = [_window_means(part.column(0), weights, bias, size, limit) for part in slices(batch, 0, 1 << 18)]
        return pa.array(np.concatenate(done) if done else np.zeros(0))

    return spread(docs.select(id_col, "text")).select(id_col, score(words_and_marks(F.col("text"))).alias("score"))


def vowel_share(texts: list[str]) -> list[float]:
    """A deterministic stand-in for a model."""
    return [sum(c in "aeiou" for c in t.lower()) / max(1, len(t)) for t in texts]


def scored_by(df: DataFrame, text_col: str, scorer: Callable[[list[str]], list[float]], keys: str) -> DataFrame:
    """Rows through an injected scorer in batches, longest first; the order does not change the scores."""
    ship(df.sparkSession)
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].assign(score=scorer(batch[text_col].fillna("").tolist()))

    return df.sortWithinPartitions(F.length(text_col).desc()).mapInPandas(run, f"{keys}, score double")


def document_nll(docs: DataFrame, id_col: str, tokens: Column, loss: Callable[[list[int], int], float], context: int, stride: int) -> DataFrame:
    """(id, nll_sum, token_count): an injected loss over overlapping windows that scores every target once.

    ``loss(window, first)`` gives the summed loss of the targets window[first:], each seen with what precedes it.
    """
    from quern.operators.windows import score_plan

    ship(docs.sparkSession)
    planned = docs.select(id_col, tokens.alias("__t")).select(id_col, "__t", F.explode_outer(score_plan(F.size("__t"), context, stride)).alias("w"))
    windows = planned.select(
        id_col,
        F.when(F.col("w").isNotNull(), F.slice("__t", F.col("w.start").cast("int") + 1, (F.col("w.end") - F.col("w.start")).cast("int"))).alias("ids"),
        (F.col("w.first_target") - F.col("w.start")).cast("int").alias("first"),
    )

    @F.pandas_udf("double")
    def losses(ids: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None else float(loss([int(i) for i in x], int(k))) for x, k in zip(ids, first)], ids.index)

    scored = windows.withColumn("nll", losses("ids", "first"))
    count = F.coalesce(F.size("ids") - F.col("first"), F.lit(0))
    return scored.groupBy(id_col).agg(F.sum("nll").alias("nll_sum"), F.sum(F.when(F.col("ids").isNotNull(), count).otherwise(0)).alias("token_count"))


def unigram_loss(window: list[int], first: int) -> float:
    """A deterministic stand-in for a model: a token's loss grows with its id."""
    return sum((t % 97) / 97 for t in window[first:])


def greedy_soup(ranked: DataFrame, goal: float, tolerance: float = 1e-12, most: int = 100_000) -> DataFrame:
    """(run, accepted) of ranked candidates: each joins while the trial's score does not fall.

    A driver loop, as every trial needs a score of its own; more candidates than ``most`` are an error.
    """
    rows = ranked.select("run", "proxy").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates")
    total, members, best, out = 0.0, 0, float("-inf"), []
    for r in rows:
        trial = total + r["proxy"]
        value = -abs(trial / (members + 1) - goal)
        accepted = value >= best - tolerance
        if accepted:
            total, members, best = trial, members + 1, value
        out.append((r["run"], accepted))
    return ranked.sparkSession.createDataFrame(out, "run string, accepted boolean")
