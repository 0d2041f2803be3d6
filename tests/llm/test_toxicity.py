import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import queries
from quern.llm.toxicity import SIZES, features, toxicity, train


def test_features_against_brute_force():
    texts = [b"Abc idiot", b"", b"zz", "ünï".encode()]
    at = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    row, _, count = features(at, raw)
    for i, t in enumerate(texts):
        framed = b" " + t.lower() + b" "
        grams = [framed[j : j + n] for n in SIZES for j in range(len(framed) - n + 1)]
        assert count[row == i].sum() == len(grams)
        assert len(count[row == i]) == len(set(grams))


def brute_features(text):
    """{feature: count}, byte by byte."""
    framed = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + b" "
    found: dict = {}
    for k in SIZES:
        for j in range(len(framed) - k + 1):
            rolling = 0
            for c in framed[j : j + k]:
                rolling = (rolling * 1000003 + c) % 2**64
            code = ((rolling + k) * 0x9E3779B97F4A7C15 % 2**64) >> 46
            found[code] = found.get(code, 0) + 1
    return found


def brute_scores(rows, labelled, rounds=100):
    """Scores of rows by ratios over dictionaries and a dense gradient descent; ``labelled`` is [(text, toxic)]."""
    feats = [brute_features(t) for t, _ in labelled]
    y = np.array([t for _, t in labelled], float)
    p, q, dp, dq = {}, {}, {}, {}
    for f, label in zip(feats, y):
        sums, docs = (p, dp) if label else (q, dq)
        for c, n in f.items():
            sums[c] = sums.get(c, 0) + math.log1p(n)
            docs[c] = docs.get(c, 0) + 1
    every = sorted({*p, *q})
    total_p, total_q, share = sum(p.values()), sum(q.values()), y.mean()
    mass = total_p / (total_p + total_q)
    ratio = {}
    for c in every:
        a, b, n = p.get(c, 0), q.get(c, 0), dp.get(c, 0) + dq.get(c, 0)
        by_docs = (dp.get(c, 0) - n * share) / math.sqrt(n * share * (1 - share) + 1e-9)
        by_value = (a - (a + b) * mass) / math.sqrt(max(a + b, 1.0) * share * (1 - share))
        if n >= 5 and max(abs(by_docs), abs(by_value)) > 5:
            ratio[c] = math.log((a + 1) / (total_p + len(every))) - math.log((b + 1) / (total_q + len(every)))
    order = {c: i for i, c in enumerate(ratio)}

    def vector(f):
        x = np.zeros(len(order))
        for c, n in f.items():
            if c in order:
                x[order[c]] = math.log1p(n) * ratio[c]
        return x

    x = np.array([vector(f) for f in feats])
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, bias, past, past_bias = np.zeros(len(order)), 0.0, np.full(len(order), 1e-8), 1e-8
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - y) * each
        step = x.T @ error + w / len(y)
        past += step**2
        w -= 0.05 * step / np.sqrt(past)
        past_bias += error.sum() ** 2
        bias -= 0.2 * error.sum() / np.sqrt(past_bias)
    return [1 / (1 + math.exp(-(vector(brute_features(t)) @ w + bias))) for t in rows]


def test_scores_against_brute_force(spark):
    docs, labels = _labelled(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    known = [(texts[i], marks[i]) for i in sorted(texts) if zlib.crc32(str(i).encode()) % 5]
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    want = dict(zip(texts, brute_scores(texts.values(), known)))
    assert len(got) == 300 and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_long_texts_are_counted_in_parts(monkeypatch):
    from quern.llm import toxicity as module

    text = bytes(range(60, 100)) * 50 + "ünï 漢字".encode()
    at, raw = np.array([0, len(text)]), np.frombuffer(text, np.uint8)
    whole = features(at, raw)
    for part in (9, 64, len(text) - 1):
        monkeypatch.setattr(module, "PART", part)
        assert all(np.array_equal(a, b) for a, b in zip(features(at, raw), whole))
    assert dict(zip(whole[1].tolist(), whole[2].tolist())) == brute_features(text.decode())


def test_rows_that_repeat_an_id_stay_in_the_bound(spark):
    docs, labels = _labelled(spark)
    many = docs.unionByName(docs).unionByName(docs)
    model = train(many, labels, max_labelled=100)
    assert (model.weights == train(many.repartition(7), labels, max_labelled=100).weights).mean() > 0.99
    assert model.weights.any()


def _labelled(spark):
    rows = [(i, ("you are a worthless idiot " if i % 3 == 0 else "a calm and friendly word ") + f"number {i}", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_folds(spark):
    docs, labels = _labelled(spark)
    rows = toxicity(docs, labels).collect()
    assert len(rows) == 300
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["doc_id"] % 3 == 0)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = _labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (train(docs, labels).weights == train(docs, flipped).weights).all()


def test_real_labels(spark):
    import os

    import pytest

    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    scored = queries.op2_toxicity(spark, base).where("held_out").join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id")
    rows = scored.select("predicted", "toxic").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.93


def test_odd_rows(spark, odd, empty):
    docs, labels = _labelled(spark)
    scored = toxicity(odd, labels)
    assert scored.count() == odd.count()
    assert toxicity(empty, labels).count() == 0
    nothing = labels.limit(0)
    assert {r["score"] for r in toxicity(odd, nothing).collect()} == {0.0}
    unknown = spark.createDataFrame([(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity(odd, unknown).collect()} == {0.0}
