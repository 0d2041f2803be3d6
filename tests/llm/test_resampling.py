"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import resampling
from quern.llm.common import utf8_buffers
from quern.llm.resampling import feature_counts, pair_crcs, pieces, resample

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target):
    raw, wanted = Counter(), Counter()
    for _, t in docs:
        raw.update(map(bucket, features(t)))
    for t in target:
        wanted.update(map(bucket, features(t)))
    s_all, t_all = sum(raw.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000))))

    out, able = [], []
    for i, t in docs:
        f = features(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        score = weight + math.floor(-1000 * math.log(-math.log(u)))
        row = [i, len(words(t)), len(f), weight, score, None]
        out.append(row)
        if len(words(t)) >= 20:
            able.append(row)
    able.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for n, row in enumerate(able[: 25 * len(able) // 100]):
        row[5] = n + 1
    return sorted(map(tuple, out), key=repr)


def result(docs, target):
    return sorted((tuple(r) for r in resample(docs, target).collect()), key=repr)


def test_documents(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = result(docs.repartition(5), target)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert sum(r[5] is not None for r in got) == sum(r[1] >= 20 for r in got) * 25 // 100


def test_odd_rows(odd, plain, empty):
    rows = [(r["doc_id"], r["text"]) for r in plain.collect()]
    assert result(odd, odd) == brute(rows, [t for _, t in rows])
    assert result(empty, odd) == [] and result(odd, empty) == brute(rows, [])


def test_ties_and_repeats(spark):
    rows = [(i % 30, "the same words in every text " * 5) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(df, df)
    assert got == brute(rows, [t for _, t in rows]) and sorted(r[5] for r in got if r[5]) == list(range(1, 31))


def test_long_text_in_pieces(spark, monkeypatch):
    text = "Ein größerer Text, a " * 4_000 + "w" * 50_000 + " " * 40_000 + "end 日本 " * 3_000
    at, raw = utf8_buffers(pa.array([text]))
    for size in (1_000, 4_096, 30_000):
        found = Counter()
        for p in pieces(raw, at, size):
            names = [w.decode() for w in p.words.to_pylist()]
            found.update(names[i] for i in p.ids[p.skip :])
            left, right, which = p.pairs()
            found.update(f"{names[left[k]]} {names[right[k]]}" for k in which)
        assert found == Counter(features(text))
    df = spark.createDataFrame([(1, text * 100), (2, "short")], "doc_id long, text string")
    assert result(df, df) == brute([(1, text * 100), (2, "short")], [text * 100, "short"])


def test_dictionary_counts_every_string_once(spark):
    df = spark.createDataFrame([("A b a b",), ("b a",), (None,), ("größe größe",)], "text string").repartition(3)
    got = {r["feature"]: r["n"] for r in feature_counts(df).collect()}
    assert got == {"a": 3, "b": 3, "a b": 2, "b a": 2, "größe": 2, "größe größe": 1}


@settings(max_examples=200)
@given(st.lists(st.tuples(st.binary(max_size=20), st.binary(max_size=70)), min_size=1, max_size=20))
def test_combined_checksums(parts):
    left, right = (np.array([zlib.crc32(x[k]) for x in parts], np.uint32) for k in (0, 1))
    size = np.array([len(b) for _, b in parts])
    assert pair_crcs(left, right, size).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_texts_do_not_run_together():
    at, raw = utf8_buffers(pa.array(["one two", "three", "", "four five", None, " six"]))
    (p,) = resampling.pieces(raw, at)
    left, right, _ = p.pairs()
    names = [w.decode() for w in p.words.to_pylist()]
    assert [names[i] for i in p.ids] == ["one", "two", "three", "four", "five", "six"]
    assert sorted((names[a], names[b]) for a, b in zip(left, right)) == [("four", "five"), ("one", "two")]
