"""The manifest against a plain-Python tree, on tables and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm.merkle import manifest, trees, verified

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    sides = []
    for nodes in tree[:-1]:
        first = at // 8 * 8
        sides.append((nodes[first:at], nodes[at + 1 : first + 8]))
        at //= 8
    return sides


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["0" if r["lang"] is None else "1" + r["lang"]].append(r)
    keys = sorted(groups, key=str.encode)
    trees_ = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees_[k] = levels([leaf(r, r["text"]) for r in groups[k]])
    top = levels([trees_[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            sides = path(trees_[k], i) + path(top, n)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            node = leaf(r, r["text"].translate(LOWER) if bad else r["text"])
            for left, right in sides:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in sides for x in left + right))
            out.append((r["doc_id"], leaf(r, r["text"]), trees_[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in verified(manifest(df)).collect()), key=repr)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = result(docs)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(odd, plain, empty):
    assert result(odd) == brute([r.asDict() for r in plain.collect()])
    assert result(empty) == []


def test_many_groups_and_changed_bytes(spark):
    rows = [(i, f"Text {i}", f"l{i % 70}" if i % 5 else None, "s", 6) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(df) == brute([r.asDict() for r in df.collect()])
    one = df.withColumn("n_chars", F.when(F.col("doc_id") == 17, 7).otherwise(F.col("n_chars")))
    assert result(df)[0][3] != result(one)[0][3]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73, 600])
def test_trees_of_every_depth(spark, n):
    """Blocks of two levels, so that a few hundred nodes take several rounds."""
    nodes = [h(str(i)) for i in range(n)]
    tree = levels(nodes)
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(nodes)], "key string, rank long, node string")
    got = sorted(trees(df, levels=2).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(n)) and {r["root"] for r in got} == {tree[-1][0]}
    for r in got:
        assert [(s["left"], s["right"]) for s in r["path"]] == [("".join(a), "".join(b)) for a, b in path(tree, r["rank"])]


@settings(max_examples=50)
@given(st.lists(st.binary(max_size=4), min_size=1, max_size=80))
def test_plain_folds(leaves):
    nodes = [hashlib.sha256(x).hexdigest() for x in leaves]
    tree = levels(nodes)
    for i, node in enumerate(nodes):
        for left, right in path(tree, i):
            node = h(*left, node, *right)
        assert node == tree[-1][0]
