"""Spherical-cap filters against all pairs: links, components, odd vectors, hot groups, recall of the lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.caps import code, decode, embedding_components, filters, scores, unit

FIELDS = "vec_id long, embedding array<float>, label int"


def near(rng, x, cosine):
    """A vector of that cosine to x."""
    v = rng.standard_normal(len(x))
    v -= v @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * v / np.linalg.norm(v)


def clusters(seed, n, crowd, dim=32):
    rng = np.random.default_rng(seed)
    rows = [(rng.standard_normal(dim), int(rng.integers(3))) for _ in range(n)]
    for k in range(n // 10):
        x, label = rows[k]
        for c in (0.975, 0.979, 0.981, 0.985, 0.999):
            rows.append((near(rng, x, c), label))
    rows += [(near(rng, rows[0][0], rng.uniform(0.985, 1)), rows[0][1]) for _ in range(crowd)]
    rows += [(rows[1][0], rows[1][1])] * 5 + [(rows[2][0] * 3, rows[2][1]), (rows[3][0], None)]
    return [(i, np.float32(x).tolist(), y) for i, (x, y) in enumerate(rows)]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.98):
    good = [k for k, (_, v, y) in enumerate(rows) if usable(v) and y is not None]
    unit_ = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    links = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(unit_[j]) == len(unit_[k]) and unit_[j] @ unit_[k] >= least] for k in good}
    out, root = [], {}
    for k in good:
        if k in root:
            continue
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root |= dict.fromkeys(seen, min(ids) if ids else None)
    for k, (i, _, _) in enumerate(rows):
        c = root.get(k, i)
        out.append((i, len(links.get(k, [])), c, i == c))
    return sorted(out, key=repr)


def result(df, **more):
    return sorted((tuple(r) for r in embedding_components(df, **more).collect()), key=repr)


@pytest.mark.parametrize("block", [2048, 32])
def test_links_and_components(spark, block):
    """With small blocks a crowd is compared in pairs of blocks."""
    rows = clusters(1, 300, 150)
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    assert result(df, load=8, block=block) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0], 1), (2, [2.0, 4.0, 6.0], 1), (2, [1.0, 2.0, 3.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1),
        (7, [nan, 1.0, 1.0], 1), (8, [inf, 1.0, 1.0], 1), (9, [1.0, 2.0, 3.0], None), (10, [1.0, 2.0, 3.0], 2), (11, [1.0, 2.0], 1), (None, [1.0, 2.0, 3.01], 1),
        (None, [-5.0, 1.0, 0.0], 1), (12, [1e-30, 2e-30, 3e-30], 1), (13, [1e30, 2e30, 3e30], 1), (14, [0.0, 1.0, 0.0], 3), (15, [-0.0, 1.0, -0.0], 3), (16, [7.0], 4), (17, [5.0], 4), (18, [-5.0], 4),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    want = brute(rows)
    extra = df.select("*", *(F.lit("clash").alias(c) for c in ("node", "links", "root", "digest", "raw", "dim", "weight", "filter", "kept", "filters", "count", "first")))
    assert result(extra) == [(*r[:3], True if r[0] is None and r[2] is None else r[3]) for r in want]
    assert result(df.limit(0)) == []
    assert result(df.where("label is null"), load=1) == [(9, 0, 9, True)]


def test_doubles_and_labels_of_any_type(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16)
    rows = [(i, near(rng, x, 0.999).tolist(), "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert result(df) == brute(rows)


def test_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert result(df) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


@pytest.mark.parametrize("dim,size", [(1, 4), (3, 5), (64, 42), (64, 200)])
def test_lists_hold_all_exceeding_directions(dim, size):
    x = unit(np.random.default_rng(5).standard_normal((20, dim)))
    turn, words = code(dim, size, 2, 42)
    whole = [np.concatenate(w) for w in np.array(np.meshgrid(*(range(len(w)) for w in words), indexing="ij")).reshape(len(words), -1).T[:, :, None].tolist()]
    directions = np.array([np.concatenate([w[i] for w, i in zip(words, k)]) for k in whole])
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    sums = (x @ turn) @ directions.T
    row, found = decode(scores(x, size, 2, 42), np.full(len(x), 0.25))
    assert sorted(zip(row, found)) == sorted(zip(*np.nonzero(sums >= 0.25)))


def test_recall_of_pairs_at_the_threshold():
    """Two vectors at a cosine of 0.98 exactly share a filter, at sizes of code for thousands and for millions."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    y = np.array([near(rng, v, 0.98) for v in x])
    for size in (42, 180, 1000):
        a, b = (filters(unit(v), size, 2, 42, 20, 6) for v in (x, y))
        assert np.mean([bool(np.intersect1d(p, q).size) for p, q in zip(a, b)]) > 0.998
        assert 10 < np.mean([len(p) for p in a]) < 40
