"""Streaming deduplication with keyed state against a walk in plain Python, restarts included."""

import random

import pytest

from quern.operators import dedup
from quern.streaming.keyed import keyed_dedup

SCHEMA = "doc_id long, text string, url string"


def walked(batches, sketch):
    """Ids that stay: digests and URLs of all rows count, sketches of those that stay."""
    digests, urls, kept, out = set(), set(), [], []
    for batch in batches:
        for i, text, url in sorted(batch):
            normal, u = " ".join((text or "").lower().split()), (url or "").removeprefix("https://")
            near = any(sum(a == b for a, b in zip(sketch[i], s)) >= 28 for s in kept)
            again = normal in digests or (u and u in urls)
            digests.add(normal)
            if u:
                urls.add(u)
            if not again and not near:
                kept.append(sketch[i])
                out.append(i)
    return out


def rows(seed, n):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(150)) for _ in range(6)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 40])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        text = rng.choice([" ".join(words)] * 8 + [" ".join(words).upper(), None, "short text"])
        out.append((i, text, rng.choice([None, "", f"https://h/{rng.randrange(n)}"])))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def stopped(spark, tmp_path_factory):
    """Four batches; the second start finds two of them, after a stop between state and output of the first."""
    folder = str(tmp_path_factory.mktemp("keyed"))
    all_rows = rows(4, 60)
    batches = [all_rows[k::4] for k in range(4)]
    df = spark.createDataFrame(all_rows, SCHEMA)
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k in (1, 3):
            keyed_dedup(spark, f"{folder}/in", df.schema, f"{folder}/run", files=1, groups=5)
    return folder, df, batches


def test_equal_to_a_walk(spark, stopped):
    folder, df, batches = stopped
    sketch = {r["doc_id"]: r["sketch"] for r in dedup.sketches(df, "doc_id").collect()}
    got = spark.read.schema(df.schema).parquet(f"{folder}/run/out/batch=*").collect()
    want = walked(batches, sketch)
    assert sorted(r["doc_id"] for r in got) == sorted(want) and 1 < len(want) < 40
    texts = {i: (t, u) for batch in batches for i, t, u in batch}
    assert all((r["text"], r["url"]) == texts[r["doc_id"]] for r in got)


def test_another_start_finds_nothing_new(spark, stopped):
    folder, df, _ = stopped
    before = spark.read.schema(df.schema).parquet(f"{folder}/run/out/batch=*").count()
    keyed_dedup(spark, f"{folder}/in", df.schema, f"{folder}/run", files=1, groups=5)
    assert spark.read.schema(df.schema).parquet(f"{folder}/run/out/batch=*").count() == before


def test_texts_stay_in_their_files_and_new_keys_are_not_looked_up(spark, tmp_path, monkeypatch):
    """Folders with signs of globs; the keys that ask are narrow: no text, at most two keys and five bands a row."""
    from quern.streaming import keyed

    seen, made = [], keyed._rows
    monkeypatch.setattr(keyed, "_rows", lambda keys, stored, groups: seen.append(keys) or made(keys, stored, groups))
    folder = str(tmp_path / "in [a] {b} %20")
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text, "https://h/1"), (2, text.replace("w7 ", "x "), None), (3, None, None)], SCHEMA)
    df.coalesce(1).write.parquet(folder)
    payload = keyed._asked(spark.read.schema(df.schema).parquet(folder.replace("[", "\\[").replace("{", "\\{")), "doc_id", "text", "url").select("k.*").collect()
    assert not any("w299" in str(r) for r in payload) and max(sum(r["pos"] == i for r in payload) for i in (1, 2, 3)) == 7
    path = str(tmp_path / "run")
    keyed_dedup(spark, folder.replace("[", "\\[").replace("{", "\\{"), df.schema, path)
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(f"{path}/out/batch=*").collect()) == sorted(tuple(r) for r in df.where("doc_id <> 2").collect())
    assert len(seen) == 2


def test_a_filter_misses_no_key():
    import numpy as np

    from quern.streaming import keyed

    rng = np.random.default_rng(1)
    marks = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    places = keyed._places(marks)
    assert all(((0 <= p) & (p < keyed.FILTER_BITS)).all() for p in places) and len(np.unique(places[0] * keyed.FILTER_BITS + places[1])) == 5000


def test_a_full_filter_changes_nothing(spark, tmp_path):
    all_rows = rows(1, 40)
    df = spark.createDataFrame(all_rows, SCHEMA)
    for k in range(3):
        spark.createDataFrame(all_rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    keyed_dedup(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/run", files=1, groups=3, size=8)
    got = sorted(r["doc_id"] for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/run/out/batch=*").collect())
    sketch = {r["doc_id"]: r["sketch"] for r in dedup.sketches(df, "doc_id").collect()}
    assert got == sorted(walked([all_rows[k::3] for k in range(3)], sketch))
