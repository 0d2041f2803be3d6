"""Byte ranges, circular token batches and commits: golden cases and restarts."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import commits, ranges
from quern.sources.ranges import TokenStream, json_lines, line_ranges, lines_of, shard_table, stream_batches


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "rows.jsonl")
    with open(path, "w") as f:
        for i in range(200):
            f.write(json.dumps({"id": i, "text": "größe " * (i % 7)}) + "\n")
    return path


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_every_line_is_in_one_range(lines, size):
    total = os.path.getsize(lines)
    found = [json.loads(line)["id"] for a in range(0, total, size) for _, _, line in lines_of(lines, a, min(total, a + size))]
    assert found == list(range(200))


def test_ranges_as_partitions(spark, lines):
    for size in (700, 10_000):
        df = line_ranges(spark, lines, range_bytes=size)
        assert df.rdd.getNumPartitions() == -(-os.path.getsize(lines) // size)
        rows = sorted(df.collect(), key=lambda r: r["start"])
        assert [json.loads(r["line"])["id"] for r in rows] == list(range(200))
        assert [r["position"] for r in rows[:-1]] == [r["start"] for r in rows[1:]] and rows[-1]["position"] == os.path.getsize(lines)


def test_resume_from_a_position(spark, lines):
    first = sorted(json_lines(spark, "id long, text string", lines, range_bytes=512).collect(), key=lambda r: r["id"])
    at = first[79]["_position"]
    rest = json_lines(spark, "id long", lines, range_bytes=300, start={lines: at}).collect()
    assert sorted(r["id"] for r in rest) == list(range(80, 200))
    assert sorted(r["id"] for r in json_lines(spark, "id long", lines, stop={lines: at}).collect()) == list(range(80))


def test_odd_lines(spark, tmp_path):
    path = str(tmp_path / "odd.jsonl")
    with open(path, "wb") as f:
        f.write(b'{"id": 1}\n\n   \n{"id": 2, "text": "' + b"x" * 3_000_000 + b'"}\nnot json\n{"id": null}\n{"id": 4}')
    for size in (10, 1 << 20):
        found = [(b - a, line[:9]) for s in range(0, 3_000_100, size if size > 10 else 1 << 21) for a, b, line in lines_of(path, s, s + (size if size > 10 else 1 << 21))]
        assert [x[1] for x in found] == [b'{"id": 1}', b"", b"   ", b'{"id": 2,', b"not json", b'{"id": nu', b'{"id": 4}']
    got = json_lines(spark, "id long, text string", path, strict=False, range_bytes=1 << 20).collect()
    assert sorted((r["id"] or 0, len(r["text"] or "")) for r in got) == [(0, 0), (1, 0), (2, 3_000_000), (4, 0)]
    with pytest.raises(Exception, match="bad line at byte"):
        json_lines(spark, "id long, text string", path).collect()
    with pytest.raises(Exception, match="holds"):
        line_ranges(spark, path, stop={path: 1 << 40}).collect()
    empty = str(tmp_path / "empty.jsonl")
    open(empty, "w").close()
    assert line_ranges(spark, empty).count() == 0


def shards(folder, *parts):
    paths = []
    for i, tokens in enumerate(parts):
        paths.append(f"{folder}/{i}.bin")
        np.array(tokens, "<u2").tofile(paths[-1])
    return paths


def rows_of(df):
    return [(r["batch"], r["row"], r["cycle"], r["x"], r["y"]) for r in sorted(df.collect(), key=lambda r: (r["batch"], r["row"]))]


def test_golden_batches(spark, tmp_path):
    """Shards 0-4 and 5-10, four targets, two rows: shifted by one, across the shards, then across the end."""
    stream = TokenStream(spark, shards(tmp_path, range(5), range(5, 11)), 4, block=3)
    first = rows_of(stream.next(2))
    assert [r[3] for r in first] == [[0, 1, 2, 3], [4, 5, 6, 7]] and [r[4] for r in first] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    state = stream.state()
    second = rows_of(stream.next(2))
    assert [r[3] for r in second] == [[8, 9, 10, 0], [1, 2, 3, 4]] and [r[4] for r in second] == [[9, 10, 0, 1], [2, 3, 4, 5]]
    assert stream.state()["cycles"] == 1 and stream.state()["cursor"] == 5
    again = TokenStream(spark, [p for p, _ in stream.shards], 4, state, block=3)
    assert rows_of(again.next(2)) == second and again.state() == stream.state()
    with pytest.raises(ValueError):
        TokenStream(spark, [p for p, _ in stream.shards], 5, state)
    with pytest.raises(ValueError):
        TokenStream(spark, shards(tmp_path, range(6), range(5, 11)), 4, state)


@pytest.mark.parametrize("block", [1, 4, 7, 100])
def test_batches_equal_a_plain_walk(spark, tmp_path, block):
    tokens = [[7], list(range(100, 117)), [], [65535, 0, 3]]
    flat = [t for part in tokens for t in part]
    table = shard_table(shards(tmp_path, *tokens))
    for length, rows, batches, consumed in ((3, 2, 3, 0), (5, 4, 2, 18), (50, 2, 1, 40), (1, 1, 4, 20)):
        got = rows_of(stream_batches(spark, table, length, rows, batches, consumed, block))
        want = []
        for i in range(rows * batches):
            p = consumed + i * length
            walk = [flat[(p + k) % len(flat)] for k in range(length + 1)]
            want.append((i // rows, i % rows, p // len(flat), walk[:-1], walk[1:]))
        assert got == want


def test_bad_shards(spark, tmp_path):
    paths = shards(tmp_path, [1], [2, 3])
    with open(paths[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        shard_table(paths)
    with pytest.raises(ValueError):
        shard_table(shards(tmp_path, [1]))


def batch_of(spark, low, high):
    rows = spark.range(low, high).select("id", F.concat(F.lit("text "), "id").alias("text")).repartition(3)
    return {"out": rows, "state": rows.select(F.sha2("text", 256).alias("digest"))}


def tables(spark, folder):
    out = commits.committed(spark, folder, "out", "id long, text string").collect()
    state = commits.committed(spark, folder, "state", "digest string").collect()
    assert len(out) == len(state)
    return sorted((r["id"], r["batch"]) for r in out)


def test_output_state_and_progress_commit_together(spark, tmp_path):
    folder = str(tmp_path)
    assert commits.last_commit(folder) is None and tables(spark, folder) == []
    assert commits.commit_batch(spark, folder, 0, batch_of(spark, 0, 10), {"row": 10})
    # A second batch that fails in a task leaves the first one's tables and progress alone.
    broken = batch_of(spark, 10, 20)
    broken["state"] = broken["state"].where(F.when(F.length("digest") > 0, F.raise_error(F.lit("lost")).cast("boolean")))
    with pytest.raises(Exception, match="lost"):
        commits.commit_batch(spark, folder, 1, broken, {"row": 20})
    assert tables(spark, folder) == [(i, 0) for i in range(10)] and commits.last_commit(folder)["progress"] == {"row": 10}
    assert commits.commit_batch(spark, folder, 1, batch_of(spark, 10, 20), {"row": 20})
    assert not commits.commit_batch(spark, folder, 1, batch_of(spark, 10, 20), {"row": 20})
    assert tables(spark, folder) == [(i, i // 10) for i in range(20)] and commits.last_commit(folder)["progress"] == {"row": 20}


def test_a_writer_killed_before_its_commit_leaves_no_row(spark, tmp_path):
    folder = str(tmp_path)
    commits.commit_batch(spark, folder, 0, batch_of(spark, 0, 5), {})
    writer = commits.TwoPhaseWriter(folder, 1, {})
    done = writer.write(iter([("out", '{"id": 99, "text": "x"}'), ("state", '{"digest": "d"}')]))
    before = tables(spark, folder)
    assert before == [(i, 0) for i in range(5)]
    # Bytes behind the committed end of a file are not read either.
    name, path, size, _ = commits.last_commit(folder)["files"][0]
    with open(f"{folder}/{path}", "a") as f:
        f.write('{"id": 77, "te')
    assert tables(spark, folder) == before
    assert commits.recover(folder) == sorted(f[1] for f in done.files) and commits.recover(folder) == []
    assert tables(spark, folder) == before
    with open(f"{folder}/{path}", "r+") as f:
        f.truncate(size - 1)
    with pytest.raises(ValueError, match="committed bytes"):
        commits.recover(folder)


def test_two_writers_of_one_batch(spark, tmp_path):
    folder = str(tmp_path)
    one, two = (commits.TwoPhaseWriter(folder, 0, {"by": k}) for k in (1, 2))
    messages = [w.write(iter([("out", json.dumps({"id": k, "text": ""})), ("state", '{"digest": "d"}')])) for k, w in ((1, one), (2, two))]
    one.commit([messages[0], None])
    two.commit([messages[1]])
    assert tables(spark, folder) == [(1, 0)] and commits.recover(folder) == []
    assert ranges.size_of(f"{folder}/{messages[0].files[0][1]}") > 0


def test_shuffle_buffer(spark, lines):
    """The order of a plain buffer of the same seed, for each range; a rerun on other ranges of tasks agrees."""
    import random

    def plain(rows, most, seed):
        draws, held, out = random.Random(seed), [], []
        for row in rows:
            if len(held) < most:
                held.append(row)
                continue
            k = draws.randrange(most)
            out.append(held[k])
            held[k] = row
        draws.shuffle(held)
        return out + held

    got = ranges.shuffled_lines(spark, lines, most=20, seed=3).collect()
    order = [json.loads(r["line"])["id"] for r in sorted(got, key=lambda r: r["place"])]
    assert order == plain(range(200), 20, "3:0") and order != sorted(order)
    small = ranges.shuffled_lines(spark, lines, most=20, seed=3, range_bytes=2000).collect()
    starts = sorted({r["first"] for r in small})
    assert len(starts) > 2 and sorted(json.loads(r["line"])["id"] for r in small) == list(range(200))
    for first in starts:
        part = sorted((r for r in small if r["first"] == first), key=lambda r: r["place"])
        assert [r["start"] for r in part] == plain(sorted(r["start"] for r in part), 20, f"3:{first}")
    assert [r["start"] for r in ranges.shuffled_lines(spark, lines, most=1).collect()] == sorted(r["start"] for r in got)


def test_pairs_are_encoded_as_one_text(spark):
    from quern.operators import tokenizing

    rows = [("ab ", "c"), ("ab", " c"), ("größe  \n", "ist"), ("Question: why? Answer:", " because"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = tokenizing.encode_pairs(df, "a", "b").collect()
    for r in got:
        bare = r["a"].rstrip()
        rest = r["a"][len(bare) :] + (r["b"] or "")
        assert bytes(i - 4 for i in r["context_ids"]).decode() == bare and bytes(i - 4 for i in r["continuation_ids"]).decode() == rest
    with pytest.raises(Exception, match="without a context"):
        tokenizing.encode_pairs(spark.createDataFrame([("", "b")], "a string, b string"), "a", "b").collect()
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for r in tokenizing.encode_pairs(df, "a", "b", path).collect():
        bare = r["a"].rstrip()
        whole = tok.encode(r["a"] + (r["b"] or ""), add_special_tokens=False).ids
        context = tok.encode(bare, add_special_tokens=False).ids
        assert r["context_ids"] == context and r["continuation_ids"] == whole[len(context) :]


def test_examples_are_read_without_a_shuffle(spark, tmp_path):
    """Examples over small shards, more than once around, and no exchange in the plan."""
    import numpy as np

    from quern.sources import ranges

    tokens, paths = np.arange(1000, dtype="<u2"), []
    for k, (a, b) in enumerate(((0, 7), (7, 500), (500, 1000))):
        paths.append(f"{tmp_path}/{k}.bin")
        tokens[a:b].tofile(paths[-1])
    df = ranges.stream_batches(spark, ranges.shard_table(paths), 6, 3, 150, consumed=995, block=1)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r["batch"], r["row"]): (r["cycle"], r["x"], r["y"]) for r in df.collect()}
    want = {}
    for i in range(450):
        p = 995 + 6 * i
        run = [(p + j) % 1000 for j in range(7)]
        want[i // 3, i % 3] = (p // 1000, run[:-1], run[1:])
    assert got == want
