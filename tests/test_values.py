"""Queries without a SQL twin against plain Python over the same rows."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.operators import decisions, dedup, learning, windows
from quern.plans.registry import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values, seed=42):
    """XXH64 of a row: each value is hashed with the hash of those before it as seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def uniform(key, seed):
    return (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def test_shuffled_order(spark, sf, docs):
    got = [r["doc_id"] for r in QUERIES["shuffled_order"](spark, sf).collect()]
    assert got == sorted(docs, key=lambda i: (spark_hash("order", i), i)) != sorted(docs)


def test_length_batches(spark, sf, docs):
    """Whole partitions, each longest first, ids in order among equals."""
    parts = QUERIES["length_batches"](spark, sf).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r["doc_id"] for r in parts) == sorted(docs)
    for p in {r["p"] for r in parts}:
        own = [(-r["n_chars"], r["doc_id"]) for r in parts if r["p"] == p]
        assert own == sorted(own) and all(docs[i]["n_chars"] == -n for n, i in own)


def test_matched_negatives(spark, sf, docs):
    bench = sorted((r["item_id"], len(r["text"].split())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    lengths = [max(8, n) for _, n in bench]
    got = {r["doc_id"]: r for r in QUERIES["matched_negatives"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        words = r["text"].split()
        length = lengths[math.floor(uniform(i, "negatives") * len(lengths))]
        start = math.floor(uniform(f"{i}/start", "negatives") * max(1, len(words) - length))
        assert (got[i]["length"], got[i]["start"], got[i]["passage"]) == (length, start, " ".join(words[start : start + length]))


def test_encoded_documents(spark, sf, docs):
    got = {r["doc_id"]: (r["n"], r["last"]) for r in QUERIES["encoded_documents"](spark, sf).collect()}
    assert got == {i: (len(r["text"].encode()) + 1, 2) for i, r in docs.items()}


def test_table_digest(spark, sf, docs):
    row = QUERIES["table_digest"](spark, sf).first()
    assert row["n"] == len(docs) and int(row["digest"]) == sum(spark_hash(i, r["text"]) for i, r in docs.items())


def test_model_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = {(r["conv_id"], r["turn"]): r["score"] for r in QUERIES["model_scores"](spark, sf).collect()}
    assert got == {(r["conv_id"], r["turn"]): sum(c in "aeiou" for c in r["text"].lower()) / max(1, len(r["text"])) for r in rows}


def test_classifier_score(spark, sf, docs):
    """Windows cut in plain Python and the logistic function by numpy give the document scores."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    cut = re.compile(r"[^\W]+|[^\w\s]")
    words = {i: cut.findall(r["text"].lower()) for i, r in docs.items()}
    labelled = spark.createDataFrame([(i, " ".join(words[i]), float(y)) for i, y in labels.items() if y is not None and i in words], "i long, text string, label double")
    model = learning.train_windows(labelled.select("text", "label"))
    rows = []
    for i, w in words.items():
        n = math.ceil(len(w) / 60)
        at = [math.floor(k * (n / 64 if n > 64 else 1.0)) for k in range(min(n, 64))]
        rows += [(i, " ".join(w[60 * k : 60 * k + 60])) for k in at]
    frame = spark.createDataFrame(rows, "i long, text string")
    for stage in model.stages[:-1]:
        frame = stage.transform(frame)
    weights, bias = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    scores: dict = {}
    for r in frame.select("i", "features").collect():
        z = float(weights[r["features"].indices] @ r["features"].values) + bias
        scores.setdefault(r["i"], []).append(1 / (1 + math.exp(-z)))
    got = {r["doc_id"]: r["score"] for r in learning.document_scores(model, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()}
    assert set(got) == set(docs) and all(abs(got[i] - np.mean(scores[i])) < 1e-9 for i in scores)
    assert set(QUERIES["classifier_score"](spark, sf).columns) == {"doc_id", "score"}


def first_wins(batches, state, near=28):
    """Rows (id, digest, url, sketch) that repeat nothing before them, batch by batch in order of id."""
    kept = []
    for batch in batches:
        digests, urls = {s[1] for s in state}, {s[2] for s in state if s[2]}
        open_rows = []
        for row in sorted(batch):
            # Digests and URLs are compared with all earlier rows of the batch, whether these stay or not.
            if row[1] not in digests and not (row[2] and row[2] in urls):
                open_rows.append(row)
            digests.add(row[1])
            urls |= {row[2]} if row[2] else set()
        for row in open_rows:
            if not any(sum(a == b for a, b in zip(row[3], s[3])) >= near for s in state):
                state.append(row)
                kept.append(row[0])
    return kept


def sketched(spark, sf):
    return {r["doc_id"]: tuple(r["sketch"]) for r in dedup.sketches(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()}


def test_stream_near_dedup(spark, sf, docs):
    sketches = sketched(spark, sf)

    def row(i):
        r = docs[i]
        normal = " ".join(r["text"].lower().replace("ß", "ss").split())
        return i, normal, f"https://{r['source']}/{i // 400}" if i % 5 == 0 else "", sketches[i]

    want = first_wins([[row(i) for i in docs if i % 3 == third] for third in range(3)], [])
    got = [r["doc_id"] for r in QUERIES["stream_near_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(docs)


def test_a_stream_batch_that_runs_twice_counts_once(spark, tmp_path):
    from quern.streaming.incremental import deduplicated

    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join([*base[:199], "x"]), " ".join(reversed(base)), " ".join(base), "another text that is short", "and one more"]
    rows = spark.createDataFrame([(i, t, f"http://h/{i}" if i != 5 else "https://www.h/4") for i, t in enumerate(texts)], "doc_id long, text string, url string")
    write = deduplicated(str(tmp_path))
    for number, low in ((0, 0), (1, 2), (1, 2), (2, 4)):
        write(rows.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + 2)), number)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4]


def test_near_prior_kept(spark, sf, docs):
    sketches = sketched(spark, sf)
    got = {r["doc_id"]: r["near"] for r in QUERIES["near_prior_kept"](spark, sf).collect()}
    state = [(i, None, None, sketches[i]) for i in docs if i % 2 == 0]
    kept = first_wins([[(i, i, "", sketches[i]) for i in docs if i % 2]], state)
    assert {i for i, near in got.items() if not near} == set(kept) and set(got) == {i for i in docs if i % 2}


def test_decay_plans(spark):
    import random

    rng = random.Random(3)
    rows = []
    for run in range(30):
        step = 0
        for _ in range(12):
            step += rng.randint(1, 30)
            rows.append((run, step, step + rng.randint(-10, 60), rng.randint(0, 4)))
            if rng.random() < 0.3:
                rows.append((run, step + 1, *rows[-1][2:]))
                step += 1
    want = {}
    for run in range(30):
        kept = (None, None)
        for _, step, start, steps in sorted(r for r in rows if r[0] == run):
            fault = None
            if (start, steps) != kept:
                if kept[0] is not None and step > kept[0]:
                    fault = "already_decaying"
                elif start < step:
                    fault = "starts_in_the_past"
                elif steps < 1:
                    fault = "no_steps"
                else:
                    kept = (start, steps)
            want[run, step] = fault
    df = spark.createDataFrame(rows, "run long, step long, start long, steps long")
    assert {(r["run"], r["step"]): r["fault"] for r in decisions.decay_plans(df, ["run"], "step").collect()} == want
    assert len(set(want.values())) == 4


def test_stream_state_is_held_to_its_shards():
    shards = [("a", 100), ("b", 50)]
    state = windows.stream_state(shards, 420)
    assert (state["cycles"], state["cursor"]) == (2, 120) and windows.resumed(state, shards) == 420
    for bad, own in ((state, [("a", 100), ("b", 51)]), ({**state, "cursor": 119}, shards), ({**state, "cursor": 150, "cycles": 2, "consumed": 450}, shards)):
        with pytest.raises(ValueError):
            windows.resumed(bad, own)


def test_errors_that_must_fire(spark):
    from quern.sources import readers

    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 5), ("b", 1, 100)], "source string, id long, n long")
    with pytest.raises(ValueError, match="duplicate identity"):
        readers.unique_rows(df, "source", "id")
    assert readers.unique_rows(df, "source", "n").count() == 3
    with pytest.raises(ValueError, match="holds 15 of 20"):
        windows.head_by(df, "n", ["source"], ["n"], 20)
    assert [r["n"] for r in windows.head_by(df, "n", ["source"], ["n"], 6).orderBy("n").collect()] == [5, 10, 100]


def test_gate_and_soups(spark):
    from pyspark.errors import PySparkException

    members = spark.createDataFrame([("s", "a"), ("s", "b")], "soup string, run string")
    recipes = spark.createDataFrame([("a", "c1", "x", 1), ("b", "c1", "x", 3), ("c", "c2", "y", 2)], "run string, config string, arm string, epoch int")
    chosen = spark.createDataFrame([("s",), ("c",)], "run string")
    got = sorted(tuple(r) for r in decisions.expanded(chosen, members, recipes).collect())
    assert got == [("c", "c2", "y", 2), ("s", "c1", "x", 1), ("s", "c1", "x", 3)]
    with pytest.raises(PySparkException):
        decisions.expanded(spark.createDataFrame([("z",)], "run string"), members, recipes).collect()
    rows = spark.createDataFrame([("a", "selection", False, "h"), ("b", "selection", None, "h"), ("c", None, False, "h"), ("d", "selection", False, "h")], "run string, panel string, official_used boolean, hash string")
    weights = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "i")], "run string, hash string")
    assert {r["run"]: r["status"] for r in decisions.gate(rows, weights).collect()} == {"a": "accepted", "b": "official_scores_used", "c": "other_panel", "d": "weights_changed"}


def test_hashed_contaminated_docs(spark, sf, docs):
    import unicodedata
    import zlib

    def grams(text):
        w = re.findall(r"\w+", " ".join(unicodedata.normalize("NFKC", text).casefold().split()))
        return [tuple(zlib.crc32(x.encode()) for x in w[i : i + 13]) for i in range(len(w) - 12)]

    index = {g for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for g in grams(r["text"])}
    want = {i: n for i, r in docs.items() if (n := sum(g in index for g in grams(r["text"])))}
    assert {r["doc_id"]: r["hits"] for r in QUERIES["hashed_contaminated_docs"](spark, sf).collect()} == want and want


def test_paragraphs_are_packed_in_one_pass(spark):
    import time

    from quern.functions.text import packed_paragraphs, paragraph_chunks

    assert packed_paragraphs("aa\n\n bb \n \t\ncc\n\n\n\ndddddddd", 6) == ["aa\n\nbb", "cc", "dddddddd"]
    assert packed_paragraphs(" \n\n ", 5) == [] and packed_paragraphs(None, 5) is None
    began = time.time()
    assert len(packed_paragraphs("a paragraph\n\n" * 200_000, 1000)) > 2000
    assert time.time() - began < 5
    row = spark.createDataFrame([("a\n\nb",), (None,)], "t string").select(paragraph_chunks(F.col("t"), 1).alias("c")).collect()
    assert [r["c"] for r in row] == [["a", "b"], None]


def test_waiting_and_restarting(spark, tmp_path):
    from quern.sources import sinks
    from quern.streaming import incremental

    with pytest.raises(TimeoutError):
        incremental.wait_for(spark, f"{tmp_path}/*.json", 1, 0.2, 0.05)
    (tmp_path / "a.json").write_text("{}")
    assert len(incremental.wait_for(spark, f"{tmp_path}/*.json", 1, 0.2)) == 1
    place = str(tmp_path / "run")
    assert incremental.restart(spark, place) == "new"
    spark.range(3).write.parquet(f"{place}/index")
    assert incremental.restart(spark, place) == "resumed" and incremental.restart(spark, place, "discard") == "discarded"
    assert incremental.restart(spark, place) == "new"
    sinks.publish_manifest(spark, {"index": spark.range(3)}, place)
    assert incremental.restart(spark, place, "discard") == "complete"


def test_articles_of_one_stream(spark):
    from quern.sources import readers

    lines = [(i, f" = Title {i} = " if i % 7 == 0 else f"line {i}" if i % 5 else " ") for i in range(200)]
    got = readers.article_fold(spark.createDataFrame(lines, "i long, t string").repartition(6), "i", "t").collect()
    want, now = [], []
    for i, t in lines:
        if t.strip():
            if i % 7 == 0 and now:
                want.append(now)
                now = []
            now.append(t)
    assert sorted(r["text"] for r in got) == sorted("\n".join(a) for a in [*want, now])


def test_milestones_are_met_exactly(spark):
    """Ten tenths are one, which a sum of doubles misses; rows of equal order come by value."""
    from quern.operators import decisions

    rows = spark.createDataFrame([("a", i, 0.1) for i in range(20)] + [("b", 0, 3.0), ("b", 0, 0.5), ("b", 1, 0.25)], "u string, k long, v double")
    got = sorted((r["u"], r["k"], r["v"], r["milestone"]) for r in decisions.first_crossing(rows, ["u"], "k", "v", [1, 2]).collect())
    assert got == [("a", 9, 0.1, 1), ("a", 19, 0.1, 2), ("b", 0, 3.0, 2)]


def test_exact_hashes_and_normalisation_hold_few_texts(spark, monkeypatch):
    """Hits are counted in the scan, not from a row for each hash; a batch is normalised 16 texts at a time."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from quern.functions import text
    from quern.operators import exclusion

    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(20))), (2, "other words"), (3, None), (1, " ".join(f"w{i}" for i in range(13)))], "doc_id long, text string")
    found = exclusion.hashed_contaminated(docs, "doc_id", bench, "item_id")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 3)]

    texts = [None if i % 7 == 0 else f"  ＡßC{i}\n x" for i in range(100)]
    sizes, plain = [], pa.array
    monkeypatch.setattr(pa, "array", lambda x, *a, **b: sizes.append(len(x)) or plain(x, *a, **b))
    got = text.normalize_exact.func(plain(texts)).to_pylist()
    assert got == [None if t is None else f"assc{i} x" for i, t in enumerate(texts)] and max(sizes) == 16
    assert spark.range(3).select(text.normalize_exact(F.lit("Ａ")).alias("t")).distinct().collect()[0]["t"] == "a"


def test_small_ranges_share_a_job(spark, tmp_path):
    """100 ranges of a small file are one job and one entry of the ledger."""
    from quern.plans import ranged

    (tmp_path / "a.json").write_text("".join(f'{{"id": "{i}", "text": "some text"}}\n' for i in range(200)))
    size = (tmp_path / "a.json").stat().st_size
    made = ranged.build_parts(spark, {"s": [f"{tmp_path}/a.json"]}, f"{tmp_path}/out", "id string, url string, title string, text string", ranged.reused_rows(), size // 99)
    assert len(made) > 64 and len(list((tmp_path / "out" / "ledger").glob("*.json"))) == 1
    assert ranged.built(spark, f"{tmp_path}/out").count() == 200


def test_streams_of_thirds_are_dealt_over_files(spark, sf):
    """A third is a batch, but no single task writes or reads it; tasks without rows leave empty files, so batches stay thirds."""
    from quern.plans.events import _landed
    from quern.runtime import shared_folder
    from quern.sources.readers import listed

    streams = f"{shared_folder(spark)}/streams/*"
    for name in ("stream_near_dedup", "stream_keyed_dedup"):
        before = set(listed(spark, f"{streams}/in/part-*"))
        QUERIES[name](spark, sf)
        new = set(listed(spark, f"{streams}/in/part-*")) - before
        place = next(iter(new)).rsplit("/in/", 1)[0]
        assert len(new) == 3 * spark.sparkContext.defaultParallelism > 3
        thirds = [{r[0] for r in spark.read.parquet(f).selectExpr("doc_id % 3").distinct().collect()} for f in listed(spark, f"{place}/out/batch=*/part-*")]
        assert all(len(t) <= 1 for t in thirds) and len(listed(spark, f"{place}/checkpoint/commits/*")) >= 3
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for _ in range(2):
        _landed(few, f"{shared_folder(spark)}/few", 5)
    assert len(listed(spark, f"{shared_folder(spark)}/few/part-*")) == 10 and spark.read.parquet(f"{shared_folder(spark)}/few").count() == 4


def test_windows_are_scored_in_the_scan(spark):
    """No row a window and no shuffle; hashes are those of HashingTF for words of every length and script, windows those of word_windows."""
    from pyspark.ml.functions import vector_to_array

    from quern.functions.text import word_windows, words_and_marks

    words = ["a", "bc", "def", "ghij", "klmno", "é", "日本語", "𝔘x", "z" * 255, "y" * 256, "x" * 261, "w" * 5000, "!", "1234567"]
    texts = [" ".join(words[(i * k) % 14] for i in range(n)) for k, n in enumerate((1, 59, 60, 61, 121, 5000, 3840, 3841), 1)] + ["", None, "  \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labelled = docs.where("text <> ''").select("text", (F.col("doc_id") % 2).cast("double").alias("label"))
    model = learning.train_windows(labelled, 1 << 10)
    scored = learning.document_scores(model, docs, "doc_id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan
    parts = F.filter(F.split(words_and_marks(F.col("text")), " "), lambda w: w != "")
    rows = model.transform(docs.select("doc_id", F.explode(word_windows(parts)).alias("text"))).groupBy("doc_id").agg(F.avg(vector_to_array("probability")[1]).alias("p")).collect()
    want = {i: 0.0 for i in range(len(texts))} | {r["doc_id"]: r["p"] for r in rows}
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want) and len({round(x, 6) for x in want.values()}) > 4


def test_milestones_query_adds_doubles(spark, tmp_path):
    """Ten values are 500 as decimals and less as doubles: the milestone is that of the SQL, one event later."""
    import duckdb

    from quern.plans.registry import ORACLE_SQL

    values = [25.31, 16.52, 78.42, 78.9, 80.12, 47.75, 31.92, 10.57, 61.66, 68.83, 7.0]
    spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, i, 250.0) for i in range(5)], "user_id long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["milestones"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["milestones"]).fetchall()) == [(1, 10, 500), (2, 1, 500), (2, 3, 1000)]


def test_classifier_scores_every_window(spark, tmp_path, monkeypatch):
    """The query's mean is over all 60-word windows of a text, of one longer than a block of windows too."""
    from pyspark.ml.functions import vector_to_array

    from quern.functions.text import word_and_mark_list

    lengths = [30, 60, 121, 3840, 3841, 5000, 70_000, 0]
    texts = [" ".join("good fine" if (j // 60) % 3 == k % 2 else f"bad w{j % 11}" for j in range(0, n, 2)) for k, n in enumerate(lengths)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    fitted = []
    plain = learning.train_windows
    monkeypatch.setattr(learning, "train_windows", lambda *a: fitted.append(plain(*a)) or fitted[-1])
    got = {r["doc_id"]: r["score"] for r in QUERIES["classifier_score"](spark, str(tmp_path)).collect()}
    words = word_and_mark_list(F.col("text"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(60)))
    windows = docs.select("doc_id", "w", starts.alias("at")).select("doc_id", F.array_join(F.slice("w", F.col("at"), 60), " ").alias("text"))
    rows = fitted[0].transform(windows).groupBy("doc_id").agg(F.count("text").alias("n"), F.avg(vector_to_array("probability")[1]).alias("p")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {k: math.ceil(n / 60) for k, n in enumerate(lengths) if n}
    want = {7: 0.0} | {r["doc_id"]: r["p"] for r in rows}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fit_of_the_classifier_joins_its_texts_once(spark, sf, monkeypatch):
    """What the fit reads in each of its passes is a written table, no join of texts."""
    plans, plain = [], learning.train_windows
    monkeypatch.setattr(learning, "train_windows", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or plain(rows))
    QUERIES["classifier_score"](spark, sf)
    assert len(plans) == 1 and "Join" not in plans[0]
