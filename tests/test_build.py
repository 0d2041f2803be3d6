"""Whole builds, configurations and contracts."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from quern.operators import dedup, exclusion
from quern.plans.build import Config, build, contract, inherited


def test_inheritance():
    files = {"a": {"x": 1, "y": {"k": 1}}, "b": {"inherits": "a", "y": {"z": 2}}}
    assert inherited({"inherits": "b", "w": 3}, files.__getitem__) == {"x": 1, "y": {"z": 2}, "w": 3}
    files["a"]["inherits"] = "b"
    with pytest.raises(ValueError):
        inherited({"inherits": "b"}, files.__getitem__)


def test_contracts():
    assert contract(Config()) == contract(Config()) != contract(Config(shard_tokens=9))


def test_build(spark, tmp_path):
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen"
    pad = " ".join(f"w{i}" for i in range(500))
    rows = [
        (0, "a", "http://x.org/1", f"{pad} first text"),
        (1, "a", "http://x.org/2", f"{pad.upper()} FIRST text"),  # exact copy
        (2, "a", "https://www.x.org/2#part", " ".join(f"u{i}" for i in range(80))),  # URL of a copy
        (3, "a", "http://x.org/3", "short"),
        (4, "b", "http://sub.bad.com/", " ".join(f"v{i}" for i in range(90))),
        (5, "b", None, pad[::-1] + " " + bench),
        (6, "b", "http://x.org/6", f"{pad} first text and a little more"),  # near copy
        (7, "b", "http://x.org/7", " ".join(f"z{i}" for i in range(90))),
    ]
    docs = spark.createDataFrame(rows, "pos long, source string, url string, text string").select("pos", F.col("pos").cast("string").alias("id"), "source", "url", F.lit("").alias("title"), "text")
    index = exclusion.index_grams(spark.createDataFrame([(bench,)], "t string"), F.col("t"))
    config = Config(blocklist=("bad.com",), shard_tokens=100)
    folder = str(tmp_path / "out")
    made = build(spark, docs, folder, config, index)
    funnel = {(r["source"], r["reason"]): r["n"] for r in made["funnel"].collect()}
    assert funnel[("a", "exact_document")] == funnel[("a", "same_url")] == funnel[("a", "length")] == 1
    assert funnel[("b", "domain_blocklist")] == funnel[("b", "benchmark_exact")] == funnel[("b", "approximate_near_document")] == 1
    kept = {r["pos"] for r in made["index"].collect()} | {r["pos"] for r in made["panels"].collect()}
    assert kept == {0, 7}
    parts = sorted((r["part"], r["number"], bytes(r["shard"])) for r in made["shards"].collect())
    assert len(parts) > 4 and {len(s) for _, _, s in parts} >= {200}
    shards = {p: np.frombuffer(b"".join(s for q, _, s in parts if q == p), "<u2") for p in {p for p, _, _ in parts}}
    for r in made["index"].collect():
        assert r["number"] == r["offset"] // 100
        ids = shards[r["source"]][r["offset"] : r["offset"] + r["length"]]
        assert ids[-1] == 2 and bytes((ids[:-1] - 4).astype(np.uint8)).decode() == rows[r["pos"]][3]
    assert build(spark, docs.limit(0), folder, config)["funnel"].count() == made["funnel"].count()  # already there
    with pytest.raises(ValueError):
        build(spark, docs, folder, Config())


def test_prior_corpus(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(0, "0", "a", None, "", text)], "pos long, id string, source string, url string, title string, text string")
    from quern.functions.text import digest, normalize

    prior = docs.select(digest(normalize(F.col("text"))).alias("digest"), "url")
    made = build(spark, docs, str(tmp_path / "p"), Config(), prior=prior)
    assert [(r["reason"], r["n"]) for r in made["funnel"].collect()] == [("exact_document", 1)]


def test_near_copies_of_a_prior_corpus(spark, tmp_path):
    """Near copies of prior texts go, whichever prior rows are near each other; the others stay."""
    base = [f"w{i}" for i in range(300)]
    near, other = [*base[:299], "changed"], [f"u{i}" for i in range(300)]
    schema = "pos long, id string, source string, url string, title string, text string"
    docs = spark.createDataFrame([(0, "0", "a", None, "", " ".join(near)), (1, "1", "a", None, "", " ".join(other)), (2, "2", "a", None, "", " ".join([*other[:299], "last"]))], schema)
    prior = spark.createDataFrame([(0, "x", " ".join(base)), (1, "y", " ".join(["first", *base[1:]]))], "pos long, digest string, text string").withColumn("url", F.lit(None).cast("string"))
    for kind, old in (("t", prior), ("s", dedup.sketches(prior, "pos").withColumn("digest", F.lit("x")).withColumn("url", F.lit(None).cast("string")))):
        made = build(spark, docs, str(tmp_path / kind), Config(), prior=old)
        assert sorted((r["reason"], r["n"]) for r in made["funnel"].collect()) == [("approximate_near_document", 2), ("kept", 1)]
        assert {r["pos"] for r in made["index"].collect()} | {r["pos"] for r in made["panels"].collect()} == {1}


def test_stages_and_command_line(spark, tmp_path, capsys):
    import json

    from quern.plans.build import main, reasons

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(0, "a", "http://x.org/1", text), (1, "a", "https://y.wiki.org/2", text + " more"), (2, "a", "http://bad.com/3", "short"), (3, "b", "http://x.org/4", text)]
    docs = spark.createDataFrame(rows, "pos long, source string, url string, text string").select("pos", F.col("pos").cast("string").alias("id"), "source", "url", F.lit("").alias("title"), "text")
    got = {c: {r["pos"]: r["reason"] for r in reasons(docs, None, None, None, Config(cascade=c, blocklist=("bad.com",), avoid=".wiki.org/", near=False)).collect()} for c in ("new", "extension", "reused")}
    assert got["new"] == {0: None, 1: None, 2: "length", 3: "exact_document"}
    assert got["extension"] == {0: None, 1: "prefer_origin", 2: "length", 3: "exact_document"}
    assert got["reused"] == {0: None, 1: None, 2: "domain_blocklist", 3: None}
    docs.select(F.col("pos").alias("doc_id"), "source", "url", "text").write.parquet(str(tmp_path / "docs"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": str(tmp_path / "docs"), "out": str(tmp_path / "out"), "blocklist": ["bad.com"], "near": False}))
    main([str(config), "reused"])
    main([str(config), "manifest"])
    shown = capsys.readouterr().out.splitlines()
    assert shown[:4] == shown[4:] and "funnel 3" in shown


def test_ranges_go_on_where_they_were_stopped(spark, tmp_path):
    """A build that dies after some of its ranges repeats none of them; sources can be built apart."""
    import json

    from quern.plans import ranged

    files = {}
    for source in ("a", "b"):
        files[source] = [str(tmp_path / f"{source}{k}.jsonl") for k in range(2)]
        for k, path in enumerate(files[source]):
            with open(path, "w") as f:
                for i in range(120):
                    f.write(json.dumps({"id": f"{source}{k}-{i}", "url": "http://bad.com/" if i % 10 == 0 else None, "text": "word " * (i % 13)}) + "\n")
    out, schema, seen = str(tmp_path / "out"), "id string, url string, text string", []
    plain = ranged.reused_rows(("bad.com",))

    def work(rows):
        seen.append(sorted(r["part"] for r in rows.select("part").distinct().collect()))
        if len(seen) == 3:
            raise KeyboardInterrupt
        return plain(rows)

    every = ranged.parts_of(files, 1000)
    assert len(every) > 20
    with pytest.raises(KeyboardInterrupt):
        ranged.build_parts(spark, files, out, schema, work, 1000, together=4)
    assert ranged.entered(spark, out) == {p.name for p in every[:8]}
    partly = {r["id"] for r in ranged.built(spark, out).select("id").collect()}
    assert 0 < len(partly) < 480
    again = ranged.build_parts(spark, files, out, schema, work, 1000, together=4, sources=["a"])
    assert [p.name for p in again] == [p.name for p in every[8:] if p.source == "a"]
    rest = ranged.build_parts(spark, files, out, schema, work, 1000, together=64)
    assert {p.source for p in rest} == {"b"} and ranged.build_parts(spark, files, out, schema, work, 1000) == []
    rows = ranged.built(spark, out).collect()
    assert sorted(r["id"] for r in rows) == sorted(f"{s}{k}-{i}" for s in "ab" for k in range(2) for i in range(120))
    for r in rows:
        i = int(r["id"].split("-")[1])
        assert (r["reason"], len(r["ids"])) == (("domain_blocklist", 0) if i % 10 == 0 else (None, 5 * (i % 13) + 1))
    names = [n for batch in seen for n in batch]
    assert len(names) - len(set(names)) <= 4  # only those of the job that died
    with pytest.raises(ValueError):
        ranged.build_parts(spark, files, out, schema, work, 999)


def test_command_line_with_prior_titles_and_ranges(spark, tmp_path, capsys):
    import json

    from quern.functions.text import digest, normalize
    from quern.plans.build import main

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(0, "a", "http://x.org/1", "t", text), (1, "a", "http://x.org/2", "Held_Out", text + " more"), (2, "b", "http://x.org/3", "u", text + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, url string, title string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs.limit(1).select(digest(normalize(F.col("text"))).alias("digest"), F.lit("http://old.org/").alias("url")).write.parquet(str(tmp_path / "prior"))
    spark.createDataFrame([("held out",)], "title string").write.parquet(str(tmp_path / "titles"))
    config = tmp_path / "c.json"
    settings = {"documents": str(tmp_path / "docs"), "prior": str(tmp_path / "prior"), "titles": str(tmp_path / "titles"), "out": str(tmp_path / "out"), "near": False}
    config.write_text(json.dumps(settings))
    main([str(config), "extension"])
    got = {(r["source"], r["reason"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out" / "funnel")).collect()}
    assert got == {("a", "exact_document"): 1, ("a", "benchmark_exact"): 1, ("b", "kept"): 1}
    with open(tmp_path / "a.jsonl", "w") as f:
        f.write("".join(json.dumps({"id": str(i), "url": None, "title": "", "text": text}) + "\n" for i in range(9)))
    config.write_text(json.dumps({"files": {"a": [str(tmp_path / "a.jsonl")], "b": [str(tmp_path / "a.jsonl")]}, "out": str(tmp_path / "parts"), "range_bytes": 700}))
    capsys.readouterr()
    main([str(config), "ranges", "a"])
    main([str(config), "ranges"])
    shown = capsys.readouterr().out.splitlines()
    assert shown[0] == shown[2] and shown[1] == "a kept 9" and shown[3:] == ["a kept 9", "b kept 9"]


def test_a_build_keeps_no_lists_of_ids(spark, sf):
    """Ids are held packed: what a build leaves in the shared folder is less than the texts as two-byte ids."""
    import glob
    import os

    from pyspark.sql import functions as F

    from quern.operators import exclusion
    from quern.plans.build import Config, build
    from quern.runtime import shared_folder

    place = f"{shared_folder(spark)}/packed-build"
    path = place.removeprefix("file:")
    docs = spark.range(400).selectExpr("id AS pos", "cast(id AS string) AS id", "'s' AS source", "cast(NULL AS string) AS url", "'' AS title", "repeat(concat('word', cast(id AS string), ' '), 3000) AS text")
    top = os.path.dirname(path)

    def held():
        return sum(os.path.getsize(f) for f in glob.glob(f"{top}/**", recursive=True) if os.path.isfile(f))

    before, texts = held(), docs.selectExpr("sum(length(text))").first()[0]
    index = exclusion.index_grams(spark.createDataFrame([("no such words",)], "text string"), F.col("text"))
    made = build(spark, docs, place, Config(near=False, panel_quota=0, shard_tokens=1 << 16), index)
    shards = made["shards"].orderBy("number").collect()
    train = made["index"].orderBy("pos").collect()
    whole = b"".join(bytes(r["shard"]) for r in shards)
    assert sum(r["tokens"] for r in shards) == sum(r["length"] for r in train) == len(whole) // 2
    want = b"".join(b"".join((b + 4).to_bytes(2, "little") for b in (f"word{r['pos']} " * 3000).encode()) + (2).to_bytes(2, "little") for r in train)
    assert whole == want and sum(r["documents"] for r in shards) == len(train)
    assert held() - before < 2 * texts
