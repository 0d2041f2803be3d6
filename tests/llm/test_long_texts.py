"""One text of many megabytes beside short ones, through every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, flac, html_text, license_scan, mixing, packing, pii, secret_scan, simhash, toxicity

WORDS = 2_000_000


@pytest.fixture(scope="module")
def long(spark):
    text = "a longer story " * (WORDS // 3) + "all rights reserved password=hunter2hunter2 mail a.b@c.org"
    rows = [(1, text), (2, "a short text"), (3, text[:-1] + "G"), (4, None)]
    return spark.createDataFrame([(i, t, "s", "<p>" + (t or "")) for i, t in rows], "doc_id long, text string, source string, html string").repartition(2)


@pytest.fixture(scope="module")
def texts(long):
    return {r["doc_id"]: r["text"] or "" for r in long.collect()}


def test_scans(long, texts):
    found = {r["doc_id"]: r["found"] for r in secret_scan.find_secrets(long).collect()}
    at = texts[1].index("password=")
    assert [(s["kind"], s["start"]) for s in found[1]] == [("assign", at)] and found[2] == []
    licences = {r["doc_id"]: r for r in license_scan.scan_licenses(long).collect()}
    assert licences[1]["n_base"] == 1 and licences[1]["first_word"] == WORDS // 3 * 3 and licences[4]["n_words"] == 0
    replaced = {r["doc_id"]: r for r in pii.pseudonymize(long, b"key").collect()}
    assert len(replaced[1]["entities"]) == 1 and len(replaced[1]["text"]) == len(texts[1]) and "a.b@c.org" not in replaced[1]["text"]
    pages = {r["doc_id"]: r["text"] for r in html_text.extract_text(long, "doc_id", "html").collect()}
    assert pages[1] == texts[1] and pages[4] == ""


def test_toxicity(spark, long):
    rows = [(10 + i, ("you are a worthless idiot " if i % 2 else "a calm and friendly word ") + str(i), i % 2) for i in range(100)]
    docs = long.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 104 and all(0 <= r["score"] <= 1 for r in got.values())


def test_copies_and_mix(long, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(long, huge=1 << 20).collect()}
    assert [got[i]["keep_id"] for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert got[1]["text_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
    near = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(long, similarity=0.8).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(long).collect()}
    assert sizes == {i: len(t.split()) for i, t in texts.items()}


def test_packing_and_media(long, texts):
    pieces = packing.pack(long).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces) and len(pieces) == 4
    media = {r["doc_id"]: r for r in flac.media_features(long).collect()}
    for i, t in texts.items():
        assert media[i]["verified"] and media[i]["payload_sha256"] == hashlib.sha256(flac.payload(t.encode())).hexdigest()
