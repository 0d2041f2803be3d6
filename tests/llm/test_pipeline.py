from collections import Counter

import corpus_pipeline as cp
from quern.llm.packing import pack
from tests.llm.test_simhash import linked_brute


def stage(spark, fn, docs, sf):
    out = fn(spark, docs, sf)
    return out


def test_stages_on_odd_rows(spark, sf, odd, empty):
    for name, fn in cp.STAGES[:-1]:
        out = fn(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert out.schema == odd.schema or [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        out.count()
        assert fn(spark, empty, sf).count() == 0
    assert cp.pack_sequences(spark, odd, sf).count() > 0


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    kept = cp.drop_exact_copies(spark, docs, sf).collect()
    best: dict = {}
    for r in docs.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert Counter(r["doc_id"] for r in kept) == Counter(best.values())

    near = {r["doc_id"] for r in cp.drop_near_copies(spark, docs, sf).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    label = linked_brute([t for _, t in rows])  # 0.8 of the five-word shingles, or two bits
    assert near == {rows[i][0] for i in set(label)}  # the smallest id of each component, and no other

    mixed = cp.mix(spark, docs, sf).collect()
    total = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * total) < 60


def test_rows_that_repeat_an_id(spark, sf):
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "quite another text here"), (2, "alpha beta gamma delta"), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in cp.drop_exact_copies(spark, docs, sf).collect())
    assert got == [(0, "x y z"), (1, "quite another text here"), (2, "alpha beta gamma delta")]
    near = sorted((r["doc_id"] or 0, r["text"]) for r in cp.drop_near_copies(spark, docs, sf).collect())
    assert near == [(0, "x y z"), (1, "alpha beta gamma delta"), (1, "quite another text here")]


def test_run(spark, sf):
    rows = cp.run(spark, sf).collect()
    assert set(pack(spark.read.parquet(f"{sf}/documents.parquet")).columns) == set(rows[0].asDict())
