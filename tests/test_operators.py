"""Golden and metamorphic cases of the core operators."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import aggregates, choices, decisions, dedup, exclusion, filters, learning, sampling, tokenizing, windows
from quern.runtime import cut


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_exclusion_by_gram_and_title(spark, monkeypatch, most):
    monkeypatch.setattr(exclusion, "BROADCAST_GRAMS", most)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    bench = spark.createDataFrame([(0, words)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + words.upper() + " y", "a"), (2, "other " * 14, "Held_out_article"), (3, " ".join(words.split()[:12]), "c")], "doc_id long, text string, title string")
    index = exclusion.index_grams(bench, F.col("text"))
    assert rows(exclusion.contaminated(docs, "doc_id", index), "doc_id") == [(1,)]
    titles = spark.createDataFrame([("held out article",)], "title string")
    assert rows(exclusion.decontaminate(docs, "doc_id", index, titles, "title"), "doc_id") == [(3,)]
    assert index.count() == 3
    loaded = spark.createDataFrame([("bench",)], "source string")
    assert exclusion.extend_index(index, loaded, "bench", docs, F.col("text")).count() == 3
    assert exclusion.extend_index(index, loaded, "docs", docs, F.col("text")).count() > 3


def test_rolling_hashes_against_definition():
    import zlib

    parts = [f"w{i}" for i in range(20)]
    got = exclusion.rolling_hashes(parts).tolist()
    for k in range(8):
        value = 0
        for w in parts[k : k + 13]:
            value = (value * 1_000_003 + zlib.crc32(w.encode()) + 1) % (1 << 64)
        assert got[k] == value
    assert exclusion.rolling_hashes(parts[:12]).tolist() == []


def test_reasons_in_order(spark):
    data = [(1, "d1", "u1"), (2, "d1", "u2"), (3, "d3", "u2"), (4, "d4", ""), (5, "d5", ""), (6, "d6", None)]
    got = dedup.exact_and_url_reasons(spark.createDataFrame(data, "id long, d string, u string"), "d", "u", "id")
    assert rows(got, "id", "reason") == [(1, None), (2, "exact_document"), (3, "same_url"), (4, None), (5, None), (6, None)]


def test_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert rows(dedup.keep_first(pairs), "id", "kept") == [(1, True), (2, False), (3, True)]


def test_rounds_equal_the_sequential_result(spark):
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    kept: set[int] = set()
    for i in range(40):
        if not any((min(i, j), max(i, j)) in edges for j in kept):
            kept.add(i)
    status = dict(rows(dedup.keep_first(spark.createDataFrame(edges, "a long, b long")), "id", "kept"))
    assert {i for i in range(40) if status.get(i, True)} == kept


@pytest.mark.parametrize("make", [dedup.sketches, dedup.exact_sketches])
def test_near_copies(spark, make):
    rng = random.Random(1)
    base = [f"term{rng.randrange(10**6)}" for _ in range(1000)]
    other = [f"term{rng.randrange(10**6)}" for _ in range(1000)]
    data = [(1, " ".join(base)), (2, " ".join([*base, "one sentence more at the end"])), (3, " ".join(other)), (4, "a b"), (5, "c d e")]
    sketched = cut(make(spark.createDataFrame(data, "doc_id long, text string"), "doc_id"))
    assert rows(dedup.near_reasons(sketched, "doc_id"), "doc_id", "near") == [(1, False), (2, True), (3, False), (4, False), (5, True)]


def crowd(rng, base, n, changes):
    """Distinct sketches that differ from a base in a few components each."""
    out = set()
    while len(out) < n:
        s = list(base)
        for c in rng.sample(range(32), rng.randint(1, changes)):
            s[c] = rng.randrange(1, 10_000)
        out.add(tuple(s))
    return list(out)


def first_wins(rows):
    kept, out = np.zeros((0, 32), np.int64), {}
    for i, s in sorted(rows):
        near = bool(len(kept)) and bool(((kept == np.array(s)).sum(axis=1) >= 28).any())
        out[i] = near
        if not near:
            kept = np.vstack([kept, s])
    return out


@pytest.mark.parametrize("changes", [2, 4])
def test_crowds_against_first_wins(spark, changes):
    """Crowds, of near copies or of rows around one sketch, beside rows that share a band and are not near."""
    rng = random.Random(changes)
    base, other = ([rng.randrange(2**32) for _ in range(32)] for _ in range(2))
    sketches_ = crowd(rng, base, 150, changes) + crowd(rng, other, 60, 3) + [tuple(base), tuple(base)]
    sketches_ += [tuple([*base[:4], *(rng.randrange(2**32) for _ in range(28))]) for _ in range(80)]
    rng.shuffle(sketches_)
    data = list(enumerate(sketches_))
    df = spark.createDataFrame([(i, list(s)) for i, s in data], "doc_id long, sketch array<long>")
    assert dict(rows(dedup.near_reasons(df, "doc_id", most=16), "doc_id", "near")) == first_wins(data)
    # Behind a prior corpus whose rows all stay.
    old = [(i, s) for i, s in data if i % 3 == 0]
    prior = df.where("doc_id % 3 = 0")
    kept, want = np.array([s for _, s in old]), {}
    for i, s in sorted(d for d in data if d[0] % 3):
        want[i] = bool(((kept == np.array(s)).sum(axis=1) >= 28).any())
        if not want[i]:
            kept = np.vstack([kept, s])
    assert dict(rows(dedup.near_reasons(df.where("doc_id % 3 > 0"), "doc_id", prior, most=16), "doc_id", "near")) == want


def test_a_large_crowd_makes_no_pairs(spark):
    """20,000 mutual near copies are settled by the first of them, and nothing is left to pair."""
    rng = random.Random(9)
    base = [rng.randrange(2**32) for _ in range(32)]
    data = crowd(rng, base, 20_000, 2)
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(data)], "doc_id long, sketch array<long>").repartition(4)
    classes = cut(df.select(F.struct(F.lit(1).alias("late"), F.col("doc_id").alias("id")).alias("row"), "sketch"))
    rest, settled = dedup.crowds(classes)
    assert rest.isEmpty() and settled.where("kept").count() == 1 and settled.count() == 20_000
    assert rows(dedup.near_reasons(df, "doc_id").groupBy("near").count(), "near", "count") == [(False, 1), (True, 19_999)]


def test_upper_median_of_a_hot_group(spark):
    rng = random.Random(5)
    data = [(1 if rng.random() < 0.9 else rng.randrange(2, 9), float(rng.randrange(400)) / 7) for _ in range(3000)]
    data += [(None, 1.5), (None, None), (20, None), (21, 2.0), (21, 2.0), (21, 3.0), (22, -0.0), (22, 5.0)]
    want = {}
    for g in {g for g, _ in data}:
        values = sorted((v is not None, v or 0.0) for h, v in data if h == g)
        want[g] = values[len(values) // 2][1] if values[len(values) // 2][0] else None
    df = spark.createDataFrame(data, "g int, v double")
    assert {r["g"]: r["median"] for r in aggregates.upper_median(df, ["g"], "v").collect()} == want
    assert aggregates.upper_median(df.limit(0), ["g"], "v").count() == 0


def test_lineage_beyond_its_bound_is_an_error(spark):
    spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "c int, p int").createOrReplaceTempView("line")
    assert decisions.lineage(spark, "line", "c", "p", 12).count() == 66
    with pytest.raises(PySparkException, match="generations"):
        decisions.lineage(spark, "line", "c", "p", 5).collect()


def test_exact_sketch_against_definition():
    import xxhash

    words = [f"w{i % 50}" for i in range(120)]
    a, b = dedup._exact_family()
    want = [min((int(x) * xxhash.xxh32_intdigest(" ".join(words[i : i + 5])) + int(y)) % (1 << 64) % ((1 << 61) - 1) & 0xFFFFFFFF for i in range(116)) for x, y in zip(a, b)]
    assert dedup.exact_sketch("  ".join(words).upper()) == want
    assert dedup.exact_sketch("a b c d") == dedup.exact_sketch(None) == [0] * 32


def test_golden_near_copies(spark):
    """After length, benchmark and exact reasons, the exact family rejects four more documents of the middle tables."""
    import os

    from quern.plans.corpus import staged

    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    kept = staged(spark, base).where("reason IS NULL").select("doc_id")
    docs = kept.join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), "doc_id")
    sketched = cut(dedup.exact_sketches(docs, "doc_id"))
    assert dedup.near_reasons(sketched, "doc_id").where("near").count() == 4


def test_sequential_oracle_on_real_rows(spark, sf):
    """The set-based near-copy result equals first-wins over the same sketches in id order."""
    sketched = cut(dedup.sketches(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id"))
    got = dict(rows(dedup.near_reasons(sketched, "doc_id"), "doc_id", "near"))
    kept: list = []
    for i, s in sorted((r["doc_id"], r["sketch"]) for r in sketched.collect()):
        near = any(sum(a == b for a, b in zip(s, t)) >= 28 for t in kept)
        assert got[i] == near
        if not near:
            kept.append(s)


def test_hot_keys_and_missing_urls(spark):
    """Most rows hold one digest, none a URL: first wins, and rows without a URL never repeat."""
    n = 20_000
    docs = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("d"), F.when(F.col("id") % 2 == 0, "").alias("u"))
    got = dedup.exact_and_url_reasons(docs, "d", "u", "id").groupBy("reason").count()
    assert {r["reason"]: r["count"] for r in got.collect()} == {"exact_document": n * 9 // 10 - 1, None: n // 10 + 1}
    nulls = docs.withColumn("d", F.lit(None).cast("string"))
    assert rows(dedup.mark_repeated(nulls, "d", "id").where("not again"), "id") == [(0,)]


@pytest.mark.parametrize("most", [512, 20, 2])
def test_hot_bands_lose_no_pair(spark, most):
    """Sketches of one boilerplate fill the bands; buckets dealt again still hold every near pair."""
    import numpy as np

    rng = np.random.default_rng(0)
    base, made = rng.integers(0, 2**32, 32), []
    for i in range(300):
        sketch, k = base.copy(), int(rng.integers(0, 12))
        sketch[rng.choice(32, k, replace=False)] = rng.integers(0, 2**32, k)
        made.append((i, sketch.tolist()))
    got = rows(dedup.near_pairs(spark.createDataFrame(made, "id long, sketch array<long>"), "id", most=most), "a", "b", "equal")
    firsts: dict = {}
    for i, s in made:
        firsts.setdefault(tuple(s), i)
    ids = sorted(firsts.values())
    want = [(a, b, sum(x == y for x, y in zip(made[a][1], made[b][1]))) for n, a in enumerate(ids) for b in ids[n + 1 :]]
    assert got == sorted(p for p in want if p[2] >= 28)


@pytest.mark.parametrize("rounds", [1, 2, 5, 6])
def test_long_chains_are_settled(spark, rounds):
    """More links than there are rounds: the rest is walked in order, component by component."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1002), (1001, 1002)]
    got = dict(rows(dedup.keep_first(spark.createDataFrame(edges, "a long, b long"), rounds=rounds), "id", "kept"))
    assert all(got[i] == (i % 2 == 0) for i in range(301)) and (got[1000], got[1001], got[1002]) == (True, True, False)


def test_sums_before_across_ranges(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(5)}" if rng.random() < 0.9 else None, i, rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(data, "s string, i long, n long").repartition(5)
    got = dict(rows(windows.sums_before(df, ["s"], ["i"], at="n", k="i"), "i", "at"))
    seen: dict = {}
    for s, i, n in data:
        assert got[i] == seen.get(s, 0)
        seen[s] = seen.get(s, 0) + n
    assert windows.sums_before(df.limit(0), ["s"], ["i"], at="n").count() == 0


def test_budgets(spark):
    docs = spark.createDataFrame([("a", i, 100) for i in range(5)], "s string, i long, n long")
    assert rows(windows.exact_cut(docs, "n", ["s"], ["i"], 256), "i", "taken") == [(0, 100), (1, 100), (2, 56)]
    kept = windows.whole_rows(docs, "n", ["s"], ["i"], 256).where("reason IS NULL")
    assert rows(kept, "i") == [(0,), (1,), (2,)]
    assert rows(windows.quota(docs, ["s"], ["i"], 2), "i") == [(0,), (1,)]


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 13, 100])
@pytest.mark.parametrize("context, stride", [(4, 2), (4, 3), (8, 3)])
def test_every_target_is_scored_once(spark, n, context, stride):
    plan = spark.range(1).select(windows.score_plan(F.lit(n), context, stride).alias("w")).first()["w"]
    targets = [t for w in plan for t in range(w["first_target"], w["end"])]
    assert targets == list(range(1, n))
    assert all(w["end"] - w["start"] <= context for w in plan)
    with pytest.raises(ValueError):
        windows.score_plan(F.lit(n), context, context)


def test_next_tokens_and_cycles(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 4],)], "t array<int>")
    assert [(p["x"], p["y"]) for p in df.select(windows.shifted_pairs(F.col("t")).alias("p")).first()["p"]] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert df.select(windows.eval_chunks(F.col("t"), 2).alias("c")).first()["c"] == [[0, 1, 2], [2, 3, 4]]
    cycle, cursor = windows.circular(F.lit(16), 11)
    assert tuple(spark.range(1).select(cycle, cursor).first()) == (1, 5)


def test_ties_take_the_first_choice(spark):
    df = spark.createDataFrame([("t", 1, 0, 0.5, 3, 1), ("t", 1, 1, 0.5, 1, 1), ("t", 2, 0, 0.1, 0, 0), ("t", 2, 1, 0.0, 2, 0)], "task string, item long, idx int, score double, length int, label int")
    got = choices.accuracy(df).first()
    assert (got["acc"], got["acc_norm"], got["n"]) == (0.5, 1.0, 2)
    assert choices.proxy_mean(choices.accuracy(df)).first()["proxy"] is None


def test_formats(spark):
    arc = spark.createDataFrame([("Q?", "B", (["A", "B"], ["x", "y"])), ("Q?", "Z", (["A"], ["x"]))], "question string, answerKey string, choices struct<label:array<string>,text:array<string>>")
    assert [r.asDict() for r in choices.arc_example(arc).collect()] == [{"context": "Q?", "answer": "y", "choices": ["x", "y"], "label": 1, "text": "Q? y"}]
    blank = spark.createDataFrame([("Tom gave _ the ball.", "Ann", "Bob", "2"), ("none", "a", "b", "1")], "sentence string, option1 string, option2 string, answer string")
    assert [r["text"] for r in choices.winogrande_example(blank).collect()] == ["Tom gave Bob the ball."]
    pairs = blank.where("answer = 2").select(choices.blank_pairs(F.col("sentence"), F.array("option1", "option2")).alias("p")).first()["p"]
    assert [tuple(p) for p in pairs] == [("Tom gave Ann", " the ball."), ("Tom gave Bob", " the ball.")]
    act = spark.createDataFrame([("Roof shingle removal", "A man is on a roof.", "he", ["a. [title] b."])], "a string, x string, y string, e array<string>")
    pair = act.select(choices.activity_pairs(F.col("a"), F.col("x"), F.col("y"), F.col("e")).alias("p")).first()["p"][0]
    assert pair["context"] == "Roof shingle removal: A man is on a roof. He" and pair["continuation"].startswith(" a.")
    moved = spark.range(1).select(choices.boundary_pair(F.lit("ab "), F.lit("c")).alias("p")).first()["p"]
    assert tuple(moved) == ("ab", " c")


def test_model_window(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "c array<int>, k array<int>")
    assert df.select(choices.model_window(F.col("c"), F.col("k"), 3).alias("w")).first()["w"] == [2, 3, 4, 5]
    with pytest.raises(PySparkException):
        df.select(choices.model_window(F.col("c"), F.col("k"), 1).alias("w")).collect()


def test_rules_are_inclusive(spark):
    schema = "run string, proxy double, wiki double, idx int"
    base = spark.createDataFrame([("base", 0.4, 1.0, 0)], schema)

    def other(proxy, wiki):
        return decisions.challenger(base, spark.createDataFrame([("new", proxy, wiki)], "run string, proxy double, wiki double")).first()["selected"]

    assert other(0.405, 1.01) == "new" and other(0.4049, 1.0) == "base" and other(0.5, 1.0101) == "base"
    none = spark.createDataFrame([], "run string, proxy double, wiki double")
    assert decisions.challenger(base, none).first()["selected"] == "base"
    field = spark.createDataFrame([("best", 0.9, 1.5, 1), ("ok", 0.5, 1.0, 2), ("tie", 0.5, 1.0, 3)], schema)
    assert decisions.guarded_best(base, field, 0.02, 0.01).first()["selected"] == "ok"
    assert decisions.guarded_best(base, field.where("idx = 1"), 0.02, 0.01).first()["selected"] == "base"


def test_three_ways(spark):
    def way(a, b):
        return spark.range(1).select(decisions.three_way(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])).alias("x")).first()["x"]

    assert way((0.5, 20.0), (0.5, 20.0)) == "USER_DECIDES"
    assert way((0.5, 20.0), (0.6, 20.0)) == "V2" and way((0.5, 20.0), (0.5, 21.0)) == "V1"


def test_acceptance(spark):
    import math

    def good(s, n, nll, ppl):
        return spark.range(1).select(decisions.consistent(F.lit(s), F.lit(n), F.lit(nll), F.lit(ppl)).alias("x")).first()["x"]

    assert good(4.0, 2, 2.0, math.exp(2)) and not good(4.0, 2, 2.0, 3.0) and not good(4.0, 0, 2.0, math.exp(2))


def test_losses_and_errors(spark):
    records = spark.createDataFrame([("web", 4.0, 2), ("wiki", 2.0, 1)], "source string, nll_sum double, token_count long")
    assert abs(aggregates.mixture_loss(records, {"web": 0.8, "wiki": 0.2}).first()["nll"] - 2.0) < 1e-12
    with pytest.raises(ValueError):
        aggregates.mixture_loss(records, {"web": 0.8})
    with pytest.raises(PySparkException):
        aggregates.mixture_loss(records, {"web": 0.5, "books": 0.5}).collect()


def test_running_sum_equals_a_single_task(spark):
    data = [(i % 37, i % 5 + 1) for i in range(500)]
    df = spark.createDataFrame(data, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    upto, total = {}, 0
    for k, n in sorted((r["k"], r["n"]) for r in df.collect()):
        total += n
        upto[k] = total
    for parts in (1, 3, 8):
        assert dict(rows(aggregates.running(df, "k", "n", parts=parts), "k", "upto")) == upto


def test_soups(spark):
    a, b = (spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(x)], "name string, idx int, value double") for x in ((1, 2), (3, 6)))
    for alpha, want in ((0.0, [1, 2]), (1.0, [3, 6]), (0.5, [2, 4])):
        assert [v for _, v in rows(aggregates.interpolate(a, b, alpha), "idx", "value")] == want
    both = a.withColumn("model", F.lit(0)).unionByName(b.withColumn("model", F.lit(1)))
    assert [v for _, v in rows(aggregates.parameter_mean(both), "idx", "value")] == [2, 4]
    with pytest.raises(PySparkException):
        aggregates.interpolate(a, b.where("idx = 0"), 0.5).collect()
    ranked = spark.createDataFrame([("a", 0.8), ("b", 0.2), ("c", 0.8)], "run string, proxy double")
    assert rows(learning.greedy_soup(ranked, 0.8), "run", "accepted") == [("a", True), ("b", False), ("c", True)]


def test_epoch_budget_fails_before_any_advance(spark):
    needs = spark.createDataFrame([("a", 0, 5, 10), ("b", 8, 5, 10)], "source string, consumed long, need long, available long")
    with pytest.raises(PySparkException):
        sampling.epoch_budget(needs, 1.0).collect()
    assert sampling.epoch_budget(needs, 2.0).count() == 2


def test_samples_are_stable_and_disjoint(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id").withColumn("w", F.col("doc_id") % 10 + 1)
    a = rows(sampling.weighted_sample(df, "doc_id", F.col("w"), 100, "s"), "doc_id")
    assert a == rows(sampling.weighted_sample(df.repartition(7), "doc_id", F.col("w"), 100, "s"), "doc_id")
    b = rows(sampling.weighted_sample(df, "doc_id", F.col("w"), 100, "s", spark.createDataFrame(a, "doc_id long")), "doc_id")
    assert not set(a) & set(b)
    heavy = sum(i[0] % 10 >= 5 for i in a)
    assert heavy > 60  # weights of 6 to 10 against 1 to 5


def test_filters(spark):
    df = spark.createDataFrame([("x" * 240,), ("x" * 239,), (None,), ("x" * 200_001,)], "t string")
    assert [r["x"] for r in df.select(filters.length_ok(F.col("t")).alias("x")).collect()] == [True, False, False, False]
    tokens = spark.createDataFrame([([5, 1, 2, 3, 9],)], "t array<int>")
    got = tokens.select(filters.truncate_tokens(F.col("t"), 3, 2).alias("a"), filters.without_special(F.col("t")).alias("b"), filters.tokens_valid(F.col("t"), 9).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == ([5, 1, 2], [5, 9], False)


def test_reconciliation_and_checks(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    assert decisions.reconciled(a, a, "k", "n").count() == 2
    with pytest.raises(PySparkException):
        decisions.reconciled(a, a.where("k = 'x'"), "k", "n").collect()
    made = decisions.checklist(a, ("low", F.col("n") < 2), ("set", F.col("k").isNotNull()))
    assert rows(made, "check", "status") == [("low", "FAIL"), ("set", "PASS")]


def test_pretokens_and_byte_tokens(spark):
    df = spark.createDataFrame([("aaab aaab x12 2",)], "t string")
    assert rows(tokenizing.pretoken_counts(df, "t"), "word", "n") == [("2", 1), ("aaab", 2), ("x12", 1)]
    assert rows(tokenizing.pretoken_counts(df, "t", digits=True), "word", "n") == [("1", 1), ("2", 2), ("aaab", 2), ("x", 1)]
    df = spark.createDataFrame([("héllo",)], "t string")
    assert tokenizing.decode(tokenizing.encode(df, "t"), "ids").first()["decoded"] == "héllo"
    assert tokenizing.bytes_per_token(df, "t").first()["bytes_per_token"] == 1.0


def test_pairs_chunks_and_decoding_cover_whole_documents(spark, tmp_path):
    from collections import Counter

    from quern.plans.registry import QUERIES

    texts = {1: " ".join(f"w{i % 90}" for i in range(300)), 2: "one two", 3: "single", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {i: (t or "").split() for i, t in texts.items()}
    pairs = Counter(p for w in words.values() for p in zip(w, w[1:]))
    assert {(r["x"], r["y"]): r["n"] for r in QUERIES["next_token_pairs_documents"](spark, str(tmp_path)).collect()} == pairs
    chunks = {(i, s, " ".join(w[s : s + 9])) for i, w in words.items() if len(w) >= 2 for s in range(0, len(w) - 1, 8)}
    assert {tuple(r) for r in QUERIES["eval_chunks_documents"](spark, str(tmp_path)).collect()} == chunks
    assert {r["doc_id"]: r["text"] for r in QUERIES["decoded_whole_documents"](spark, str(tmp_path)).collect()} == {i: t or "" for i, t in texts.items()}
