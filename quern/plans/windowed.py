"""Offsets, budgets, quotas, scoring plans, packing of positions, sorting and sampling."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import sampling, tokenizing, windows
from quern.plans.base import normal, query, table, words
from quern.runtime import shared_folder
from quern.sources import ranges, sinks


def tokens(spark, sf_dir):
    """White-space words stand for tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.size(text.split_words(F.col("text"))).cast("long").alias("tokens"))


_T = r"t AS (SELECT doc_id, source, lang, n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents)"
_BEFORE = "coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"


@query("doc_offsets", f"WITH {_T} SELECT doc_id, source, {_BEFORE} AS \"offset\", tokens FROM t")
def doc_offsets(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    return windows.sums_before(rows.select("doc_id", "source", "tokens"), ["source"], ["doc_id"], offset="tokens").select("doc_id", "source", "offset", "tokens")


@query("budget_exact_cut", f"WITH {_T}, o AS (SELECT doc_id, source, tokens, {_BEFORE} AS b FROM t) SELECT doc_id, source, b AS \"offset\", least(tokens, 5000 - b) AS taken FROM o WHERE b < 5000")
def budget_exact_cut(spark, sf_dir):
    return windows.exact_cut(tokens(spark, sf_dir).select("doc_id", "source", "tokens"), "tokens", ["source"], ["doc_id"], 5000).select("doc_id", "source", "offset", "taken")


@query("budget_whole_docs", f"WITH {_T} SELECT doc_id, source, CASE WHEN {_BEFORE} >= 5000 THEN 'surplus_train' END AS reason FROM t")
def budget_whole_docs(spark, sf_dir):
    return windows.whole_rows(tokens(spark, sf_dir).select("doc_id", "source", "tokens"), "tokens", ["source"], ["doc_id"], 5000).select("doc_id", "source", "reason")


@query("panel_quota", "SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INT AS rank FROM documents QUALIFY rank <= 3")
def panel_quota(spark, sf_dir):
    return windows.quota(table(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"], 3).select("doc_id", "source", "lang", "rank")


@query("panel_by_digest", f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256({normal('text')}), doc_id)::INT AS rank FROM documents QUALIFY rank <= 5")
def panel_by_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text.digest(text.normalize(F.col("text"))).alias("digest"))
    return windows.quota(rows, ["source"], ["digest", "doc_id"], 5).select("doc_id", "source", "rank")


@query(
    "early_stop",
    """WITH c AS (SELECT doc_id, source, sum(n_chars) OVER w AS chars, count(*) FILTER (lang = 'en') OVER w AS en FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT source, min(doc_id) AS stop FROM c WHERE chars >= 20000 AND en >= 3 GROUP BY source)
    SELECT d.source, s.stop, count(*) AS collected FROM documents d JOIN s ON d.source = s.source AND d.doc_id <= s.stop GROUP BY ALL""",
)
def early_stop(spark, sf_dir):
    """Collection of a source ends at the first row where its characters and its quota are both reached."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", (F.col("lang") == "en").cast("long").alias("is_en"))
    marked = windows.sums_before(rows, ["source"], ["doc_id"], chars="n_chars", en="is_en")
    done = (F.col("chars") + F.col("n_chars") >= 20000) & (F.col("en") + F.col("is_en") >= 3)
    stops = marked.where(done).groupBy("source").agg(F.min("doc_id").alias("stop"))
    return rows.join(stops, "source").where("doc_id <= stop").groupBy("source", "stop").agg(F.count(F.lit(1)).alias("collected"))


@query("first_n_labelled", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 20")
def first_n_labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    return windows.quota(rows, ["quality"], ["doc_id"], 20).select("doc_id", "quality")


@query(
    "score_window_plan",
    f"""WITH {_T}, w AS (SELECT doc_id, tokens AS n, unnest(range(0, greatest(tokens, 1), 128)) AS s FROM t WHERE tokens >= 2),
    p AS (SELECT doc_id, n, s, least(s + 256, n) AS e, CASE WHEN s = 0 THEN 1 ELSE least(s - 128 + 256, n) END AS prev FROM w)
    SELECT doc_id, s AS start, e AS "end", greatest(prev, s + 1) AS first_target FROM p WHERE e > greatest(prev, s + 1) OR (e > prev AND e > s + 1 AND greatest(prev, s + 1) < e)""",
)
def score_window_plan(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("doc_id", F.explode(windows.score_plan(F.col("tokens"), 256, 128)).alias("w"))
    return rows.select("doc_id", "w.start", "w.end", "w.first_target")


@query(
    "eval_chunks",
    f"WITH w AS (SELECT item_id, {words(normal('text'))} AS w FROM benchmark), s AS (SELECT item_id, w, unnest(range(0, len(w) - 1, 8)) AS s FROM w WHERE len(w) >= 2) SELECT item_id, s::INT AS s, array_to_string(list_slice(w, s + 1, s + 9), ' ') AS chunk FROM s",
)
def eval_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.words(text.normalize(F.col("text"))).alias("w"))
    chunks = rows.select("item_id", F.posexplode(windows.eval_chunks(F.col("w"), 8)).alias("i", "c"))
    return chunks.select("item_id", (F.col("i") * 8).alias("s"), F.array_join("c", " ").alias("chunk"))


@query(
    "next_token_pairs",
    f"WITH w AS (SELECT item_id, {words(normal('text'))} AS w FROM benchmark), i AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w) SELECT w[i] AS x, w[i + 1] AS y, count(*) AS n FROM i GROUP BY ALL",
)
def next_token_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(text.words(text.normalize(F.col("text"))).alias("w"))
    pairs = rows.where(F.size("w") >= 2).select(F.inline(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("x"), F.slice("w", F.lit(2), F.size("w") - 1).alias("y"))))
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("eval_chunks_documents")
def eval_chunks_documents(spark, sf_dir):
    """eval_chunks over whole documents; tests hold it against plain Python."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words(text.normalize(F.col("text"))).alias("w"))
    chunks = rows.select("doc_id", F.posexplode(windows.eval_chunks(F.col("w"), 8)).alias("i", "c"))
    return chunks.select("doc_id", (F.col("i") * 8).alias("s"), F.array_join("c", " ").alias("chunk"))


@query("next_token_pairs_documents")
def next_token_pairs_documents(spark, sf_dir):
    """next_token_pairs over whole documents; tests hold it against plain Python."""
    rows = table(spark, sf_dir, "documents").select(text.words(text.normalize(F.col("text"))).alias("w"))
    pairs = rows.where(F.size("w") >= 2).select(F.inline(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("x"), F.slice("w", F.lit(2), F.size("w") - 1).alias("y"))))
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pack_positions",
    f"WITH {_T}, o AS (SELECT doc_id, source, tokens, {_BEFORE} AS b FROM t) SELECT doc_id, source, b // 512 AS first_sequence, (b + greatest(tokens, 1) - 1) // 512 AS last_sequence, b % 512 AS \"offset\" FROM o",
)
def pack_positions(spark, sf_dir):
    """Concatenate-and-cut packing as position arithmetic."""
    rows = windows.sums_before(tokens(spark, sf_dir).select("doc_id", "source", "tokens"), ["source"], ["doc_id"], b="tokens")
    first, offset = windows.circular(F.col("b"), 512)
    last, _ = windows.circular(F.col("b") + F.greatest("tokens", F.lit(1)) - 1, 512)
    return rows.select("doc_id", "source", first.alias("first_sequence"), last.alias("last_sequence"), offset.alias("offset"))


@query(
    "stream_cycles",
    "SELECT range AS step, (range * 4096) // 50021 AS cycles, (range * 4096) % 50021 AS \"cursor\", ((range * 4096) // 50021) * 50021 + (range * 4096) % 50021 AS consumed FROM range(1000)",
)
def stream_cycles(spark, sf_dir):
    position = F.col("id") * 4096
    cycles, cursor = windows.circular(position, 50021)
    return spark.range(1000).select(F.col("id").alias("step"), cycles.alias("cycles"), cursor.alias("cursor"), (cycles * 50021 + cursor).alias("consumed"))


@query(
    "stream_batches",
    r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT + 4) || [2] AS t FROM documents),
    b AS (SELECT doc_id, len(t) AS n, sum(len(t)) OVER (ORDER BY doc_id) - len(t) AS before, t FROM d),
    e AS (SELECT before + unnest(range(n)) AS pos, unnest(t) AS token FROM b),
    s AS (SELECT sum(n)::BIGINT AS total FROM b),
    p AS (SELECT 1000 + range * 1024 AS p0, range AS id, total FROM s, range(0, (total * 5 // 4 // 8192 * 8))),
    k AS (SELECT id, p0, total, unnest(range(1025)) AS i FROM p),
    j AS (SELECT id, p0, total, i, token FROM k JOIN e ON (p0 + i) % total = pos)
    SELECT (id // 8)::BIGINT AS batch, (id % 8)::BIGINT AS row, (any_value(p0) // any_value(total))::BIGINT AS cycle,
           (sum(token * i) FILTER (i < 1024))::BIGINT AS x, (sum(token * i) FILTER (i > 0))::BIGINT AS y FROM j GROUP BY id""",
)
def stream_batches(spark, sf_dir):
    """A circular stream over the bytes of all documents in uint16 shards, from token 1,000 once around and a quarter more.

    Sums of the inputs and targets by place stand for the arrays.
    """
    place = f"{shared_folder(spark)}/shards/{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    encoded = tokenizing.encode_packed(table(spark, sf_dir, "documents").select(F.lit("all").alias("part"), "doc_id", "text"), "text")
    numbered = sinks.numbered_shards(encoded, "part", "doc_id", "packed")
    paths = sinks.shard_files(numbered, place)
    stream = ranges.TokenStream(spark, paths, 1024, windows.stream_state(ranges.shard_table(paths), 1000) | {"length": 1024})
    total = sum(n for _, n in stream.shards)
    made = stream.next(8, total * 5 // 4 // 8192)

    def by_place(column: str, first: int) -> Column:
        return F.aggregate(F.transform(column, lambda t, i: t.cast("long") * (i + first)), F.lit(0).cast("long"), lambda a, t: a + t).alias(column)

    return made.select("batch", "row", "cycle", by_place("x", 0), by_place("y", 1))


# ------------------------------------------------------------------- sorting and sampling

_U = "((('0x' || substr(md5('{0}:' || doc_id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


@query("length_weighted_sample", f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln({_U.format('sample')}) / n_chars, doc_id LIMIT 50")
def length_weighted_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.weighted_sample(docs, "doc_id", F.col("n_chars"), 50, "sample").select("doc_id")


@query(
    "disjoint_sample",
    f"""WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln({_U.format('sample')}) / n_chars, doc_id LIMIT 50)
    SELECT doc_id FROM documents WHERE n_chars > 0 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY -ln({_U.format('held')}) / n_chars, doc_id LIMIT 50""",
)
def disjoint_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    first = sampling.weighted_sample(docs, "doc_id", F.col("n_chars"), 50, "sample")
    return sampling.weighted_sample(docs, "doc_id", F.col("n_chars"), 50, "held", first).select("doc_id")


@query("weighted_mixture_draw", f"WITH u AS (SELECT doc_id, {_U.format('mix')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.5 THEN 'web' WHEN u < 0.8 THEN 'wiki' ELSE 'books' END AS source FROM u")
def weighted_mixture_draw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.mixture_draw(docs, "doc_id", {"web": 0.5, "wiki": 0.3, "books": 0.2}, "mix").select("doc_id", "source")


@query("thinned", f"SELECT doc_id FROM documents WHERE {_U.format('thin')} < 0.25")
def thinned(spark, sf_dir):
    return sampling.thinned(table(spark, sf_dir, "documents"), "doc_id", "thin", 4).select("doc_id")


@query("group_cap", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_U.format('cap')}, doc_id) <= 100")
def group_cap(spark, sf_dir):
    return sampling.group_cap(table(spark, sf_dir, "documents"), ["lang"], "doc_id", "cap", 100).select("doc_id", "lang")


@query("validation_tenth", f"SELECT doc_id, (rank() OVER (ORDER BY {_U.format('cut')}, doc_id) - 1) * 10 < (SELECT count(*) FROM labels) AS valid FROM labels")
def validation_tenth(spark, sf_dir):
    """The first tenth in hash order; the cut is a position found by a top-n, so nothing is sorted in one task."""
    keyed = table(spark, sf_dir, "labels").select("doc_id", sampling.uniform(F.col("doc_id"), "cut").alias("u"))
    n = keyed.count()
    edge = keyed.orderBy("u", "doc_id").limit(-(-n // 10)).agg(F.max(F.struct("u", "doc_id")).alias("edge"))
    return keyed.crossJoin(F.broadcast(edge)).select("doc_id", F.coalesce(F.struct("u", "doc_id") <= F.col("edge"), F.lit(False)).alias("valid"))


@query("shuffled_order")
def shuffled_order(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "order")


@query("top_hosts_sorted", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_hosts_sorted(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(10)


@query(
    "head_by_chars",
    "SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 30000",
)
def head_by_chars(spark, sf_dir):
    """Rows of each source up to and with the one that crosses the budget of characters."""
    rows = windows.sums_before(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], b="n_chars")
    return rows.where("b < 30000").select("doc_id", "source")


@query(
    "head_that_suffices",
    "WITH o AS (SELECT doc_id, lang, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) SELECT doc_id, lang FROM o WHERE b < (SELECT min(s) FROM (SELECT sum(n_chars) AS s FROM documents GROUP BY lang))",
)
def head_that_suffices(spark, sf_dir):
    """Rows of each language up to as many characters as the scarcest has; a language with fewer would be an error."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    target = docs.groupBy("lang").agg(F.sum("n_chars").alias("s")).agg(F.min("s")).first()[0]
    return windows.head_by(docs, "n_chars", ["lang"], ["doc_id"], target).select("doc_id", "lang")


@query(
    "stream_state",
    "WITH t AS (SELECT sum(n_chars)::BIGINT AS total FROM documents), s AS (SELECT range * 1000003 AS consumed FROM range(50)) SELECT consumed, consumed // total AS cycles, consumed % total AS \"cursor\" FROM s, t",
)
def stream_state(spark, sf_dir):
    """States of a circular stream over the sources' characters, saved and resumed; other shards would be an error."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).orderBy("source")
    shards = [(r["source"], r["n"]) for r in sizes.collect()]  # one row a source
    states = [windows.stream_state(shards, i * 1000003) for i in range(50)]
    rows = [(windows.resumed(s, shards), s["cycles"], s["cursor"]) for s in states]
    return spark.createDataFrame(rows, "consumed long, cycles long, cursor long")


@query("length_batches")
def length_batches(spark, sf_dir):
    """Longest first within each partition, as scoring batches want them."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").sortWithinPartitions(F.col("n_chars").desc(), "doc_id")


@query(
    "epoch_guard",
    f"WITH {_T} SELECT source, 0::BIGINT AS consumed, sum(tokens)::BIGINT AS need, sum(tokens)::BIGINT AS available FROM t GROUP BY source",
)
def epoch_guard(spark, sf_dir):
    sums = tokens(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("available"))
    return sampling.epoch_budget(sums.select("source", F.lit(0).cast("long").alias("consumed"), F.col("available").alias("need"), "available"), 1.0)


@query("matched_negatives")
def matched_negatives(spark, sf_dir):
    """Passages whose lengths are drawn from those of the benchmark items, eight words at least."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.greatest(F.lit(8), F.size(text.split_words(F.col("text")))).alias("length"))
    nth = (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long")  # the benchmark is small and fixed
    lengths = bench.select(nth.alias("nth"), F.col("length").cast("long").alias("length"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.matched_passages(docs, "doc_id", text.split_words(F.col("text")), lengths, "negatives")
