"""Corpus figures, evaluation metrics, classifiers, decisions and reports.

Where a query needs a model's output, a deterministic figure from the tables stands for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import numeric, text
from quern.operators import aggregates, choices, decisions, learning, windows
from quern.plans.base import query, table
from quern.plans.corpus import HOST_SQL
from quern.plans.windowed import tokens
from quern.runtime import written

_T = r"t AS (SELECT doc_id, source, lang, n_chars, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents)"


@query("bucket_stats", f"WITH {_T} SELECT source, lang, sum(tokens)::BIGINT AS tokens, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM t GROUP BY ALL")
def bucket_stats(spark, sf_dir):
    return aggregates.corpus_stats(tokens(spark, sf_dir), ["source", "lang"], "tokens", F.col("n_chars"))


@query("mixture_shares", f"WITH {_T}, s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM t GROUP BY source) SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s) AS share FROM s")
def mixture_shares(spark, sf_dir):
    return aggregates.shares(tokens(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("tokens")), "tokens")


@query("host_histogram", f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_histogram(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "pages"), [], text.host(F.col("url")), "host")


@query("top_hosts", f"SELECT lang, host, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, host)::INT AS rank FROM (SELECT regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY ALL) QUALIFY rank <= 20")
def top_hosts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"), "url")
    return aggregates.top_k(aggregates.histogram(pages, ["lang"], text.host(F.col("url")), "host"), ["lang"], "host", 20)


@query("top1_share", "SELECT lang, max(n) AS top, sum(n)::BIGINT AS documents, max(n) / sum(n) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def top1_share(spark, sf_dir):
    return aggregates.top_share(aggregates.histogram(table(spark, sf_dir, "documents"), ["lang"], F.col("source"), "source"), ["lang"])


@query("epochs_at_budget", f"WITH {_T} SELECT source, round(1000000 * 0.05 / greatest(1, sum(tokens)), 2) AS epochs FROM t GROUP BY source")
def epochs_at_budget(spark, sf_dir):
    sums = tokens(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return sums.select("source", F.round(1_000_000 * 0.05 / F.greatest(F.lit(1), F.col("tokens")), 2).alias("epochs"))


@query("tokens_ledger", f"WITH {_T} SELECT lang, sum(tokens)::BIGINT AS tokens, sum(least(tokens, 500))::BIGINT AS capped, count(DISTINCT source) AS sources FROM t GROUP BY lang")
def tokens_ledger(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum(F.least("tokens", F.lit(500))).alias("capped"), F.count_distinct("source").alias("sources"))


@query("manifest_shards", f"WITH {_T} SELECT source AS bucket, doc_id % 4 AS shard, sum(tokens)::BIGINT AS tokens, count(*) AS documents FROM t GROUP BY ALL")
def manifest_shards(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    return rows.groupBy(F.col("source").alias("bucket"), (F.col("doc_id") % 4).alias("shard")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


@query("diversity_report", f"WITH {_T}, h AS (SELECT lang, source, count(*) AS n, sum(tokens) AS k FROM t GROUP BY ALL) SELECT lang, sum(k)::BIGINT AS tokens, sum(n)::BIGINT AS documents, max(n) / sum(n) AS top1, count(*) AS origins FROM h GROUP BY lang")
def diversity_report(spark, sf_dir):
    rows = tokens(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("k"))
    return rows.groupBy("lang").agg(F.sum("k").alias("tokens"), F.sum("n").alias("documents"), (F.max("n") / F.sum("n")).alias("top1"), F.count(F.lit(1)).alias("origins"))


@query("panel_fallback", "SELECT n.n_nationkey, coalesce(c.n, r.n) AS documents, CASE WHEN c.n IS NULL THEN 'parent' ELSE 'own' END AS origin FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c ON c_nationkey = n_nationkey JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) r ON r.n_regionkey = n.n_regionkey")
def panel_fallback(spark, sf_dir):
    """A nation without rich customers falls back to its region's figure, and says so."""
    nation = table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("own"))
    parent = nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("parent"))
    joined = nation.join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(parent, "n_regionkey")
    return joined.select("n_nationkey", F.coalesce("own", "parent").alias("documents"), F.when(F.col("own").isNull(), "parent").otherwise("own").alias("origin"))


@query("lookup_join", "SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    """Lookups by key: the planner picks broadcasts by the statistics of each side."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("reconciliation", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def reconciliation(spark, sf_dir):
    """Counts taken in two ways must agree, else the query fails."""
    docs = table(spark, sf_dir, "documents")
    a = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    b = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k")).groupBy("lang").agg(F.sum("k").alias("n"))
    return decisions.reconciled(a, b, "lang", "n")


# ------------------------------------------------------------------- losses


def _records(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    return rows.select(F.col("lang").alias("source"), (F.col("n_chars") * 0.5).alias("nll_sum"), F.col("tokens").alias("token_count"))


@query("source_losses", f"WITH {_T} SELECT lang AS source, sum(n_chars * 0.5) AS nll_sum, sum(tokens)::BIGINT AS token_count, count(*) AS documents, sum(n_chars * 0.5) / sum(tokens) AS nll, exp(sum(n_chars * 0.5) / sum(tokens)) AS perplexity FROM t GROUP BY lang")
def source_losses(spark, sf_dir):
    return aggregates.source_losses(_records(spark, sf_dir))


@query("mixture_nll", f"WITH {_T}, s AS (SELECT lang, sum(n_chars * 0.5) / sum(tokens) AS nll FROM t GROUP BY lang) SELECT sum(w * nll) AS nll, exp(sum(w * nll)) AS perplexity FROM s JOIN (VALUES ('en', 0.5), ('de', 0.2), ('fr', 0.2), ('es', 0.1)) v(lang, w) USING (lang)")
def mixture_nll(spark, sf_dir):
    return aggregates.mixture_loss(_records(spark, sf_dir), {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})


@query("bits_per_byte", f"WITH {_T} SELECT lang, sum(n_chars * 0.5) / ln(2) / sum(strlen(text)) AS bits, sum(strlen(text)) / sum(tokens) AS bytes_per_token FROM t GROUP BY lang")
def bits_per_byte(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars", F.octet_length("text").alias("b"), F.size(text.split_words(F.col("text"))).alias("k"))
    return docs.groupBy("lang").agg(numeric.bits_per_byte(F.sum(F.col("n_chars") * 0.5), F.sum("b")).alias("bits"), (F.sum("b") / F.sum("k")).alias("bytes_per_token"))


@query("weighted_bits", f"WITH {_T}, s AS (SELECT lang, sum(n_chars * 0.5) / ln(2) / sum(strlen(text)) AS bits FROM t GROUP BY lang) SELECT sum(w * bits) / sum(w) AS bits FROM s JOIN (VALUES ('en', 0.5), ('de', 0.2)) v(lang, w) USING (lang)")
def weighted_bits(spark, sf_dir):
    """Weights of the buckets that are there, rescaled."""
    weights = F.broadcast(spark.createDataFrame([("en", 0.5), ("de", 0.2)], "lang string, w double"))
    return bits_per_byte(spark, sf_dir).join(weights, "lang").agg((F.sum(F.col("w") * F.col("bits")) / F.sum("w")).alias("bits"))


@query(
    "bytes_per_token",
    r"""WITH k AS (SELECT lang, strlen(text) AS b, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, length(text) AS chars FROM documents)
    SELECT lang, sum(b) / sum(words) AS by_word, sum(b) / sum(chars) AS by_char, (sum(b) / sum(words)) / (sum(b) / sum(chars)) - 1 AS gain FROM k GROUP BY lang""",
)
def bytes_per_token(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("b"), F.size(text.split_words(F.col("text"))).alias("w"), F.length("text").alias("c"))
    by_word, by_char = F.sum("b") / F.sum("w"), F.sum("b") / F.sum("c")
    return docs.groupBy("lang").agg(by_word.alias("by_word"), by_char.alias("by_char"), (by_word / by_char - 1).alias("gain"))


@query(
    "tokenizer_adoption",
    """WITH v AS (SELECT s_name AS name, s_suppkey AS vocab, 4 + s_acctbal / 20000 AS mixture, 4 + s_nationkey / 50.0 AS benchmark FROM supplier),
    g AS (SELECT unnest([0.0, 0.02, 0.05, 5.0])::DOUBLE AS gain),
    c AS (SELECT g.gain, v.* FROM g, v, v AS o WHERE o.vocab = 0 AND v.vocab > 0 AND least(v.mixture / o.mixture - 1, v.benchmark / o.benchmark - 1) >= g.gain),
    l AS (SELECT gain, list({'name': name, 'mixture': mixture} ORDER BY vocab) AS l FROM c GROUP BY gain)
    SELECT g.gain, coalesce(list_reduce(l, lambda s, x: CASE WHEN x.mixture / s.mixture - 1 >= g.gain THEN x ELSE s END).name, (SELECT name FROM v WHERE vocab = 0)) AS chosen FROM g LEFT JOIN l USING (gain)""",
)
def tokenizer_adoption(spark, sf_dir):
    """Suppliers stand for vocabularies, the first for the one in use; the rule under four gains that it may ask for."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("vocab"), (4 + F.col("s_acctbal") / 20000).alias("mixture"), (4 + F.col("s_nationkey") / 50.0).alias("benchmark"))
    base = rows.where("vocab = 0").first()["name"]
    chosen = [decisions.adoption(rows, base, gain).select(F.lit(gain).alias("gain"), "chosen") for gain in (0.0, 0.02, 0.05, 5.0)]
    return reduce(DataFrame.unionByName, chosen)


@query("mixture_weights", "SELECT name, CASE WHEN name IN ('edu', 'dclm') THEN share + 0.2 / 2 ELSE share END AS share FROM (VALUES ('edu', 0.3), ('dclm', 0.3), ('wiki', 0.2)) v(name, share)")
def mixture_weights(spark, sf_dir):
    """The targeted share is split evenly over its pool."""
    shares = spark.createDataFrame([("edu", 0.3), ("dclm", 0.3), ("targeted", 0.2), ("wiki", 0.2)], "name string, share double")
    pool = ["edu", "dclm"]
    targeted = F.sum(F.when(F.col("name") == "targeted", F.col("share"))).over(Window.partitionBy(F.lit(1)))
    marked = shares.withColumn("t", targeted).where("name <> 'targeted'")
    return marked.select("name", F.when(F.col("name").isin(pool), F.col("share") + F.col("t") / len(pool)).otherwise(F.col("share")).alias("share"))


# ------------------------------------------------------------------- classifiers and thresholds

_L = "s AS (SELECT doc_id, lang, quality, n_chars, (n_chars % 997) / 997.0 AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("score", (F.col("n_chars") % 997) / 997.0)


@query(
    "auc_rank_sum",
    f"WITH {_L}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 9) AS auc FROM r",
)
def auc_rank_sum(spark, sf_dir):
    return aggregates.rank_auc(_scored(spark, sf_dir), "quality", "score").select(F.round("auc", 9).alias("auc"))


@query(
    "char_weighted_threshold",
    f"WITH {_L}, r AS (SELECT score, sum(n_chars) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER () AS total FROM s) SELECT max(score) AS threshold FROM r WHERE run >= 0.2 * total",
)
def char_weighted_threshold(spark, sf_dir):
    return aggregates.weighted_threshold(_scored(spark, sf_dir), "score", F.col("n_chars"), 0.2)


@query("route_targeted", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') AND (n_chars % 997) / 997.0 >= 0.5 THEN 'targeted' ELSE source END AS bucket, CASE WHEN source IN ('src0', 'src1') THEN (n_chars % 997) / 997.0 END AS score FROM documents")
def route_targeted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", ((F.col("n_chars") % 997) / 997.0).alias("s"))
    return learning.routed(docs, ["src0", "src1"], F.col("s"), 0.5).select("doc_id", "bucket", "score")


@query("classifier_score")
def classifier_score(spark, sf_dir):
    """A bag of one- and two-word grams; every document scored as the mean over all of its windows.

    The labelled texts are written once, as the fit reads them several times and would join them anew each time.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    model = learning.train_windows(written(labelled.select(text.words_and_marks(F.col("text")).alias("text"), "label")))
    return learning.document_scores(model, docs, "doc_id", limit=None)


# ------------------------------------------------------------------- multiple choice

_C = "i AS (SELECT l_orderkey AS item, l_linenumber AS line, l_extendedprice AS score, l_quantity AS length, l_partkey AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1), s AS (SELECT CASE item % 4 WHEN 0 THEN 'arc_easy' WHEN 1 THEN 'piqa' WHEN 2 THEN 'hellaswag' ELSE 'winogrande' END AS task, item, line AS idx, score, length, 1 + item % 3 AS label FROM i)"


def _choices(spark, sf_dir):
    """Orders stand for questions and lines for choices; one row for each."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_extendedprice", "l_partkey", "l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").withColumn("r", rank).where("r = 1")
    task = F.element_at(F.array(*map(F.lit, ("arc_easy", "piqa", "hellaswag", "winogrande"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return lines.select(
        task.alias("task"), F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("idx"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("length"), (1 + F.col("l_orderkey") % 3).alias("label")
    )


@query("mc_argmax", f"WITH {_C} SELECT item, idx, score FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, idx) = 1")
def mc_argmax(spark, sf_dir):
    return windows.best(_choices(spark, sf_dir), ["item"], F.col("score"), "idx").select("item", "idx", "score")


@query(
    "mc_accuracy",
    f"WITH {_C}, r AS (SELECT task, item, idx, label, row_number() OVER (PARTITION BY item ORDER BY score DESC, idx) AS a, row_number() OVER (PARTITION BY item ORDER BY score / greatest(length, 1) DESC, idx) AS b FROM s) SELECT task, count(*) FILTER (a = 1 AND idx = label) / count(DISTINCT item) AS acc, count(*) FILTER (b = 1 AND idx = label) / count(DISTINCT item) AS acc_norm, count(DISTINCT item) AS n FROM r GROUP BY task",
)
def mc_accuracy(spark, sf_dir):
    return choices.accuracy(_choices(spark, sf_dir))


@query(
    "results_table",
    f"WITH {_C}, r AS (SELECT task, item, idx, label, row_number() OVER (PARTITION BY item ORDER BY score DESC, idx) AS a FROM s), t AS (SELECT item % 3 AS run, task, count(*) FILTER (a = 1 AND idx = label) / count(DISTINCT item) AS acc FROM r GROUP BY 1, 2) SELECT run, task, round(acc, 9) AS acc FROM t UNION ALL SELECT run, 'mean', round(avg(acc), 9) FROM t GROUP BY run",
)
def results_table(spark, sf_dir):
    """Accuracy of each run by task, and the mean over the tasks; thirds of the questions stand for runs."""
    rows = _choices(spark, sf_dir).withColumn("run", F.col("item") % 3).withColumn("task", F.concat_ws("/", F.col("run").cast("string"), "task"))
    acc = choices.accuracy(rows).select(F.split_part("task", F.lit("/"), F.lit(1)).cast("long").alias("run"), F.split_part("task", F.lit("/"), F.lit(2)).alias("task"), "acc")
    return aggregates.with_means(acc, ["run"], "task", "acc").select("run", "task", F.round("acc", 9).alias("acc"))


@query("proxy_mean", f"WITH {_C}, r AS (SELECT task, item, idx, label, row_number() OVER (PARTITION BY item ORDER BY score DESC, idx) AS a FROM s), t AS (SELECT task, count(*) FILTER (a = 1 AND idx = label) / count(DISTINCT item) AS acc FROM r GROUP BY task) SELECT CASE WHEN count(*) = 4 THEN avg(acc) END AS proxy FROM t")
def proxy_mean(spark, sf_dir):
    return choices.proxy_mean(choices.accuracy(_choices(spark, sf_dir)))


@query("choice_ce", f"WITH {_C}, e AS (SELECT item, idx, label, score / 10000 AS score FROM s), m AS (SELECT *, max(score) OVER (PARTITION BY item) AS p FROM e) SELECT item, round(ln(sum(exp(score - p))) + min(p) - max(score) FILTER (idx = label), 6) AS loss FROM m GROUP BY item")
def choice_ce(spark, sf_dir):
    scaled = _choices(spark, sf_dir).withColumn("score", F.col("score") / 10000)
    return choices.choice_loss(scaled).select("item", F.round("loss", 6).alias("loss"))


@query(
    "question_formatting",
    r"""SELECT conv_id, turn, 'Question: ' || text || chr(10) || 'Answer:' AS context, ' ' || role AS continuation FROM conversations""",
)
def question_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    pairs = rows.select("conv_id", "turn", F.explode(choices.question_pairs(F.col("text"), F.array("role"))).alias("p"))
    return pairs.select("conv_id", "turn", "p.context", "p.continuation")


def _cleaned(x: str) -> str:
    return rf"replace(regexp_replace(replace(trim({x}, ' ' || chr(10)), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')"


@query(
    "activity_formatting",
    f"""SELECT conv_id, turn, {_cleaned("role || ': ' || text || ' ' || upper('m') || lower('X [note] ' || role)")} AS context, ' ' || {_cleaned("text || ' [title] a'")} AS continuation FROM conversations""",
)
def activity_formatting(spark, sf_dir):
    """An activity, two parts of a context and an ending, with notes and titles cleaned."""
    ctx_b = F.concat(F.lit("mX [note] "), F.col("role"))
    pairs = choices.activity_pairs(F.col("role"), F.col("text"), ctx_b, F.array(F.concat("text", F.lit(" [title] a"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(pairs).alias("p")).select("conv_id", "turn", "p.context", "p.continuation")


@query(
    "blank_formatting",
    "SELECT item_id, unnest([substr(text, 1, 20) || 'Ann', substr(text, 1, 20) || 'Bob']) AS context, ' ' || trim(substr(text, 21)) AS continuation FROM benchmark",
)
def blank_formatting(spark, sf_dir):
    """A blank behind twenty characters, filled by either name; what follows is scored."""
    sentence = F.concat(F.substring("text", 1, 20), F.lit("_"), F.expr("substr(text, 21)"))
    pairs = choices.blank_pairs(sentence, F.array(F.lit("Ann"), F.lit("Bob")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.context", "p.continuation")


_KEYS = "['A', 'B', 'C', 'D']"
_EXAMPLES = f"""WITH w AS (SELECT item_id AS i, text AS t, string_split(text, ' ') AS w FROM benchmark),
    a AS (SELECT unnest(['arc_easy', 'arc_challenge', 'commonsense_qa']) AS task, i, t, w, i % 4 AS k FROM w UNION ALL SELECT 'openbookqa', i, t, w, (i + 1) % 4 FROM w),
    e AS (SELECT task, t AS context, w[k + 1] AS answer, k AS label, 3 AS n FROM a WHERE k < 3
    UNION ALL SELECT 'piqa', t, w[i % 3 + 1], i % 3, 2 FROM w WHERE i % 3 < 2
    UNION ALL SELECT 'hellaswag', t, w[i % 4 + 1], i % 4, 4 FROM w WHERE i % 5 <> 0
    UNION ALL SELECT 'sciq', CASE WHEN i % 2 = 1 THEN w[4] || chr(10) || t ELSE t END, w[4], 3, 4 FROM w
    UNION ALL SELECT 'social_i_qa', w[1] || ' ' || t, w[i % 5], i % 5 - 1, 3 FROM w WHERE i % 5 BETWEEN 1 AND 3),
    x AS (SELECT task, context, trim(answer, ' ' || chr(10)) AS answer, label, n, context || ' ' || trim(answer, ' ' || chr(10)) AS text FROM e WHERE answer <> ''
    UNION ALL SELECT 'winogrande', w[1], CASE WHEN i % 3 = 1 THEN w[2] ELSE w[3] END || substr(t, length(w[1]) + 2), i % 3 - 1, 2, w[1] || CASE WHEN i % 3 = 1 THEN w[2] ELSE w[3] END || substr(t, length(w[1]) + 2) FROM w WHERE i % 3 > 0)"""


@query("benchmark_examples", f"{_EXAMPLES} SELECT task, context, answer, label::INT AS label, n::INT AS n, text FROM x")
def benchmark_examples(spark, sf_dir):
    """All nine sets in one form; benchmark items stand for their rows, some of them unusable."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("t"), F.split("text", " ").alias("w"))

    def word(n: int):
        return F.try_element_at("w", F.lit(n))

    def keyed(shift: int):
        key = F.element_at(F.array(*map(F.lit, "ABCD")), ((F.col("i") + shift) % 4 + 1).cast("int"))
        return key.alias("answerKey"), F.struct(F.array(*map(F.lit, "ABC")).alias("label"), F.slice("w", 1, 3).alias("text")).alias("choices")

    arc = rows.select(F.col("t").alias("question"), *keyed(0))
    sets = {
        "arc_easy": arc,
        "arc_challenge": arc,
        "commonsense_qa": arc,
        "openbookqa": rows.select(F.col("t").alias("question_stem"), *keyed(1)),
        "piqa": rows.select(F.col("t").alias("goal"), word(1).alias("sol1"), word(2).alias("sol2"), (F.col("i") % 3).alias("label")),
        "hellaswag": rows.select(F.col("t").alias("ctx"), F.slice("w", 1, 4).alias("endings"), F.when(F.col("i") % 5 != 0, (F.col("i") % 4).cast("string")).otherwise("").alias("label")),
        "winogrande": rows.select(F.concat(word(1), F.lit("_"), F.expr("substr(t, length(w[0]) + 2)")).alias("sentence"), word(2).alias("option1"), word(3).alias("option2"), (F.col("i") % 3).cast("string").alias("answer")),
        "sciq": rows.select(F.when(F.col("i") % 2 == 1, F.concat(F.lit(" "), word(4), F.lit(" "))).otherwise("").alias("support"), F.col("t").alias("question"), *(word(n).alias(f"distractor{n}") for n in (1, 2, 3)), word(4).alias("correct_answer")),
        "social_i_qa": rows.select(word(1).alias("context"), F.col("t").alias("question"), *(word(n).alias(f"answer{c}") for n, c in enumerate("ABC", 1)), (F.col("i") % 5).cast("string").alias("label")),
    }
    return choices.examples(sets).select("task", "context", "answer", "label", F.size("choices").alias("n"), "text")


@query(
    "boundary_pairs",
    r"""WITH c AS (SELECT item_id, text || repeat(' ', (item_id % 4)::INT) AS c, substr(text, 1, 5) AS k FROM benchmark)
    SELECT item_id, regexp_replace(c, '\s+$', '') AS context, substr(c, length(regexp_replace(c, '\s+$', '')) + 1) || k AS continuation, length(c) - length(regexp_replace(c, '\s+$', '')) AS moved FROM c""",
)
def boundary_pairs(spark, sf_dir):
    """Contexts that end with none to three blanks, and the text's first characters as continuation."""
    context = F.concat(F.col("text"), F.repeat(F.lit(" "), (F.col("item_id") % 4).cast("int")))
    pair = choices.boundary_pair(context, F.substring("text", 1, 5))
    rows = table(spark, sf_dir, "benchmark").select("item_id", context.alias("c"), pair.alias("p"))
    return rows.select("item_id", "p.context", "p.continuation", (F.length("c") - F.length("p.context")).cast("long").alias("moved"))


_VERIFY = """WITH q AS (SELECT role AS task, conv_id, turn, text, length(text) AS n FROM conversations),
    a AS (SELECT *, 'Question: ' || text || chr(10) || 'Answer:' AS context, ' ' || task AS continuation, n / 8.0 AS score FROM q WHERE conv_id % 7 <> 0),
    b AS (SELECT *, 'Question: ' || text || chr(10) || 'Answer:' AS context, CASE WHEN conv_id % 5 = 0 THEN task ELSE ' ' || task END AS continuation, n / 8.0 + CASE WHEN turn = 1 THEN 0.25 ELSE 0 END AS score FROM q WHERE turn <> 2)"""


@query(
    "formatter_check",
    f"""{_VERIFY} SELECT coalesce(a.task, b.task) AS task, count(*) AS requests, count(*) FILTER (a.task IS NOT NULL AND b.task IS NOT NULL AND (a.context <> b.context OR a.continuation <> b.continuation)) AS mismatches,
    count(*) FILTER (a.task IS NULL OR b.task IS NULL) AS gaps, max(abs(a.score - b.score)) AS worst
    FROM a FULL JOIN b ON a.task = b.task AND a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY 1""",
)
def formatter_check(spark, sf_dir):
    """Two recordings of the same requests, joined: one lacks conversations, the other turns; some continuations and scores differ."""
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("task"), "conv_id", "turn", F.explode(choices.question_pairs(F.col("text"), F.array("role"))).alias("p"), (F.length("text") / 8.0).alias("score"))
    rows = rows.select("task", "conv_id", "turn", "p.context", "p.continuation", "score")
    made = rows.where("turn <> 2").withColumn("continuation", F.when(F.col("conv_id") % 5 == 0, F.col("task")).otherwise(F.col("continuation")))
    made = made.withColumn("score", F.col("score") + F.when(F.col("turn") == 1, 0.25).otherwise(0.0))
    return choices.verified_requests(rows.where("conv_id % 7 <> 0"), made, ["task", "conv_id", "turn"])


@query(
    "gold_losses",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS pos, -(l_quantity / 50.0) AS logp, CASE l_orderkey % 2 WHEN 0 THEN 'piqa' ELSE 'arc_easy' END AS task, 1 + l_orderkey % 3 AS label FROM lineitem), g AS (SELECT * FROM t WHERE l_linenumber = label) SELECT 'sequence' AS scope, task, round(-sum(logp) / count(*), 9) AS loss, count(*) AS tokens FROM g GROUP BY task UNION ALL SELECT 'continuation', task, round(-sum(logp) / count(*), 9), count(*) FROM g WHERE pos >= 2 GROUP BY task",
)
def gold_losses(spark, sf_dir):
    """Lines stand for tokens of choices: the loss over the gold choice's tokens, all of them or its answer's alone."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 2 == 0, "piqa").otherwise("arc_easy").alias("task"), F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("idx"), (1 + F.col("l_orderkey") % 3).alias("label"),
        (F.col("l_partkey") % 4 >= 2).alias("in_continuation"), (-F.col("l_quantity") / 50.0).alias("logp"),
    )
    parts = [choices.gold_loss(rows, scope).select(F.lit(scope).alias("scope"), "task", F.round("loss", 9).alias("loss"), "tokens") for scope in ("sequence", "continuation")]
    return reduce(DataFrame.unionByName, parts)


@query("model_scores")
def model_scores(spark, sf_dir):
    """Items longest first through an injected scorer; a stub whose score is the share of vowels stands for the model."""
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return learning.scored_by(items, "text", learning.vowel_share, "conv_id long, turn long")


@query(
    "document_nll",
    r"""WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS t FROM documents)
    SELECT doc_id, round(coalesce(list_sum(list_transform(list_slice(t, 2, len(t)), lambda x: (x % 97) / 97.0)), 0), 6) AS nll_sum, greatest(len(t) - 1, 0)::BIGINT AS token_count FROM t""",
)
def document_nll(spark, sf_dir):
    """Word lengths stand for ids; the windows of 256 that overlap by half count every target once, as SQL does without windows."""
    ids = F.transform(text.split_words(F.col("text")), lambda w: F.length(w))
    scored = learning.document_nll(table(spark, sf_dir, "documents"), "doc_id", ids, learning.unigram_loss, 256, 128)
    return scored.select("doc_id", F.round("nll_sum", 6).alias("nll_sum"), "token_count")


# ------------------------------------------------------------------- decisions and reports


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("run"), (F.col("s_acctbal") / 10000).alias("proxy"), (F.col("s_nationkey") / 25.0).alias("wiki"), F.col("s_suppkey").alias("idx"))


_R = "r AS (SELECT s_name AS run, s_acctbal / 10000 AS proxy, s_nationkey / 25.0 AS wiki, s_suppkey AS idx FROM supplier)"


@query("select_challenger", f"WITH {_R}, a AS (SELECT * FROM r WHERE idx = 0), b AS (SELECT * FROM r WHERE idx = 1) SELECT CASE WHEN b.proxy - a.proxy >= 0.005 - 1e-12 AND b.wiki - a.wiki <= 0.01 + 1e-12 THEN b.run ELSE a.run END AS selected, b.proxy - a.proxy AS gain, b.wiki - a.wiki AS change FROM a, b")
def select_challenger(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    return decisions.challenger(rows.where("idx = 0"), rows.where("idx = 1").select("run", "proxy", "wiki"))


@query(
    "select_guarded_best",
    f"WITH {_R}, p AS (SELECT * FROM r WHERE idx = 0), e AS (SELECT r.* FROM r, p WHERE r.idx > 0 AND r.wiki - p.wiki <= 0.01 + 1e-12 ORDER BY r.proxy DESC, r.idx LIMIT 1) SELECT CASE WHEN e.proxy - p.proxy >= 0.02 - 1e-12 THEN e.run ELSE p.run END AS selected, e.run AS best, e.proxy - p.proxy AS gain FROM p LEFT JOIN e ON true",
)
def select_guarded_best(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    return decisions.guarded_best(rows.where("idx = 0"), rows.where("idx > 0"), 0.02, 0.01)


@query("select_no_worse", f"WITH {_R}, p AS (SELECT * FROM r WHERE idx = 2), e AS (SELECT r.* FROM r, p WHERE r.idx <> 2 AND r.wiki <= p.wiki + 1e-12 ORDER BY r.proxy DESC, r.idx LIMIT 1) SELECT CASE WHEN e.proxy - p.proxy >= 0.01 - 1e-12 THEN e.run ELSE p.run END AS selected, e.run AS best, e.proxy - p.proxy AS gain FROM p LEFT JOIN e ON true")
def select_no_worse(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    return decisions.guarded_best(rows.where("idx = 2"), rows.where("idx <> 2"), 0.01, 0.0)


@query("three_way_rule", f"WITH {_R} SELECT a.idx, CASE WHEN b.proxy > a.proxy AND b.wiki <= a.wiki THEN 'V2' WHEN b.proxy <= a.proxy AND b.wiki > a.wiki THEN 'V1' ELSE 'USER_DECIDES' END AS outcome, CASE WHEN b.proxy >= a.proxy THEN 'GO' ELSE 'NO_GO' END AS gate FROM r a JOIN r b ON b.idx = a.idx + 1")
def three_way_rule(spark, sf_dir):
    a = _runs(spark, sf_dir)
    b = a.select((F.col("idx") - 1).alias("idx"), F.col("proxy").alias("bp"), F.col("wiki").alias("bw"))
    return a.join(b, "idx").select(
        "idx", decisions.three_way(F.col("proxy"), F.col("wiki"), F.col("bp"), F.col("bw")).alias("outcome"), decisions.go(F.col("bp"), F.col("proxy")).alias("gate")
    )


_M = "m AS (SELECT o_orderkey AS k, o_totalprice AS s, o_orderkey % 7 AS n, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / (o_orderkey % 7) / 1000000 * CASE WHEN o_orderkey % 3 = 0 THEN 1.000001 ELSE 1 END END AS nll FROM orders)"


@query(
    "metric_acceptance",
    f"""WITH {_M}, p AS (SELECT *, exp(nll) * CASE WHEN k % 5 = 0 THEN 1.001 ELSE 1 END AS ppl FROM m)
    SELECT k AS o_orderkey, coalesce(n > 0 AND abs(nll - s / 1000000 / n) <= 1e-9 * greatest(abs(nll), abs(s / 1000000 / n)) AND abs(ln(ppl) - nll) <= 1e-9 * greatest(abs(ln(ppl)), abs(nll)), false) AS accepted FROM p""",
)
def metric_acceptance(spark, sf_dir):
    """Sums, counts, quotients and perplexities of which some do not fit: no count, a quotient or a perplexity that is off."""
    key, s = F.col("o_orderkey"), F.col("o_totalprice")
    n = key % 7
    off = F.when(key % 3 == 0, 1.000001).otherwise(1.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (s / 1000000).alias("s"), n.alias("n"), F.when(n > 0, s / F.nullif(n, F.lit(0).cast("long")) / 1000000 * off).alias("nll"))
    ppl = F.exp("nll") * F.when(key % 5 == 0, 1.001).otherwise(1.0)
    return rows.select("o_orderkey", decisions.consistent(F.col("s"), F.col("n"), F.col("nll"), ppl).alias("accepted"))


def _check_sql(*checks: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CASE WHEN bool_and(coalesce({rule}, false)) THEN 'PASS' ELSE 'FAIL' END AS status FROM documents" for name, rule in checks)


_CHECKS = (("ids", "doc_id IS NOT NULL"), ("chars", "n_chars = length(text)"), ("long", "length(text) > 100"), ("languages", "lang IN ('en', 'de', 'fr', 'es')"), ("english", "lang = 'en'"), ("even", "n_chars % 2 = 0 OR n_chars % 2 = 1"))


@query("integrity_checklist", _check_sql(*_CHECKS))
def integrity_checklist(spark, sf_dir):
    """Rules over all documents, of which some hold and some do not."""
    return decisions.checklist(table(spark, sf_dir, "documents"), *((name, F.expr(rule)) for name, rule in _CHECKS))


@query(
    "selection_gate",
    """SELECT s_name AS run, CASE WHEN s_nationkey % 3 <> 0 THEN 'other_panel' WHEN s_acctbal < 0 THEN 'official_scores_used' WHEN s_suppkey % 5 = 1 THEN 'not_listed'
    WHEN s_suppkey % 4 = 2 THEN 'weights_changed' ELSE 'accepted' END AS status FROM supplier""",
)
def selection_gate(spark, sf_dir):
    """Suppliers stand for selection records: some of another panel, with official scores, without weights or with changed ones."""
    rows = table(spark, sf_dir, "supplier")
    hashed = F.md5("s_name")
    records = rows.select(F.col("s_name").alias("run"), F.when(F.col("s_nationkey") % 3 == 0, "selection").otherwise("monitor").alias("panel"), (F.col("s_acctbal") < 0).alias("official_used"), hashed.alias("hash"))
    weights = rows.where("s_suppkey % 5 <> 1").select(F.col("s_name").alias("run"), F.when(F.col("s_suppkey") % 4 == 2, F.md5(F.concat("s_name", F.lit("x")))).otherwise(hashed).alias("hash"))
    return decisions.gate(records, weights)


@query(
    "soup_recipes",
    """WITH m AS (SELECT s_name AS run, s_suppkey AS i FROM supplier), x AS (SELECT p.run AS selected, q.i FROM m p JOIN m q ON q.i // 10 = p.i // 10 AND q.i <> p.i WHERE p.i % 10 = 0 UNION ALL SELECT run, i FROM m WHERE i % 10 = 3)
    SELECT selected AS run, 'config' || i % 3 AS config, 'arm' || i % 2 AS arm, list_sort(list(DISTINCT i % 5)) AS epochs, max(i % 5) AS last FROM x GROUP BY 1, 2, 3""",
)
def soup_recipes(spark, sf_dir):
    """Every tenth supplier stands for a soup of the nine behind it, every fourth of ten for a single run: the recipes to be run again."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("run"), F.col("s_suppkey").alias("i"))
    names = rows.select(F.col("run").alias("soup"), F.col("i").alias("j"))
    members = names.where("j % 10 = 0").join(rows, (F.floor(F.col("i") / 10) == F.floor(F.col("j") / 10)) & (F.col("i") != F.col("j"))).select("soup", "run")
    recipes = rows.select("run", F.concat(F.lit("config"), F.col("i") % 3).alias("config"), F.concat(F.lit("arm"), F.col("i") % 2).alias("arm"), (F.col("i") % 5).alias("epoch"))
    made = decisions.expanded(rows.where("i % 10 IN (0, 3)").select("run"), members, recipes)
    return made.groupBy("run", "config", "arm").agg(F.array_sort(F.collect_set("epoch")).alias("epochs"), F.max("epoch").alias("last"))


@query("final_fallback", f"WITH {_R} SELECT a.idx, CASE WHEN b.wiki <= a.wiki + 0.01 + 1e-12 THEN b.run ELSE a.run END AS selected FROM r a LEFT JOIN r b ON b.idx = a.idx + 1")
def final_fallback(spark, sf_dir):
    """Each run against the next: the next where it keeps the guard, the run itself where it does not or is not there."""
    a = _runs(spark, sf_dir).select("idx", "run", "wiki")
    b = a.select((F.col("idx") - 1).alias("idx"), F.col("run").alias("next"), F.col("wiki").alias("w"))
    guard = F.col("w") <= F.col("wiki") + 0.01 + decisions.TOLERANCE
    return a.join(b, "idx", "left").select("idx", decisions.final_choice(F.col("next"), F.col("run"), guard).alias("selected"))


@query("recipe_epochs", "SELECT l_returnflag AS config, l_linestatus AS arm, list_sort(list(DISTINCT l_linenumber)) AS epochs, max(l_linenumber) AS last FROM lineitem GROUP BY ALL")
def recipe_epochs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("epoch"))
    return decisions.recipe(rows)


@query(
    "lineage_recursive",
    "WITH RECURSIVE v AS (SELECT n_nationkey AS child, CASE WHEN n_nationkey >= 5 THEN n_nationkey // 2 END AS parent FROM nation), up AS (SELECT child, parent AS ancestor, 1 AS depth FROM v WHERE parent IS NOT NULL UNION ALL SELECT up.child, v.parent, up.depth + 1 FROM up JOIN v ON v.child = up.ancestor WHERE v.parent IS NOT NULL) SELECT * FROM up",
)
def lineage_recursive(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS child", "CASE WHEN n_nationkey >= 5 THEN n_nationkey div 2 END AS parent")
    rows.createOrReplaceTempView("quern_lineage")
    return decisions.lineage(spark, "quern_lineage", "child", "parent")


_P = "p AS (SELECT s_nationkey AS model, 'w' AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS idx, s_acctbal AS value FROM supplier)"


def _parameters(spark, sf_dir):
    idx = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("model"), F.lit("w").alias("name"), idx.alias("idx"), F.col("s_acctbal").alias("value"))


@query("parameter_soup", f"WITH {_P}, m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM p GROUP BY model)) SELECT name, idx, round(avg(value), 6) AS value FROM p WHERE idx <= (SELECT least FROM m) GROUP BY ALL")
def parameter_soup(spark, sf_dir):
    rows = _parameters(spark, sf_dir)
    least = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    same = rows.crossJoin(F.broadcast(least)).where("idx <= least")
    return aggregates.parameter_mean(same).select("name", "idx", F.round("value", 6).alias("value"))


@query("interpolation", "SELECT 'w' AS name, c_custkey AS idx, 0.7 * c_acctbal + 0.3 * (c_acctbal + c_nationkey) AS value FROM customer")
def interpolation(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("w").alias("name"), F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))
    b = table(spark, sf_dir, "customer").select(F.lit("w").alias("name"), F.col("c_custkey").alias("idx"), (F.col("c_acctbal") + F.col("c_nationkey")).alias("value"))
    return aggregates.interpolate(a, b, 0.3)


@query("greedy_soup")
def greedy_soup(spark, sf_dir):
    """Candidates by rank join the mean while a trial score does not fall; the score is closeness to a goal."""
    rows = _runs(spark, sf_dir).orderBy(F.col("proxy").desc(), "idx")
    return learning.greedy_soup(rows, goal=0.8)


@query("standard_errors", "SELECT l_returnflag AS task, avg((l_quantity > 25)::INT) AS acc, stddev_samp((l_quantity > 25)::INT) / sqrt(count(*)) AS acc_stderr FROM lineitem GROUP BY ALL")
def standard_errors(spark, sf_dir):
    hit = (F.col("l_quantity") > 25).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.avg(hit).alias("acc"), (F.stddev_samp(hit) / F.sqrt(F.count(F.lit(1)))).alias("acc_stderr"))


@query("protocol_join", "SELECT d.task, coalesce(m.n, 0) AS n, m.n IS NOT NULL AND m.n >= d.least AS complete FROM (VALUES ('AUTOMOBILE', 1), ('BUILDING', 1), ('MISSING', 1)) d(task, least) LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) m ON m.c_mktsegment = d.task")
def protocol_join(spark, sf_dir):
    """Every task of the protocol has a result, with enough samples."""
    protocol = F.broadcast(spark.createDataFrame([("AUTOMOBILE", 1), ("BUILDING", 1), ("MISSING", 1)], "task string, least int"))
    results = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    joined = protocol.join(results, "task", "left")
    return joined.select("task", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") >= F.col("least"), F.lit(False)).alias("complete"))


@query("comparison_pivot", "SELECT o_orderstatus AS model, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ALL")
def comparison_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.avg("o_totalprice"))
    return rows.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("corpus_table", "SELECT source, tokens, tokens / sum(tokens) OVER () AS share, rank() OVER (ORDER BY tokens DESC)::INT AS place FROM (SELECT source, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY source)")
def corpus_table(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens"))
    return aggregates.shares(sums, "tokens").withColumn("place", F.rank().over(Window.orderBy(F.col("tokens").desc())))


@query("history_table", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN printf('%.6f', s_acctbal) ELSE '-' END AS score FROM supplier")
def history_table(spark, sf_dir):
    shown = F.coalesce(F.when(F.col("s_acctbal") > 0, F.format_string("%.6f", "s_acctbal")), F.lit("-"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", shown.alias("score"))


@query("tradeoff_points", r"SELECT p_partkey, regexp_extract(p_brand, '#(\d+)', 1)::INT / 100.0 AS alpha, p_retailprice - (SELECT min(p_retailprice) FROM part) AS change FROM part")
def tradeoff_points(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    base = parts.agg(F.min("p_retailprice").alias("base"))
    return parts.crossJoin(F.broadcast(base)).select("p_partkey", (F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int") / 100.0).alias("alpha"), (F.col("p_retailprice") - F.col("base")).alias("change"))


@query("training_curve", "SELECT user_id, event_id, avg(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS smoothed FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)")
def training_curve(spark, sf_dir):
    rows = windows.last_write(table(spark, sf_dir, "events"), ["user_id", "ts"], "event_id")
    rows = rows.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return rows.select("user_id", "event_id", windows.moving_average("cents", ["user_id"], "event_id").alias("smoothed"))


@query("key_numbers", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM benchmark) AS items")
def key_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))
    return docs.crossJoin(table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("items")))
