"""Normalisation, digests, splits, cleaners and other scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.functions import numeric, text
from quern.operators import filters
from quern.plans.base import normal, query, table, words
from quern.runtime import spread


@query("normalize_digest", f"SELECT doc_id, sha256({normal('text')}) AS digest FROM documents")
def normalize_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.digest(text.normalize(F.col("text"))).alias("digest"))


@query("normalize_exact")
def normalize_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.digest(text.normalize_exact(F.col("text"))).alias("digest"))


_NAMES = "['" + "','".join(text.HELD_OUT_SPLITS) + "']"
_PANELS = "['" + "','".join(text.PANELS) + "']"
_BUCKET = f"(('0x' || substr(sha256({normal('text')}), 1, 16))::UBIGINT % {{0}})::INT"


@query("split_assignment", f"SELECT doc_id, CASE WHEN b < 9 THEN list_extract({_NAMES}, b + 1) ELSE 'train' END AS split FROM (SELECT doc_id, {_BUCKET.format(100)} AS b FROM documents)")
def split_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.split_of(text.digest(text.normalize(F.col("text")))).alias("split"))


@query("panel_assignment", f"SELECT doc_id, CASE WHEN b < 4 THEN list_extract({_PANELS}, b + 1) END AS panel FROM (SELECT doc_id, {_BUCKET.format(1000)} AS b FROM documents)")
def panel_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.panel_of(text.digest(text.normalize(F.col("text")))).alias("panel"))


@query("dev_holdout", r"SELECT item_id, ('0x' || substr(sha256('benchmark' || chr(10) || text), 1, 8))::UBIGINT % 1000 < 200 AS development FROM benchmark")
def dev_holdout(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.is_development(F.lit("benchmark"), F.col("text")).alias("development"))


@query("half_split", r"SELECT conv_id, turn, (('0x' || substr(sha256('[' || role || ',' || text || ']'), 1, 8))::UBIGINT % 2)::INT AS half FROM conversations")
def half_split(spark, sf_dir):
    """Two stable halves of the items, by the digest of their compact form."""
    item = F.concat(F.lit("["), F.col("role"), F.lit(","), F.col("text"), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.digest_bucket(F.sha2(item, 256), 2, digits=8).alias("half"))


@query("word_tokens", f"SELECT doc_id, len(w) AS n, w[1] AS first, w[-1] AS last FROM (SELECT doc_id, {words(normal('text'))} AS w FROM documents)")
def word_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words(text.normalize(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.try_element_at("w", F.lit(1)).alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"))


@query("overlap_words", f"SELECT conv_id, turn, len(list_distinct({words('lower(text)')})) AS n FROM conversations")
def overlap_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_distinct(text.words(F.lower("text")))).cast("long").alias("n"))


@query("classifier_normalize", r"SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text),'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'),' ')) AS h FROM documents")
def classifier_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.words_and_marks(F.col("text"))).alias("h"))


@query(
    "word_windows",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text),'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents),
    n AS (SELECT doc_id, w, ceil(len(w) / 60.0)::INT AS n FROM w WHERE len(w) > 0),
    i AS (SELECT doc_id, w, n, unnest(range(least(n, 64))) AS i FROM n)
    SELECT doc_id, i::INT AS i, md5(array_to_string(list_slice(w, 60 * floor(i * greatest(n / 64.0, 1))::INT + 1, 60 * floor(i * greatest(n / 64.0, 1))::INT + 60), ' ')) AS h FROM i""",
)
def word_windows(spark, sf_dir):
    windows = text.word_windows(text.word_and_mark_list(F.col("text")))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(windows).alias("i", "w"))
    return rows.select("doc_id", "i", F.md5("w").alias("h"))


@query(
    "clean_threads",
    r"""WITH t AS (SELECT item_id, '(Asked by: username_' || item_id || ' on 2020-01-01)' || chr(10) || text || chr(10) || chr(10) || chr(10) || '### Answer by username_7 on x' || chr(10) || '**username_9**: yes ' AS t FROM benchmark)
    SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\(Asked by: username_\d+ on [^)]*\)\s*$', '', 'g'), '(?m)^### Answer by username_\d+ on [^\n]*$', '### Answer', 'g'), '\*\*username_\d+\*\*:?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9) || chr(13)) AS cleaned FROM t""",
)
def clean_threads(spark, sf_dir):
    thread = F.concat(
        F.lit("(Asked by: username_"), F.col("item_id"), F.lit(" on 2020-01-01)\n"), F.col("text"), F.lit("\n\n\n### Answer by username_7 on x\n**username_9**: yes ")
    )
    return table(spark, sf_dir, "benchmark").select("item_id", text.clean_thread(thread).alias("cleaned"))


@query(
    "clean_books",
    r"SELECT item_id, trim(replace(text, chr(13) || chr(10), chr(10)), chr(10) || ' ' || chr(9) || chr(13)) AS body FROM benchmark",
)
def clean_books(spark, sf_dir):
    """Items wrapped in a book's front and back matter come out as they were."""
    wrapped = F.concat(F.lit("front\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), F.col("text"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nback"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.clean_book(wrapped).alias("body"))


@query("paragraph_chunks")
def paragraph_chunks(spark, sf_dir):
    paragraphs = F.regexp_replace("text", "\n", "\n\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraph_chunks(paragraphs, 1000)).alias("i", "chunk"))
    return rows.select("doc_id", "i", F.length("chunk").alias("chars"), F.md5("chunk").alias("h"))


@query(
    "clean_endings",
    r"SELECT item_id, replace(regexp_replace(replace(trim(' ' || text || ' [title] a  [note] b   c', ' ' || chr(10)), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS cleaned FROM benchmark",
)
def clean_endings(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.clean_ending(F.concat(F.lit(" "), F.col("text"), F.lit(" [title] a  [note] b   c"))).alias("cleaned"))


@query("capitalized", "SELECT item_id, upper(substr(text, 1, 1)) || lower(substr(text, 2)) AS capitalized FROM benchmark")
def capitalized(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.capitalize(F.col("text")).alias("capitalized"))


@query("article_titles", r"SELECT page_id, regexp_extract(' = ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) || ' = ', '^\s*=\s+([^=]+?)\s+=\s*$', 1) AS title FROM pages")
def article_titles(spark, sf_dir):
    heading = F.concat(F.lit(" = "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit(" = "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(heading, text.ARTICLE_TITLE, 1).alias("title"))


@query("utf8_bytes", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def utf8_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


@query(
    "lr_schedules",
    f"""WITH s AS (SELECT range AS step FROM range(200))
    SELECT step,
      CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos({math.pi!r} * least(1.0, (step - 20) / 179.0)))) END AS cosine,
      CASE WHEN step < 10 THEN 0.0001 + (0.0005 - 0.0001) * (step / 9.0) ELSE 0.0005 * (0.1 + 0.9 * 0.5 * (1 + cos({math.pi!r} * least(1.0, (step - 10) / 189.0)))) END AS rewarm,
      CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 WHEN step < 150 THEN 0.001 ELSE 0.001 * (1 - 0.9 * least(1.0, (step - 149) / 40.0)) END AS stable_decay,
      CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 ELSE 0.001 * greatest(0.0, 1 - (step - 19) / 180.0) END AS linear
    FROM s""",
)
def lr_schedules(spark, sf_dir):
    step = F.col("step")
    return spark.range(200).withColumnRenamed("id", "step").select(
        "step",
        numeric.warmup_cosine(step, 200, 0.001, 0.1, 0.1).alias("cosine"),
        numeric.rewarm_cosine(step, 200, 0.0001, 0.0005, 10, 0.1).alias("rewarm"),
        numeric.warmup_stable_decay(step, 0.001, 20, 0.1, 150, 40).alias("stable_decay"),
        numeric.warmup_linear(step, 200, 0.001, 20).alias("linear"),
    )


@query("parameter_breakdown", "SELECT 16384::BIGINT * d AS embeddings, l * 4 * d * d AS attention, l * 3 * d * f AS feed_forward, l * 2 * d + d AS norms, 16384 * d + l * (4 * d * d + 3 * d * f + 2 * d) + d AS total FROM (SELECT 512::BIGINT AS d, 1408::BIGINT AS f, 12::BIGINT AS l)")
def parameter_breakdown(spark, sf_dir):
    """Analytic parameter count of a decoder with tied embeddings, from its configuration."""
    config = spark.createDataFrame([(16384, 512, 1408, 12)], "v long, d long, f long, l long")
    parts = {"embeddings": "v * d", "attention": "l * 4 * d * d", "feed_forward": "l * 3 * d * f", "norms": "l * 2 * d + d"}
    made = config.select(*(F.expr(e).alias(n) for n, e in parts.items()))
    return made.withColumn("total", F.expr(" + ".join(parts)))


@query("props_json", """SELECT event_id, (props->>'$.k')::INT AS k, '{"k":' || (props->>'$.k') || '}' AS compact FROM events""")
def props_json(spark, sf_dir):
    parsed = F.from_json("props", "k INT")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("compact"))


@query("perplexities", "SELECT doc_id, CASE WHEN n_chars / 10.0 < 709 THEN exp(n_chars / 10.0) END AS perplexity, n_chars / ln(2) / strlen(text) AS bits FROM documents")
def perplexities(spark, sf_dir):
    nll = F.col("n_chars") / 10.0
    return table(spark, sf_dir, "documents").select(
        "doc_id", numeric.perplexity(nll).alias("perplexity"), numeric.bits_per_byte(F.col("n_chars"), F.octet_length("text")).alias("bits")
    )


_TOKENS = "list_transform({0}, lambda x: length(x))"


@query(
    "token_filters",
    f"WITH t AS (SELECT item_id, {_TOKENS.format(words(normal('text')))} AS t FROM benchmark) SELECT item_id, len(list_filter(t, lambda x: x > 3)) AS kept, len(list_filter(t, lambda x: x >= 12)) = 0 AS valid, CASE WHEN len(t) > 16 THEN 16 ELSE len(t) END AS n, CASE WHEN len(t) > 16 THEN 2 ELSE t[-1] END AS last FROM t",
)
def token_filters(spark, sf_dir):
    """Word lengths stand for token ids: special ids stripped, ids within the vocabulary, truncation with a closing id."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.transform(text.words(text.normalize(F.col("text"))), lambda w: F.length(w)).alias("t"))
    cut = filters.truncate_tokens(F.col("t"), 16, 2)
    return rows.select(
        "item_id",
        F.size(filters.without_special(F.col("t"))).cast("long").alias("kept"),
        filters.tokens_valid(F.col("t"), 12).alias("valid"),
        F.size(cut).cast("long").alias("n"),
        F.element_at(cut, -1).cast("long").alias("last"),
    )


@query("metric_guards", "SELECT c_custkey, c_acctbal >= 0 AND c_acctbal <= 5000 AS good FROM customer")
def metric_guards(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.safe_nll(F.col("c_acctbal"), 0, 5000).alias("good"))


@query("provenance", "SELECT doc_id AS id, source, lang, n_chars AS chars FROM documents")
def provenance(spark, sf_dir):
    """The record of a document without its text; the scan never reads the text column."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.col("n_chars").alias("chars"))


@query("site_allowlist", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def site_allowlist(spark, sf_dir):
    allowed = F.broadcast(spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string"))
    return table(spark, sf_dir, "documents").join(allowed, "source", "left_semi").select("doc_id")


@query("usable_items", "SELECT item_id FROM benchmark WHERE text <> '' AND contains(text, 'the')")
def usable_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where((F.col("text") != "") & F.contains("text", F.lit("the"))).select("item_id")
