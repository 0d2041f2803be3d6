"""Filtering, exclusion and deduplication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import blocked_host, canonical_url, digest, host, normalize, split_of, title_key, words as word_list
from quern.functions.text import grams as gram_list
from quern.operators import dedup, exclusion, filters, windows
from quern.operators.decisions import symmetric_difference
from quern.plans.base import grams_of, normal, query, table, words
from quern.runtime import cut

BLOCKED = ["example.org", "ththble.example.net"]

_CASCADE_SQL = f"""
    n AS (SELECT *, {normal('text')} AS norm FROM documents),
    bench AS (SELECT DISTINCT unnest({grams_of('w')}) AS gram FROM (SELECT {words(normal('text'))} AS w FROM benchmark)),
    hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({grams_of('w')}) AS gram FROM (SELECT doc_id, {words('norm')} AS w FROM n)) WHERE gram IN (SELECT gram FROM bench)),
    staged AS (
        SELECT n.doc_id, n.lang, n.source, sha256(norm) AS digest,
               CASE WHEN NOT length(text) BETWEEN 240 AND 200000 THEN 'length'
                    WHEN n.doc_id IN (SELECT doc_id FROM hit) THEN 'benchmark_exact' END AS early
        FROM n),
    reasoned AS (
        SELECT *, CASE WHEN early IS NOT NULL THEN early
                       WHEN row_number() OVER (PARTITION BY digest, early IS NULL ORDER BY doc_id) > 1 THEN 'exact_document' END AS reason
        FROM staged)"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their digest and the first reason of length, benchmark and exact repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    index = exclusion.index_grams(table(spark, sf_dir, "benchmark"), F.col("text"))
    hit = exclusion.contaminated(docs, "doc_id", index).withColumn("hit", F.lit(True))
    early = docs.join(hit, "doc_id", "left").select(
        "doc_id",
        "lang",
        "source",
        digest(normalize(F.col("text"))).alias("digest"),
        filters.first_reason((~filters.length_ok(F.col("text")), "length"), (F.col("hit"), "benchmark_exact")).alias("early"),
    )
    marked = dedup.mark_repeated(early, "digest", "doc_id", usable=F.col("early").isNull())
    return marked.withColumn("reason", F.coalesce("early", F.when(F.col("again"), "exact_document"))).drop("again")


@query(
    "funnel_base",
    f"""WITH {_CASCADE_SQL},
    placed AS (SELECT lang, coalesce(reason, 'kept') AS reason, ('0x' || substr(digest, 1, 16))::UBIGINT % 100 AS b FROM reasoned)
    SELECT lang, reason, CASE WHEN reason <> 'kept' THEN NULL WHEN b >= 9 THEN 'train'
           ELSE list_extract(['controller_0_proposal','controller_0_confirm','controller_1_proposal','controller_1_confirm','controller_2_proposal','controller_2_confirm','selection','final','monitor'], (b + 1)::INT) END AS split,
           count(*) AS n
    FROM placed GROUP BY ALL""",
)
def funnel_base(spark, sf_dir):
    rows = staged(spark, sf_dir).withColumn("split", F.when(F.col("reason").isNull(), split_of(F.col("digest"))))
    return filters.funnel(rows, ["lang", "split"])


@query("length_gate", "SELECT doc_id, CASE WHEN length(text) BETWEEN 240 AND 200000 THEN NULL ELSE 'length' END AS reason FROM documents")
def length_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", filters.first_reason((~filters.length_ok(F.col("text")), "length")).alias("reason"))


@query("reason_cascade", f"WITH {_CASCADE_SQL} SELECT doc_id, reason FROM reasoned")
def reason_cascade(spark, sf_dir):
    return staged(spark, sf_dir).select("doc_id", "reason")


@query(
    "reason_by_lang_rollup",
    f"WITH {_CASCADE_SQL} SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY ROLLUP (lang, coalesce(reason, 'kept'))",
)
def reason_by_lang_rollup(spark, sf_dir):
    rows = staged(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("kept")))
    return rows.rollup("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "removal_table",
    f"WITH {_CASCADE_SQL} SELECT reason, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM reasoned WHERE reason IS NOT NULL GROUP BY reason",
)
def removal_table(spark, sf_dir):
    rows = staged(spark, sf_dir).where("reason IS NOT NULL")
    return rows.groupBy("reason").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@query("dedup_funnel", f"WITH {_CASCADE_SQL} SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY ALL")
def dedup_funnel(spark, sf_dir):
    return filters.funnel(staged(spark, sf_dir), ["source"])


@query("benchmark_grams", f"SELECT DISTINCT unnest({grams_of('w')}) AS gram FROM (SELECT {words(normal('text'))} AS w FROM benchmark)")
def benchmark_grams(spark, sf_dir):
    return exclusion.index_grams(table(spark, sf_dir, "benchmark"), F.col("text"))


@query("contaminated_docs", f"WITH {_CASCADE_SQL} SELECT doc_id FROM hit")
def contaminated_docs(spark, sf_dir):
    index = exclusion.index_grams(table(spark, sf_dir, "benchmark"), F.col("text"))
    return exclusion.contaminated(table(spark, sf_dir, "documents"), "doc_id", index)


@query("decontaminated_docs", f"WITH {_CASCADE_SQL} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)")
def decontaminated_docs(spark, sf_dir):
    index = exclusion.index_grams(table(spark, sf_dir, "benchmark"), F.col("text"))
    return exclusion.decontaminate(table(spark, sf_dir, "documents"), "doc_id", index).select("doc_id", "lang")


@query(
    "exclusion_report",
    f"SELECT 'benchmark' AS source, (SELECT count(*) FROM benchmark) AS items, count(DISTINCT gram) AS grams FROM (SELECT unnest({grams_of('w')}) AS gram FROM (SELECT {words(normal('text'))} AS w FROM benchmark))",
)
def exclusion_report(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    items = bench.agg(F.count(F.lit(1)).alias("items"))
    found = exclusion.index_grams(bench, F.col("text")).agg(F.count(F.lit(1)).alias("grams"))
    return items.crossJoin(found).select(F.lit("benchmark").alias("source"), "items", "grams")


@query(
    "full_context_overlap",
    f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON {normal('d.text')} = {normal('b.text')}",
)
def full_context_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("key"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", normalize(F.col("text")).alias("key"))
    return docs.join(bench, "key").select("doc_id", "item_id")


@query(
    "task_overlap",
    f"""WITH q AS (SELECT conv_id, turn, role, {words('lower(text)')} AS w, {normal('text')} AS key FROM conversations),
    official AS (SELECT role, key, w FROM q WHERE conv_id % 2 = 0),
    og AS (SELECT DISTINCT role, unnest({grams_of('w')}) AS gram FROM official),
    train AS (SELECT * FROM q WHERE conv_id % 2 = 1),
    tg AS (SELECT conv_id, turn, role, unnest({grams_of('w')}) AS gram FROM train)
    SELECT conv_id, turn, (role, key) IN (SELECT (role, key) FROM official) AS same_context,
           (conv_id, turn) IN (SELECT (conv_id, turn) FROM tg JOIN og USING (role, gram)) AS shared_gram
    FROM train""",
)
def task_overlap(spark, sf_dir):
    """Odd conversations are the training side and even ones the official side; the role is the task."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", normalize(F.col("text")).alias("key"), word_list(F.lower("text")).alias("w"))
    official, train = rows.where("conv_id % 2 = 0"), rows.where("conv_id % 2 = 1")
    known = official.select("role", "key").distinct().withColumn("same", F.lit(True))
    known_grams = official.select("role", F.explode(gram_list(F.col("w"), 13)).alias("gram")).distinct()
    shared = train.select("conv_id", "turn", "role", F.explode(gram_list(F.col("w"), 13)).alias("gram")).join(known_grams, ["role", "gram"], "left_semi")
    shared = shared.select("conv_id", "turn").distinct().withColumn("shared", F.lit(True))
    joined = train.join(known, ["role", "key"], "left").join(shared, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.coalesce("same", F.lit(False)).alias("same_context"), F.coalesce("shared", F.lit(False)).alias("shared_gram"))


@query("hashed_grams")
def hashed_grams(spark, sf_dir):
    return exclusion.hashed_grams(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("hashed_contaminated_docs")
def hashed_contaminated_docs(spark, sf_dir):
    """Whole documents against the benchmark by rolling hashes; tests hold it against plain Python."""
    return exclusion.hashed_contaminated(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query(
    "stage_table",
    f"""WITH {_CASCADE_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (reason = 'length') AS a, count(*) FILTER (reason = 'benchmark_exact') AS b, count(*) FILTER (reason = 'exact_document') AS c FROM reasoned)
    SELECT 'length' AS stage, n AS documents_in, n - a AS documents_out FROM c UNION ALL SELECT 'benchmark_exact', n - a, n - a - b FROM c UNION ALL SELECT 'exact_document', n - a - b, n - a - b - c FROM c""",
)
def stage_table(spark, sf_dir):
    """Documents into and out of each stage of the cascade."""
    return filters.stages(staged(spark, sf_dir), "reason", ["length", "benchmark_exact", "exact_document"])


@query(
    "title_exclusion",
    f"""WITH t AS (SELECT DISTINCT {normal("replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '_', ' ')")} AS title FROM pages WHERE page_id % 2 = 0)
    SELECT page_id, {normal("replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '_', ' ')")} IN (SELECT title FROM t) AS excluded FROM pages""",
)
def title_exclusion(spark, sf_dir):
    keyed = table(spark, sf_dir, "pages").select("page_id", title_key(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("title"))
    known = keyed.where("page_id % 2 = 0").select("title").distinct().withColumn("excluded", F.lit(True))
    return keyed.join(known, "title", "left").select("page_id", F.coalesce("excluded", F.lit(False)).alias("excluded"))


# ------------------------------------------------------------------- URLs

_AU = r"regexp_extract(url,'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)',1)"
_PA = r"regexp_extract(url,'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)',1)"
_QU = r"regexp_extract(url,'^[^?#]*\?([^#]*)',1)"
HOST_SQL = rf"regexp_replace(lower({_AU}),'^www\.','')"
URL_SQL = f"CASE WHEN {_AU} = '' THEN '' ELSE concat('https://', {HOST_SQL}, rtrim(url_decode({_PA}), '/'), CASE WHEN {_QU} = '' THEN '' ELSE concat('?', {_QU}) END) END"
_BLOCK_SQL = " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in BLOCKED)


@query("canonical_urls", f"SELECT page_id, {URL_SQL} AS canonical FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query("url_hosts", f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))


@query("domain_blocklist", f"SELECT page_id, {_BLOCK_SQL} AS blocked FROM (SELECT page_id, {HOST_SQL} AS h FROM pages)")
def domain_blocklist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", blocked_host(host(F.col("url")), BLOCKED).alias("blocked"))


@query(
    "domain_blocklist_join",
    f"WITH b AS (SELECT unnest(['example.org', 'ththble.example.net']) AS d) SELECT DISTINCT page_id FROM (SELECT page_id, {HOST_SQL} AS h FROM pages) JOIN b ON h = d OR ends_with(h, '.' || d)",
)
def domain_blocklist_join(spark, sf_dir):
    """The same rule as a theta join with a small table."""
    blocked = F.broadcast(spark.createDataFrame([(d,) for d in BLOCKED], "d string"))
    pages = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("h"))
    return pages.join(blocked, (F.col("h") == F.col("d")) | F.col("h").endswith(F.concat(F.lit("."), F.col("d"))), "left_semi").select("page_id")


@query("prefer_origin", f"SELECT page_id FROM pages WHERE page_id % 2 = 0 OR NOT contains({URL_SQL}, '.example.com/')")
def prefer_origin(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return filters.prefer_origin(pages, "url", F.col("page_id") % 2 == 0, ".example.com/").select("page_id")


@query("url_dups", f"SELECT page_id, row_number() OVER (PARTITION BY c ORDER BY page_id) > 1 AND c <> '' AS again FROM (SELECT page_id, {URL_SQL} AS c FROM pages)")
def url_dups(spark, sf_dir):
    keyed = table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("c"))
    return dedup.mark_repeated(keyed, "c", "page_id", usable=F.col("c") != "").select("page_id", "again")


@query(
    "dedup_reasons_exact_url",
    f"""WITH p AS (SELECT page_id, sha256({normal('html')}) AS digest, regexp_replace({URL_SQL}, '\\d+.*$', '') AS u FROM pages),
    r AS (SELECT page_id, row_number() OVER (PARTITION BY digest ORDER BY page_id) AS d, row_number() OVER (PARTITION BY u ORDER BY page_id) AS k, u FROM p)
    SELECT page_id, CASE WHEN d > 1 THEN 'exact_document' WHEN k > 1 AND u <> '' THEN 'same_url' END AS reason FROM r""",
)
def dedup_reasons_exact_url(spark, sf_dir):
    """Pages of one section (the URL up to its number) count as one URL, so that some repeat."""
    rows = table(spark, sf_dir, "pages").select("page_id", digest(normalize(F.col("html"))).alias("digest"), F.regexp_replace(canonical_url(F.col("url")), r"\d+.*$", "").alias("u"))
    return dedup.exact_and_url_reasons(rows, "digest", "u", "page_id").select("page_id", "reason")


# ------------------------------------------------------------------- duplicates


@query("exact_dups", f"SELECT doc_id, row_number() OVER (PARTITION BY {normal('text')} ORDER BY doc_id) > 1 AS again FROM documents")
def exact_dups(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", digest(normalize(F.col("text"))).alias("digest"))
    return dedup.mark_repeated(keyed, "digest", "doc_id").select("doc_id", "again")


@query("exact_dup_groups", f"SELECT sha256({normal('text')}) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", digest(normalize(F.col("text"))).alias("digest"))
    return keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    "quota_then_dedup",
    f"""WITH d AS (SELECT doc_id, source, sha256({normal('text')}) AS digest FROM documents),
    s AS (SELECT *, ('0x' || substr(digest, 1, 16))::UBIGINT % 100 AS b FROM d),
    q AS (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY doc_id) AS r FROM s),
    k AS (SELECT * FROM q WHERE b >= 9 OR r <= 1)
    SELECT doc_id, source FROM k QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1""",
)
def quota_then_dedup(spark, sf_dir):
    """Held-out surplus rows go first and are not remembered as seen; then the first of equal texts stays."""
    from pyspark.sql import Window

    from quern.functions.text import digest_bucket

    rows = table(spark, sf_dir, "documents").select("doc_id", "source", digest(normalize(F.col("text"))).alias("digest"))
    rows = rows.withColumn("b", digest_bucket(F.col("digest"), 100))
    rank = F.row_number().over(Window.partitionBy("source", "b").orderBy("doc_id"))
    kept = rows.withColumn("r", rank).where("b >= 9 OR r <= 1")
    return dedup.mark_repeated(kept, "digest", "doc_id").where("NOT again").select("doc_id", "source")


@query("seen_anti_join", f"WITH d AS (SELECT doc_id, {normal('text')} AS k FROM documents) SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND k NOT IN (SELECT k FROM d WHERE doc_id % 2 = 0)")
def seen_anti_join(spark, sf_dir):
    """A new corpus (odd ids) against the digests of a prior one (even ids)."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", digest(normalize(F.col("text"))).alias("digest"))
    return dedup.unseen(keyed.where("doc_id % 2 = 1"), keyed.where("doc_id % 2 = 0"), "digest").select("doc_id")


@query(
    "prior_corpus_first",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS prior, sha256({normal('text')}) AS digest FROM documents)
    SELECT doc_id, prior, row_number() OVER (PARTITION BY digest ORDER BY prior, doc_id) > 1 AS again FROM d""",
)
def prior_corpus_first(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", digest(normalize(F.col("text"))).alias("digest"))
    both = dedup.with_prior(keyed.where("doc_id % 3 <> 0"), keyed.where("doc_id % 3 = 0"), ["doc_id"])
    return dedup.mark_repeated(both, "digest", "__order").select("doc_id", "prior", "again")


def _sketch_sql() -> str:
    from quern.functions.numeric import COMPONENTS, MERSENNE, permutation

    parts = ", ".join(
        f"coalesce(min((({a}::BIGINT * h + {b}) % {MERSENNE}) & 4294967295), 0)::BIGINT AS m{i}" for i in range(COMPONENTS) for a, b in [permutation(i)]
    )
    joined = ", ".join(f"m{i}" for i in range(COMPONENTS))
    return rf"""
    w AS (SELECT doc_id, list_filter(string_split({normal('text')}, ' '), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest({grams_of('w', 5)}) AS s FROM w),
    h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM s),
    m AS (SELECT d.doc_id, {parts} FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id),
    k AS (SELECT doc_id, [{joined}] AS sketch FROM m)"""


@query("minhash_portable", f"WITH {_sketch_sql()} SELECT doc_id, md5(array_to_string(sketch, ',')) AS sketch FROM k")
def minhash_portable(spark, sf_dir):
    made = dedup.sketches(table(spark, sf_dir, "documents"), "doc_id")
    return made.select("doc_id", F.md5(F.array_join(F.transform("sketch", lambda x: x.cast("string")), ",")).alias("sketch"))


_BANDS_SQL = "b AS (SELECT doc_id, unnest(range(8)) AS band, sketch FROM c), c2 AS (SELECT doc_id, band, array_to_string(list_slice(sketch, band * 4 + 1, band * 4 + 4), ',') AS key FROM b)"
_PAIRS_SQL = f"""{_sketch_sql()}, c AS (SELECT min(doc_id) AS doc_id, sketch FROM k GROUP BY sketch), {_BANDS_SQL},
    p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM c2 x JOIN c2 y USING (band, key) WHERE x.doc_id < y.doc_id),
    e AS (SELECT a, p.b, len(list_filter(list_zip(x.sketch, y.sketch), lambda z: z[1] = z[2])) AS equal FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = p.b)"""


@query("lsh_candidates", f"WITH {_sketch_sql()}, c AS (SELECT doc_id, sketch FROM k), {_BANDS_SQL} SELECT doc_id, band, md5(key) AS key FROM c2")
def lsh_candidates(spark, sf_dir):
    rows = dedup.band_rows(dedup.sketches(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return rows.select("doc_id", "band", F.md5("key").alias("key"))


@query("near_pairs", f"WITH {_PAIRS_SQL} SELECT a, b, equal FROM e WHERE equal >= 28")
def near_pairs(spark, sf_dir):
    return dedup.near_pairs(cut(dedup.sketches(table(spark, sf_dir, "documents"), "doc_id")), "doc_id")


@query("near_kept")
def near_kept(spark, sf_dir):
    return dedup.near_reasons(dedup.sketches(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


_PRIOR_SQL = f"""{_sketch_sql()}, c AS (SELECT doc_id, sketch FROM k), {_BANDS_SQL},
    p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM c2 x JOIN c2 y USING (band, key) WHERE x.doc_id % 2 = 1 AND y.doc_id % 2 = 0),
    e AS (SELECT DISTINCT a FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = p.b WHERE len(list_filter(list_zip(x.sketch, y.sketch), lambda z: z[1] = z[2])) >= 28)"""


@query("near_prior", f"WITH {_PRIOR_SQL} SELECT doc_id, doc_id IN (SELECT a FROM e) AS near_prior FROM documents WHERE doc_id % 2 = 1")
def near_prior(spark, sf_dir):
    """Documents of odd ids that are a copy or a near copy of one of even id, the prior corpus."""
    sketched = dedup.sketches(table(spark, sf_dir, "documents"), "doc_id")
    return dedup.near_any(sketched.where("doc_id % 2 = 1"), sketched.where("doc_id % 2 = 0"), "doc_id").select("doc_id", F.col("near").alias("near_prior"))


@query("near_prior_kept")
def near_prior_kept(spark, sf_dir):
    """First wins among documents of odd ids behind a prior corpus of even ids, which all stay."""
    sketched = dedup.sketches(table(spark, sf_dir, "documents"), "doc_id")
    return dedup.near_reasons(sketched.where("doc_id % 2 = 1"), "doc_id", sketched.where("doc_id % 2 = 0"))


def _cascade_rows(spark, sf_dir):
    """Documents with every reason that a cascade may name: URLs are the sources with the id's hundreds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    index = exclusion.index_grams(table(spark, sf_dir, "benchmark"), F.col("text"))
    hit = exclusion.contaminated(docs, "doc_id", index).withColumn("hit", F.lit(True))
    rows = docs.join(hit, "doc_id", "left").select(
        "doc_id",
        "source",
        digest(normalize(F.col("text"))).alias("digest"),
        F.concat(F.lit("https://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 100)).alias("u"),
        (~filters.length_ok(F.col("text"))).alias("short"),
        F.coalesce("hit", F.lit(False)).alias("hit"),
        (F.col("lang") == "es").alias("preferred"),
        F.col("source").isin("src0", "src1").alias("blocked"),
    )
    return rows


_ORDERS_SQL = f"""{_CASCADE_SQL},
    f AS (SELECT d.doc_id, d.source, sha256({normal('d.text')}) AS digest, 'https://' || d.source || '/' || d.doc_id // 100 AS u, NOT length(d.text) BETWEEN 240 AND 200000 AS short, d.doc_id IN (SELECT doc_id FROM hit) AS hit, d.lang = 'es' AS preferred, d.source IN ('src0', 'src1') AS blocked FROM documents d)"""


@query(
    "cascade_first_corpus",
    f"""WITH {_ORDERS_SQL}, e AS (SELECT *, CASE WHEN short THEN 'length' WHEN hit THEN 'benchmark_exact' END AS early FROM f),
    q AS (SELECT *, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY source, early IS NULL ORDER BY doc_id) > 30 THEN 'quota' ELSE early END AS early2 FROM e)
    SELECT doc_id, CASE WHEN early2 IS NOT NULL THEN early2 WHEN row_number() OVER (PARTITION BY digest, early2 IS NULL ORDER BY doc_id) > 1 THEN 'exact_document' END AS reason FROM q""",
)
def cascade_first_corpus(spark, sf_dir):
    """The order length, benchmark, quota (30 documents a source), exact copy."""
    rows = _cascade_rows(spark, sf_dir).withColumn("early", filters.first_reason((F.col("short"), "length"), (F.col("hit"), "benchmark_exact"))).withColumn("one", F.col("early").isNull().cast("long"))
    placed = windows.sums_before(rows.select("doc_id", "source", "digest", "early", "one"), ["source"], ["doc_id"], before="one")
    placed = placed.withColumn("early", F.coalesce("early", F.when(F.col("before") >= 30, "quota")))
    marked = dedup.mark_repeated(placed.select("doc_id", "digest", "early"), "digest", "doc_id", usable=F.col("early").isNull())
    return marked.select("doc_id", F.coalesce("early", F.when(F.col("again"), "exact_document")).alias("reason"))


@query(
    "cascade_extension",
    f"""WITH {_ORDERS_SQL}, e AS (SELECT *, CASE WHEN short THEN 'length' WHEN hit THEN 'benchmark_exact' WHEN preferred THEN 'prefer_origin' END AS early FROM f)
    SELECT doc_id, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY digest, early IS NULL ORDER BY doc_id) > 1 THEN 'exact_document'
    WHEN row_number() OVER (PARTITION BY u, early IS NULL ORDER BY doc_id) > 1 THEN 'same_url' END AS reason FROM e""",
)
def cascade_extension(spark, sf_dir):
    """The order length, benchmark, preferred origin, exact copy, URL, before near copies and surplus."""
    rows = _cascade_rows(spark, sf_dir)
    early = filters.first_reason((F.col("short"), "length"), (F.col("hit"), "benchmark_exact"), (F.col("preferred"), "prefer_origin"))
    staged_rows = cut(rows.select("doc_id", "digest", "u", early.alias("early")))
    late = dedup.exact_and_url_reasons(staged_rows.where("early IS NULL"), "digest", "u", "doc_id").select("doc_id", F.col("reason").alias("late"))
    return staged_rows.join(late, "doc_id", "left").select("doc_id", F.coalesce("early", "late").alias("reason"))


@query("cascade_reused", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'domain_blocklist' END AS reason FROM documents")
def cascade_reused(spark, sf_dir):
    """Rows of an earlier corpus meet the blocklist alone; two sources stand for blocked domains."""
    return table(spark, sf_dir, "documents").select("doc_id", filters.first_reason((F.col("source").isin("src0", "src1"), "domain_blocklist")).alias("reason"))


@query("minhash_exact")
def minhash_exact(spark, sf_dir):
    return dedup.exact_sketches(table(spark, sf_dir, "documents"), "doc_id")


# ------------------------------------------------------------------- set operations


@query("union_all_sources", "SELECT source, count(*) AS n FROM (SELECT 'documents' AS source FROM documents UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'conversations' FROM conversations) GROUP BY source")
def union_all_sources(spark, sf_dir):
    from quern.sources.readers import normalized_rows, union_sources

    frames = [normalized_rows(table(spark, sf_dir, t), t) for t in ("documents", "benchmark", "conversations")]
    return union_sources(frames).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("union_distinct_grams", f"SELECT count(*) AS n FROM (SELECT unnest({grams_of('w')}) FROM (SELECT {words(normal('text'))} AS w FROM benchmark) UNION SELECT unnest({grams_of('w')}) FROM (SELECT {words(normal('text'))} AS w FROM conversations))")
def union_distinct_grams(spark, sf_dir):
    a, b = (exclusion.index_grams(table(spark, sf_dir, t), F.col("text")) for t in ("benchmark", "conversations"))
    return a.union(b).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("intersect_nonempty", f"SELECT count(*) > 0 AS overlaps FROM (SELECT {normal('text')} AS k FROM benchmark INTERSECT SELECT {normal('text')} FROM documents)")
def intersect_nonempty(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select(normalize(F.col("text")).alias("k")) for t in ("benchmark", "documents"))
    return a.intersect(b).agg((F.count(F.lit(1)) > 0).alias("overlaps"))


@query("except_by_id", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_by_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id").distinct())


@query("config_symmetric_difference", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def config_symmetric_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return symmetric_difference(a, b, "k")


@query("set_equality", "SELECT NOT EXISTS (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) AND NOT EXISTS (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation) AS equal")
def set_equality(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"))
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    return symmetric_difference(a, b, "k").agg((F.count(F.lit(1)) == 0).alias("equal"))
