"""Sources and sinks as round trips through the shared folder, and tokenizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import aggregates, tokenizing
from quern.plans import ranged
from quern.plans.base import normal, query, table
from quern.plans.corpus import _CASCADE_SQL
from quern.runtime import shared_folder
from quern.sources import commits, ranges, readers, sinks


def _place(spark) -> str:
    return f"{shared_folder(spark)}/storage/{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


@query("parquet_resume", "SELECT doc_id FROM documents WHERE n_chars >= 240")
def parquet_resume(spark, sf_dir):
    """A scan with file and row number; only two columns are read and the filter is pushed down."""
    rows = readers.parquet_rows(spark, f"{sf_dir}/documents.parquet")
    return rows.where("n_chars >= 240").select("doc_id")


@query("json_roundtrip", "SELECT doc_id, text, source FROM documents")
def json_roundtrip(spark, sf_dir):
    place = _place(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text", "source").write.option("compression", "gzip").json(place)
    return readers.json_rows(spark, "doc_id long, text string, source string", place)


@query("partitioned_sink", "SELECT source, lang, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY ALL")
def partitioned_sink(spark, sf_dir):
    """A table by source and language; the read back prunes partitions."""
    place = _place(spark)
    sinks.write_partitioned(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), place, "source", "lang")
    return spark.read.parquet(place).where("lang = 'de'").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("labelled_text", "SELECT '__label__' || quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def labelled_text(spark, sf_dir):
    place = _place(spark)
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", F.regexp_replace(text.normalize(F.col("text")), "\n", " ").alias("t"))
    sinks.write_labelled_text(rows, place, "quality", "t")
    return spark.read.text(place).groupBy(F.substring_index("value", " ", 1).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("shard_roundtrip", r"WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents), o AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS begins FROM d) SELECT source AS part, (begins // 4096)::BIGINT AS number, count(*) AS documents FROM o GROUP BY ALL")
def shard_roundtrip(spark, sf_dir):
    """uint16 shards of word lengths of whole texts, 4,096 a shard, written and read back: where each document begins."""
    place = _place(spark)
    ids = F.transform(text.split_words(F.col("text")), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", ids.alias("ids"))
    sinks.numbered_shards(rows, "source", "doc_id", "ids", 4096).write.parquet(place)
    return spark.read.parquet(place).where("documents > 0").select("part", "number", "documents")


@query("shard_whole_texts", r"SELECT source AS part, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))::BIGINT AS tokens, count(*) AS documents FROM documents GROUP BY source")
def shard_whole_texts(spark, sf_dir):
    """uint16 shards of the word lengths of whole texts, each source in numbered shards of a fixed size."""
    ids = F.transform(text.split_words(F.col("text")), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", ids.alias("ids"))
    shards = sinks.numbered_shards(rows, "source", "doc_id", "ids").select("part", (F.length("shard") / 2).cast("long").alias("tokens"), "documents")
    return shards.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))


@query("manifest_roundtrip", "SELECT doc_id, source FROM documents")
def manifest_roundtrip(spark, sf_dir):
    place = _place(spark)
    sinks.publish_manifest(spark, {"index": table(spark, sf_dir, "documents").select("doc_id", "source")}, place)
    return sinks.open_manifest(spark, place)["index"]


@query("journal_roundtrip", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def journal_roundtrip(spark, sf_dir):
    place = _place(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
        sinks.append_events(part, place)
    return readers.journal(spark, place, "event_id long, user_id long, event_type string").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("done_parts", "SELECT source AS part FROM documents GROUP BY source HAVING sum(n_chars) % 2 = 1")
def done_parts(spark, sf_dir):
    """Sources of an even number of characters have left their completion marker; the others are still to do."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("part")).agg(F.sum("n_chars").alias("n"))
    place = _place(spark)
    sinks.append_events(counts.where("n % 2 = 0").select("part"), place)
    return sinks.finished_parts(counts.select("part"), readers.journal(spark, place, "part string"))


@query(
    "coverage_gaps",
    "SELECT 'benchmark' AS source, 'loaded' AS status, (SELECT count(*) FROM benchmark) AS n UNION ALL SELECT 'conversations', 'loaded', (SELECT count(*) FROM conversations) UNION ALL SELECT 'missing', 'unavailable', 0",
)
def coverage_gaps(spark, sf_dir):
    """Sets that are there with their rows, and one that is not."""
    loaded, status = readers.load_or_gap(spark, {name: f"{sf_dir}/{name}.parquet" for name in ("benchmark", "conversations", "missing")})
    counts = readers.union_sources([df.select(F.lit(name).alias("source")) for name, df in loaded.items()]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, "source", "left").select("source", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("glob_files", "SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey IN (1, 3)")
def glob_files(spark, sf_dir):
    """A table in files by region; the odd ones are listed by glob, sorted, and read."""
    place = _place(spark)
    sinks.write_partitioned(table(spark, sf_dir, "nation"), place, "n_regionkey", form="json")
    paths = readers.listed(spark, f"{place}/n_regionkey=[13]/part-*")
    if paths != sorted(paths):
        raise ValueError("files are not in order")
    return spark.read.schema("n_name string").json(paths).select(F.col("n_name").alias("name"), F.regexp_extract(F.col("_metadata.file_path"), r"n_regionkey=(\d)", 1).cast("long").alias("region"))


@query("byte_ranges", "SELECT doc_id, source FROM documents")
def byte_ranges(spark, sf_dir):
    """Compressed JSON lines split over files: every line is read once, whatever the splits."""
    place = _place(spark)
    table(spark, sf_dir, "documents").select("doc_id", "source").repartition(7).write.option("compression", "bzip2").json(place)
    return readers.json_rows(spark, "doc_id long, source string", place)


@query("line_ranges", "SELECT doc_id, md5(text) AS digest FROM documents")
def line_ranges(spark, sf_dir):
    """JSON lines of whole documents read by byte range, a quarter of a megabyte a task: every line is in one range."""
    place = _place(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(place)
    rows = ranges.json_lines(spark, "doc_id long, text string", *readers.listed(spark, f"{place}/part-*"), range_bytes=1 << 18)
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("resumed_lines", "SELECT doc_id, source FROM documents")
def resumed_lines(spark, sf_dir):
    """JSON lines read up to a position near the middle of each file, then from there on, as a restart does."""
    place = _place(spark)
    table(spark, sf_dir, "documents").select("doc_id", "source").write.json(place)
    files = readers.listed(spark, f"{place}/part-*")
    # A position is where a line ends: the first one behind the middle, from the lines around it.
    middle = {f: ranges.size_of(f) // 2 for f in files}
    near = ranges.line_ranges(spark, *files, start=middle).groupBy("file").agg(F.min("position").alias("at"))
    at = {r["file"]: r["at"] for r in near.collect()}  # one row a file
    first = ranges.json_lines(spark, "doc_id long, source string", *files, stop={f: at.get(f, 0) for f in files})
    rest = ranges.json_lines(spark, "doc_id long, source string", *files, start={f: at.get(f, 0) for f in files})
    return first.unionByName(rest).select("doc_id", "source")


@query(
    "ranged_build",
    f"SELECT doc_id, source, sha256({normal('text')}) AS digest, (strlen(text) + 1)::BIGINT AS tokens FROM documents",
)
def ranged_build(spark, sf_dir):
    """JSON lines of each source built by ranges of half a megabyte: some sources at a first start, the rest at a second."""
    place = _place(spark)
    table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(None).cast("string").alias("url"), "text").write.option("ignoreNullFields", False).partitionBy("source").json(f"{place}/in")
    files: dict[str, list[str]] = {}
    for path in readers.listed(spark, f"{place}/in/source=*/part-*"):
        files.setdefault(path.split("source=")[1].split("/")[0], []).append(path)
    first, work = sorted(files)[::2], ranged.reused_rows()
    for sources in (first, None):
        ranged.build_parts(spark, files, f"{place}/out", "doc_id long, url string, text string", work, 1 << 19, sources=sources)
    return ranged.built(spark, f"{place}/out").select("doc_id", "source", "digest", F.size("ids").cast("long").alias("tokens"))


@query("shuffled_lines", "SELECT doc_id, md5(text) AS digest, true AS placed FROM documents")
def shuffled_lines(spark, sf_dir):
    """Lines of documents in the order of a buffer of 1,000 for each range: all are there, each range counts from 0."""
    place = _place(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(place)
    rows = ranges.shuffled_lines(spark, *readers.listed(spark, f"{place}/part-*"), most=1000, range_bytes=1 << 20)
    sizes = rows.groupBy("file", "first").agg((F.max("place") + 1 == F.count(F.lit(1))).alias("placed"))
    parsed = rows.select("file", "first", F.from_json("line", "doc_id long, text string").alias("r"))
    return parsed.join(sizes, ["file", "first"]).select("r.doc_id", F.md5("r.text").alias("digest"), "placed")


@query(
    "encode_pairs",
    r"""WITH d AS (SELECT doc_id, substr(text, 1, length(text) // 2 + 1) AS a, substr(text, length(text) // 2 + 2) AS b FROM documents),
    m AS (SELECT doc_id, regexp_replace(a, '\s+$', '') AS c, regexp_extract(a, '\s*$') || b AS k FROM d WHERE trim(a) <> '')
    SELECT doc_id, strlen(c)::BIGINT AS n_context, strlen(k)::BIGINT AS n_continuation, md5(c || '|' || k) AS digest FROM m""",
)
def encode_pairs(spark, sf_dir):
    """Each document as a context and its continuation, encoded as one text; blanks at the border go to the continuation."""
    half = (F.floor(F.length("text") / 2) + 1).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("b"))
    made = tokenizing.encode_pairs(docs.where(F.trim("a") != ""), "a", "b")
    read = [tokenizing.decoded_bytes(F.col(c)) for c in ("context_ids", "continuation_ids")]
    return made.select("doc_id", F.size("context_ids").cast("long").alias("n_context"), F.size("continuation_ids").cast("long").alias("n_continuation"), F.md5(F.concat(read[0], F.lit("|"), read[1])).alias("digest"))


@query(
    "two_phase_commits",
    f"SELECT doc_id, source, (doc_id % 3)::BIGINT AS batch, sha256({normal('text')}) AS digest FROM documents",
)
def two_phase_commits(spark, sf_dir):
    """Output and state of three batches, each under one commit; a batch that comes again changes nothing."""
    place = _place(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.digest(text.normalize(F.col("text"))).alias("digest"))
    for batch in (0, 1, 1, 2):
        rows = docs.where(F.col("doc_id") % 3 == batch)
        commits.commit_batch(spark, place, batch, {"out": rows.select("doc_id", "source"), "state": rows.select("doc_id", "digest")}, {"done": batch})
    if commits.last_commit(place)["progress"] != {"done": 2} or commits.recover(place):
        raise ValueError("a commit is missing, or a file is that no commit names")
    out, state = (commits.committed(spark, place, name, f"doc_id long, {c} string") for name, c in (("out", "source"), ("state", "digest")))
    return out.join(state, ["doc_id", "batch"]).select("doc_id", "source", "batch", "digest")


@query("source_fallback_ids", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS id, '' AS title, source IS NULL AS orphan FROM documents")
def source_fallback_ids(spark, sf_dir):
    """Rows in the common columns: an empty id falls back to source_id, an absent title is empty."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("x"), "doc_id").alias("source_id"), "text")
    made = readers.normalized_rows(rows, "documents")
    return made.select("id", "title", F.col("source").isNull().alias("orphan"))


@query("frozen_record", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def frozen_record(spark, sf_dir):
    """A record that is written once and read back; a second write is refused."""
    from pyspark.errors import AnalysisException

    place = _place(spark)
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sinks.freeze(counts, place)
    try:
        sinks.freeze(counts, place)
    except AnalysisException:
        return spark.read.schema("source string, n long").json(place)
    raise AssertionError("a frozen record was written twice")


@query("figure_data", "SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def figure_data(spark, sf_dir):
    """The table behind a figure as one JSON document of columns, published in one step and read back."""
    place = _place(spark)
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    sinks.publish_figure(spark, rows, f"{place}/languages.data.json")
    return readers.figure(spark, f"{place}/languages.data.json", "lang string, documents long, chars long")


@query("thread_scan", "SELECT 'site:' || doc_id AS id, 'https://site/questions/' || doc_id AS url FROM documents WHERE n_chars % 5 >= 1 AND n_chars % 3 >= 1 AND text <> ''")
def thread_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS Id", "n_chars % 5 AS Score", "n_chars % 3 AS AnswerCount", "source AS Title", "text AS ThreadText")
    return readers.thread_rows(rows, F.lit("site")).select("id", "url")


@query("book_scan")
def book_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return readers.book_rows(rows, 2000, 1000).select("id", F.length("text").alias("chars"))


@query(
    "article_fold",
    """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' = Title ' || doc_id || ' = ' ELSE replace(text, chr(10), ' ') END AS t, source FROM documents),
    m AS (SELECT *, sum((doc_id % 10 = 0)::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS a FROM l WHERE trim(t) <> ''),
    f AS (SELECT source, a, string_agg(t, chr(10) ORDER BY doc_id) AS body, count(*) AS paragraphs FROM m GROUP BY source, a)
    SELECT source, sha256(body) AS id, paragraphs FROM f""",
)
def article_fold(spark, sf_dir):
    """Documents stand for paragraphs, every tenth for a heading, sources for files."""
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" = Title "), F.col("doc_id"), F.lit(" = "))).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", line.alias("t"))
    return readers.article_fold(rows, "doc_id", "t", ["source"]).select("source", "id", "paragraphs")


@query("required_fields", "SELECT 'doc_id' AS field, 0::BIGINT AS missing UNION ALL SELECT 'source', count(*) FILTER (doc_id % 7 = 0 OR source IS NULL OR source = '') FROM documents UNION ALL SELECT 'text', count(*) FILTER (doc_id % 11 = 0 OR text IS NULL OR text = '') FROM documents")
def required_fields(spark, sf_dir):
    """How many rows lack a required field, where every seventh has no source and every eleventh an empty text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).otherwise("").alias("text"))
    return readers.missing_fields(rows, "doc_id", "source", "text")


@query("complete_rows", "SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 0")
def complete_rows(spark, sf_dir):
    """Rows that have what is required, each once; any other would be an error that names the field or the identity."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", "source")
    return readers.required(readers.unique_rows(rows, "source", "doc_id"), "doc_id", "source")


@query("table_digest")
def table_digest(spark, sf_dir):
    return aggregates.table_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("pretoken_counts", f"SELECT unnest(string_split({normal('text')}, ' ')) AS word, count(*) AS n FROM documents GROUP BY 1 HAVING word <> ''")
def pretoken_counts(spark, sf_dir):
    """Counts of pre-tokens over all documents, the first step of vocabulary training."""
    return tokenizing.pretoken_counts(table(spark, sf_dir, "documents"), "text")


@query("digit_pretokens", f"SELECT unnest(string_split(regexp_replace({normal('text')}, '(\\p{{Nd}})', ' \\1 ', 'g'), ' ')) AS word, count(*) AS n FROM documents GROUP BY 1 HAVING word <> ''")
def digit_pretokens(spark, sf_dir):
    """Pre-tokens in which every digit stands alone."""
    return tokenizing.pretoken_counts(table(spark, sf_dir, "documents"), "text", digits=True)


@query("encoded_documents")
def encoded_documents(spark, sf_dir):
    encoded = tokenizing.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return encoded.select("doc_id", F.size("ids").alias("n"), F.element_at("ids", -1).alias("last"))


@query("decoded_documents", "SELECT item_id, text FROM benchmark")
def decoded_documents(spark, sf_dir):
    encoded = tokenizing.encode(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return tokenizing.decode(encoded, "ids").select("item_id", F.col("decoded").alias("text"))


@query("decoded_whole_documents")
def decoded_whole_documents(spark, sf_dir):
    """decoded_documents over the whole documents; a null text counts as empty."""
    encoded = tokenizing.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return tokenizing.decode(encoded, "ids").select("doc_id", F.col("decoded").alias("text"))


@query("corpus_build", f"WITH {_CASCADE_SQL} SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY ALL")
def corpus_build(spark, sf_dir):
    """A whole build with exclusion, exact copies, panels, shards and manifest: the funnel that it publishes."""
    from quern.operators import exclusion
    from quern.plans.build import Config, build

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "source", F.lit(None).cast("string").alias("url"), F.lit("").alias("title"), "text"
    )
    index = exclusion.index_grams(table(spark, sf_dir, "benchmark"), F.col("text"))
    return build(spark, docs, _place(spark), Config(near=False), index)["funnel"].select("source", "reason", "n")


@query("run_record_scan", "SELECT r_regionkey AS step, r_name AS status FROM region")
def run_record_scan(spark, sf_dir):
    """JSON documents under a glob, one row each; every one was published twice, the second in place of the first."""
    place = _place(spark)
    for r in table(spark, sf_dir, "region").collect():  # a table of fixed size
        for status in ("running", r["r_name"]):
            sinks.publish_json(spark, f"{place}/run{r['r_regionkey']}/run.json", {"step": r["r_regionkey"], "status": status})
    return readers.run_records(spark, f"{place}/*/run.json", "step long, status string").select("step", "status")
