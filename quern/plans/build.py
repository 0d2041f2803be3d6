"""Corpus builds end to end: stage, deduplicate, place, encode, shard, publish.

A build reads documents (id, source, url, title, text), rejects in a fixed order of reasons, places the rest
by digest into panels or training, encodes them and writes an index, panels, token shards, a funnel and, last,
a manifest.  A source's ids are one sequence, cut into numbered shards of a fixed number of ids; the index gives
each document's place in it.  A finished build of the same configuration is not repeated; another configuration in its place
is an error.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import PANELS, blocked_host, canonical_url, digest, host, normalize, normalize_exact, panel_of, title_key
from quern.operators import dedup, exclusion, filters, tokenizing, windows
from quern.plans import ranged
from quern.runtime import cut, release, written
from quern.sources import ranges, sinks


#: Early reasons of each kind of build, in order; all but the reused corpus go on to exact copies, URLs and near copies.
CASCADES = {
    "new": ("length", "domain_blocklist", "benchmark_exact"),
    "extension": ("length", "benchmark_exact", "prefer_origin"),
    "reused": ("domain_blocklist",),
}


@dataclass(frozen=True)
class Config:
    """What a build depends on; two builds with one digest give one result."""

    cascade: str = "new"
    blocklist: tuple[str, ...] = ()
    avoid: str = ""  # a part of URLs that the extension leaves to their origin
    least_chars: int = filters.LEAST_CHARS
    most_chars: int = filters.MOST_CHARS
    near: bool = True
    exact_text: bool = False  # NFKC and full case folding in an Arrow UDF
    panel_quota: int = 100
    shard_tokens: int = 1 << 26  # 128 MB of two-byte ids
    tokenizer: str | None = None
    panels: tuple[str, ...] = field(default=tuple(PANELS))


def inherited(own: dict, load) -> dict:
    """A configuration over the one that it names under ``inherits``; the nearer value wins, whole values at a time."""
    chain, seen = [own], {id(own)}
    while parent := chain[-1].get("inherits"):
        config = load(parent)
        if id(config) in seen or len(chain) > 32:
            raise ValueError(f"{parent} inherits from itself")
        seen.add(id(config))
        chain.append(config)
    merged: dict = {}
    for config in reversed(chain):
        merged |= {k: v for k, v in config.items() if k != "inherits"}
    return merged


def contract(config: Config | dict) -> str:
    """Digest of a configuration, stored beside what was built from it."""
    record = config if isinstance(config, dict) else asdict(config)
    return hashlib.sha256(json.dumps(record, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def prior_sketches(prior: DataFrame | None) -> DataFrame | None:
    """(pos, sketch) of a prior corpus that has its sketches or texts; none of one that has neither."""
    if prior is None or not {"sketch", "text"} & set(prior.columns):
        return None
    return prior.select("pos", "sketch") if "sketch" in prior.columns else dedup.sketches(prior, "pos")


def reasons(docs: DataFrame, index: DataFrame | None, titles: DataFrame | None, prior: DataFrame | None, config: Config) -> DataFrame:
    """Documents (pos, id, source, url, title, text) with a digest and the first reason against them.

    For new documents: length, blocklist, benchmark, exact copy, same URL, near copy; null for those that stay.  Other
    cascades are listed in CASCADES.  Rows of the
    prior corpus (digest, url and, where near copies of it go too, pos and text or sketch) come before all others.
    """
    normal = normalize_exact if config.exact_text else normalize
    # Everything that needs a text is computed in the scan, so that no text crosses the joins.
    rows = docs.withColumns({
        "digest": digest(normal(F.coalesce("text", F.lit("")))),
        "page": canonical_url(F.col("url")),
        "chars": F.length("text"),
        "__length": ~filters.length_ok(F.col("text"), config.least_chars, config.most_chars),
        "__key": title_key(F.coalesce("title", F.lit(""))) if titles is not None else F.lit(None).cast("string"),
    }).drop("text")
    hit = F.lit(False)
    if index is not None:
        found = exclusion.contaminated(docs, "pos", index).withColumn("__gram", F.lit(True))
        rows, hit = rows.join(found, "pos", "left"), hit | F.coalesce("__gram", F.lit(False))
    if titles is not None:
        known = titles.select(F.col("title").alias("__key"), F.lit(True).alias("__title")).distinct()
        rows = rows.join(known, "__key", "left")
        hit = hit | F.coalesce("__title", F.lit(False))
    checks = {
        "length": F.col("__length"),
        "domain_blocklist": blocked_host(host(F.col("url")), list(config.blocklist)),
        "benchmark_exact": hit,
        "prefer_origin": F.contains("page", F.lit(config.avoid)) if config.avoid else F.lit(False),
    }
    early = filters.first_reason(*((checks[name], name) for name in CASCADES[config.cascade]))
    staged = cut(rows.select("pos", "id", "source", "url", "page", "digest", "chars", early.alias("early")))
    if config.cascade == "reused":
        return staged.withColumnRenamed("early", "reason").drop("page")
    passing = staged.where("early IS NULL").select("pos", "digest", F.col("page").alias("u"), F.lit(1).alias("prior"))
    if prior is not None:
        old = prior.select(F.lit(None).cast("long").alias("pos"), "digest", canonical_url(F.col("url")).alias("u"), F.lit(0).alias("prior"))
        passing = passing.unionByName(old)
    ordered = passing.withColumn("__order", F.struct("prior", "pos"))
    late = cut(dedup.exact_and_url_reasons(ordered, "digest", "u", "__order").where("prior = 1").select("pos", F.col("reason").alias("late")))
    merged = staged.join(late, "pos", "left").withColumn("reason", F.coalesce("early", "late")).drop("early", "late", "page")
    if not config.near:
        return merged
    open_rows = merged.where("reason IS NULL").select("pos").join(docs.select("pos", "text"), "pos")
    near = cut(dedup.near_reasons(dedup.sketches(open_rows, "pos"), "pos", prior_sketches(prior)))
    marked = merged.join(near, "pos", "left")
    return marked.withColumn("reason", F.coalesce("reason", F.when(F.col("near"), "approximate_near_document"))).drop("near")


def build(
    spark: SparkSession,
    docs: DataFrame,
    folder: str,
    config: Config,
    index: DataFrame | None = None,
    titles: DataFrame | None = None,
    prior: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Write the tables index, panels, shards and funnel under ``folder`` and publish their manifest."""
    want = contract(config)
    try:
        done = spark.read.text(f"{folder}/contract").first()["value"]
    except Exception as e:  # the reader's own error for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    if done == want:
        return sinks.open_manifest(spark, folder)
    if done is not None:
        raise ValueError("the folder holds a build of another configuration")
    placed = cut(reasons(docs, index, titles, prior, config).withColumn("panel", panel_of(F.col("digest"), list(config.panels))))
    kept = placed.where("reason IS NULL").join(docs.select("pos", "text"), "pos")
    # Ids are encoded once and kept packed: a checkpoint of lists of four-byte ids is several times the texts.
    packed = tokenizing.encode_packed(kept, "text", config.tokenizer).drop("text")
    encoded = written(packed.withColumn("length", F.floor(F.octet_length("packed") / 2)))
    release(spark)
    rank = F.row_number().over(Window.partitionBy("source", "panel").orderBy("digest", "pos"))
    panels = encoded.where("panel IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= config.panel_quota).drop("rank", "length")
    train = encoded.where("panel IS NULL")
    entries = train.select("pos", "id", "source", "url", "digest", "chars", "length")
    entries = windows.sums_before(entries, ["source"], ["pos"], offset="length").withColumn("number", F.floor(F.col("offset") / config.shard_tokens))
    tables = {
        "index": entries,
        "panels": tokenizing.unpacked(panels, "tokens"),
        "shards": sinks.numbered_shards(train, "source", "pos", "packed", config.shard_tokens),
        "funnel": filters.funnel(placed, ["source"]),
    }
    sinks.publish_manifest(spark, tables, folder)
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/contract")
    return sinks.open_manifest(spark, folder)


def main(arguments: list[str]) -> None:
    """``python -m quern.plans.build CONFIG.json [STAGE [SOURCES]]``: documents, benchmark, prior, titles, out and the fields of Config.

    STAGE is new, extension or reused in place of the configuration's cascade, manifest, which shows what is built, or
    ranges, which builds the JSON lines of ``files`` (a list of paths for each source) by byte range and goes on where it was
    stopped.  SOURCES, parted by commas, names the ones to build now.  ``prior`` is a table of digest and url, and pos and
    text or sketch where its near copies go too; ``titles`` one of held-out titles.
    """
    with open(arguments[0], encoding="utf-8") as f:
        settings = inherited(json.load(f), lambda path: json.load(open(path, encoding="utf-8")))
    spark = SparkSession.builder.appName("quern build").getOrCreate()
    stage = arguments[1] if len(arguments) > 1 else settings.get("cascade", "new")
    if stage == "manifest":
        for table, df in sinks.open_manifest(spark, settings["out"]).items():
            print(table, df.count())
        return
    sources = arguments[2].split(",") if len(arguments) > 2 else None
    if stage == "ranges":
        work = ranged.reused_rows(tuple(settings.get("blocklist", ())), settings.get("tokenizer"))
        schema = settings.get("schema", "id string, url string, title string, text string")
        made = ranged.build_parts(spark, settings["files"], settings["out"], schema, work, settings.get("range_bytes", ranges.RANGE_BYTES), sources=sources)
        print("parts", len(made))
        for r in ranged.built(spark, settings["out"]).groupBy("source", "reason").count().orderBy("source", "reason").collect():
            print(r["source"], r["reason"] or "kept", r["count"])
        return
    settings["cascade"] = stage
    docs = spark.read.parquet(settings.pop("documents"))
    bench, out = settings.pop("benchmark", None), settings.pop("out")
    for column in ("url", "title"):
        if column not in docs.columns:
            docs = docs.withColumn(column, F.lit(None).cast("string"))
    name = "id" if "id" in docs.columns else "doc_id"
    docs = docs.select(F.col(name).alias("pos"), F.col(name).cast("string").alias("id"), "source", "url", "title", "text")
    index = exclusion.index_grams(spark.read.parquet(bench), F.col("text")) if bench else None
    if sources is not None:
        docs = docs.where(F.col("source").isin(sources))
    prior, titles = (spark.read.parquet(path) if path else None for path in (settings.pop("prior", None), settings.pop("titles", None)))
    if titles is not None:
        titles = titles.select(title_key(F.col("title")).alias("title"))
    config = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
    for table, df in build(spark, docs, out, config, index, titles, prior).items():
        print(table, df.count())


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
