"""From documents to packed sequences: toxicity, exact copies, near copies, source mix, packing.

Each stage reads what the one before it wrote and keeps the columns of documents, but for the last,
which returns the pieces of the packed sequences.  Rows are told apart by id and text, so that rows
that repeat an id keep their own decisions; of rows that repeat both, the stages keep one.

Results that are defined: a null text counts as an empty one, and of all of these one row stays; a null id is an id
like any other, below all others; ties of scores and ids fall as the operators say; texts of any length pass whole;
extra columns are carried along, whatever their names; an empty table passes every stage without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.llm.exact_dedup import exact_dedup
from quern.llm.mixing import first_words, mix_sources
from quern.llm.packing import pack
from quern.llm.simhash import simhash_components
from quern.llm.toxicity import score, train
from quern.runtime import cut, read, shared_folder

#: Documents whose score reaches this are rejected.
TOXIC = 0.5
#: Texts that share so much of their five-word shingles are near copies.
SIMILARITY = 0.8


def _with_decisions(docs: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Join decisions (doc_id, text_key, ...) to their documents; both keys may be null or repeat.

    The decisions' columns get a prefix that no column of the documents has.
    """
    mark = unused(docs.columns)
    keyed = docs.withColumn(f"{mark}key", F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = decisions.select(F.col("doc_id").alias(f"{mark}id"), F.col("text_key").alias(f"{mark}text"), *(F.col(c).alias(f"{mark}{c}") for c in columns))
    same = keyed["doc_id"].eqNullSafe(F.col(f"{mark}id")) & (keyed[f"{mark}key"] == F.col(f"{mark}text"))
    return keyed.join(chosen, same).drop(f"{mark}key", f"{mark}id", f"{mark}text")


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents of the rows that are kept, one row for each."""
    chosen = decisions.where("kept").select("doc_id", "text_key")
    repeated = cut(decisions.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"))
    if repeated.isEmpty():
        return _with_decisions(docs, chosen, [])
    marked = chosen.join(repeated.withColumn("again", F.lit(True)).withColumnRenamed("doc_id", "r").withColumnRenamed("text_key", "k"), F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("text_key") == F.col("k")), "left")
    marked = cut(marked.select("doc_id", "text_key", F.coalesce("again", F.lit(False)).alias("again")))
    single = _with_decisions(docs, marked.where("not again"), [])
    return single.unionByName(_with_decisions(docs, marked.where("again"), []).dropDuplicates(["doc_id", "text"]))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "toxic")
    model = train(docs.select("doc_id", "text"), labels)
    columns, name = docs.columns, unused(docs.columns) + "score"
    return score(docs, model, columns, "text", name).where(F.col(name) < TOXIC).select(columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return _keep(docs, exact_dedup(docs)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id.

    Near copies are within the operator's radius, or share 0.8 of their five-word shingles.
    """
    return _keep(docs, simhash_components(docs, similarity=SIMILARITY)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last copy at a source's budget is cut after its last word."""
    taken = mix_sources(docs).where("taken > 0").groupBy("doc_id", "text_key").agg(F.max("taken").alias("taken"), F.max("size").alias("size"))
    joined, mark = _with_decisions(docs, taken, ["taken", "size"]), unused(docs.columns)
    all_words, size, copy = F.col(f"{mark}taken"), F.col(f"{mark}size"), f"{mark}copy"
    copies = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(all_words / size).cast("long"))))
    left = all_words - (F.col(copy) - 1) * size
    whole = left >= size
    text = F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), left.cast("int")))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: The classifier, XXH64 fingerprints and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline/{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
