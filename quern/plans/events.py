"""Journals and logs: the events table stands for them, users for runs and events for steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators import aggregates, decisions, windows
from quern.plans.base import query, table
from quern.runtime import shared_folder
from quern.sources.readers import listed
from quern.streaming import incremental, keyed


@query("latest_status", "SELECT user_id, count(*) AS events, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    return incremental.latest_status(table(spark, sf_dir, "events"), "user_id", F.col("event_id"), ["event_type", "value"])


@query(
    "run_lifecycle",
    """WITH j AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'stage' END AS e FROM events)
    SELECT user_id, coalesce(arg_max(e, event_id) FILTER (e IN ('completed', 'failed', 'interrupted')), CASE WHEN bool_or(e = 'started') THEN 'running' ELSE 'prepared' END) AS status, count(*) AS events FROM j GROUP BY user_id""",
)
def run_lifecycle(spark, sf_dir):
    kinds = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("stage")
    return incremental.lifecycle(table(spark, sf_dir, "events").withColumn("e", kinds), "user_id", "e", "event_id")


@query("max_fold_counters", "SELECT user_id, max((props->>'$.k')::INT) AS peak, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def max_fold_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return rows.groupBy("user_id").agg(F.max("k").alias("peak"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("upper_median_rate", "SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events WHERE event_id > 1 GROUP BY user_id")
def upper_median_rate(spark, sf_dir):
    return aggregates.upper_median(table(spark, sf_dir, "events").where("event_id > 1"), ["user_id"], "value")


@query("moving_average_50", "SELECT event_id, avg(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS average FROM events")
def moving_average_50(spark, sf_dir):
    """Whole hundredths, so that sums are exact in any order."""
    cents = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return cents.select("event_id", windows.moving_average("cents", ["user_id"], "event_id").alias("average"))


@query("last_write_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_write_wins(spark, sf_dir):
    return windows.last_write(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    "rate_between_logs",
    "SELECT event_id, round((value - lag(value) OVER w) / nullif(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) * 1000000, 9) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
def rate_between_logs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rate = (F.col("value") - F.lag("value").over(w)) / F.nullif(micros - F.lag(micros).over(w), F.lit(0)) * 1000000
    return table(spark, sf_dir, "events").select("event_id", F.round(rate, 9).alias("rate"))


@query(
    "milestones",
    """WITH c AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events)
    SELECT user_id, event_id, CASE WHEN upto - value < 2000 AND 2000 <= upto THEN 2000 WHEN upto - value < 1000 AND 1000 <= upto THEN 1000 WHEN upto - value < 500 AND 500 <= upto THEN 500 END AS milestone
    FROM c WHERE milestone IS NOT NULL""",
)
def milestones(spark, sf_dir):
    """Doubles are added in order of events; where a sum meets a milestone to the cent, the last bit decides, which an engine that adds in blocks may have otherwise."""
    rows = decisions.first_crossing(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", [500, 1000, 2000], exact=False)
    return rows.select("user_id", "event_id", "milestone")


@query("event_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


@query("progress_view", "SELECT user_id, max(event_id) AS step, round(100.0 * max(event_id) / 10000, 4) AS percent, round((10000 - max(event_id)) / (count(*) / 3600.0), 4) AS eta FROM events GROUP BY user_id")
def progress_view(spark, sf_dir):
    step = F.max("event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        step.alias("step"), F.round(100.0 * step / 10000, 4).alias("percent"), F.round((10000 - step) / (F.count(F.lit(1)) / 3600.0), 4).alias("eta")
    )


# ------------------------------------------------------------------- streams


def _place(spark) -> str:
    return f"{shared_folder(spark)}/streams/{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


@query("stream_dedup", "SELECT DISTINCT sha256(trim(regexp_replace(replace(lower(text),'ß','ss'),'\\s+',' ','g'))) AS digest FROM documents".replace("\\\\", "\\"))
def stream_dedup(spark, sf_dir):
    """All documents as a file stream, deduplicated by digest; a second start finds nothing new."""
    place, source = _place(spark), table(spark, sf_dir, "documents")
    for _ in range(2):
        stream = incremental.file_stream(spark, f"{sf_dir}/documents.parquet*", source.schema)
        incremental.run_available(incremental.distinct_documents(stream).select("digest"), incremental.idempotent(f"{place}/out"), f"{place}/checkpoint")
    return spark.read.schema("digest string").parquet(f"{place}/out/batch=*")


def _landed(rows: DataFrame, folder: str, files: int) -> None:
    """Add rows to a folder as just so many files, one a task; empty ones make up for tasks without rows."""
    spark, names = rows.sparkSession, f"{folder}/part-*"
    before = len(listed(spark, names))
    rows.repartition(files).write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)
    for _ in range(before + files - len(listed(spark, names))):
        spark.createDataFrame([], rows.schema).write.mode("append").parquet(folder)


def _in_thirds(spark, sf_dir, place: str, start: Callable[[str, StructType, int], None]) -> DataFrame:
    """Documents with a section as their URL, a third of them a batch; two are there at the first start, one at the second.

    A third is as many files as the input has splits, or the session cores, so that neither its writer nor its readers
    are one task; ``start`` takes so many files a batch.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 400))).alias("url"))
    files = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    for third in range(3):
        _landed(docs.where(F.col("doc_id") % 3 == third), f"{place}/in", files)
        if third:
            start(f"{place}/in", docs.schema, files)
    return spark.read.schema(docs.schema).parquet(f"{place}/out/batch=*").select("doc_id")


@query("stream_near_dedup")
def stream_near_dedup(spark, sf_dir):
    """Documents in three batches; two are there at the first start and one at the second.

    Repeats of digest and section of URL and near copies of earlier batches go; tests hold it against first wins row by row.
    """
    place = _place(spark)

    def start(source: str, schema: StructType, files: int) -> None:
        stream = incremental.file_stream(spark, source, schema, files=files)
        incremental.run_available(stream, incremental.deduplicated(place), f"{place}/checkpoint")

    return _in_thirds(spark, sf_dir, place, start)


@query("stream_keyed_dedup")
def stream_keyed_dedup(spark, sf_dir):
    """Documents in three batches, one of them new at a second start, against keyed state.

    Tests hold it against first wins row by row, where digests and URLs of all rows count and sketches of those that stay.
    """
    place = _place(spark)
    return _in_thirds(spark, sf_dir, place, lambda source, schema, files: keyed.keyed_dedup(spark, source, schema, place, files=files))


@query("decay_plans")
def decay_plans(spark, sf_dir):
    """Events stand for plans that a run reads: which are refused, and why; tests hold it against a fold in plain Python."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), (F.col("event_id") + F.round(F.col("value")).cast("long") % 997 - 50).alias("start"), (F.col("event_id") % 7).alias("steps"))
    return decisions.decay_plans(rows, ["user_id"], "step")


@query("stream_latest_status", "SELECT user_id, count(*) AS events, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_latest_status(spark, sf_dir):
    place, source = _place(spark), table(spark, sf_dir, "events")
    stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet*", source.schema)
    status = incremental.latest_status(stream, "user_id", F.col("event_id"), ["event_type", "value"])
    incremental.run_available(status, incremental.replaced(f"{place}/out"), f"{place}/checkpoint", "complete")
    return spark.read.parquet(f"{place}/out")


@query("stream_funnel", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_funnel(spark, sf_dir):
    place, source = _place(spark), table(spark, sf_dir, "events")
    stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet*", source.schema)
    incremental.run_available(incremental.running_funnel(stream, "event_type"), incremental.replaced(f"{place}/out"), f"{place}/checkpoint", "complete")
    return spark.read.parquet(f"{place}/out")


@query("resume_exactly_once", "SELECT event_id, user_id FROM events")
def resume_exactly_once(spark, sf_dir):
    """Three starts over the same checkpoint: every event is in the sink once."""
    place, source = _place(spark), table(spark, sf_dir, "events")
    for _ in range(3):
        stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet*", source.schema).select("event_id", "user_id")
        incremental.run_available(stream, incremental.idempotent(f"{place}/out"), f"{place}/checkpoint")
    return spark.read.schema("event_id long, user_id long").parquet(f"{place}/out/batch=*")
