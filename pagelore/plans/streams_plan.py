"""Catalog: streaming queries, driven to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import cache as ca
from pagelore.plans import fixtures as fx
from pagelore.plans.tables_plan import scratch
from pagelore.streaming import jobs


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; its schema is fixed by the batch reader."""
    return jobs.table_stream(spark, d, name, fx.table(spark, d, name).schema)


def scattered(spark: SparkSession, d: str, name: str, key: str, files: int = 4) -> DataFrame:
    """A table as a stream of several files out of time order, one file a micro-batch."""
    rows = fx.table(spark, d, name)
    folder = scratch(spark, f"landing-{name}")
    rows.withColumn("_file", F.pmod(F.xxhash64(key), F.lit(files))).repartition("_file").write.partitionBy("_file").parquet(folder)
    return jobs.file_stream(spark, f"{folder}/*", "*.parquet", rows.schema, files_per_batch=1)


def arriving(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.expr("concat('doc_', doc_id, CASE WHEN doc_id % 50 = 7 THEN '.txt' ELSE '.pdf' END)").alias("original_name"),
        F.lit("application/pdf").alias("content_type"), F.col("n_chars").alias("file_size"), "text")


def text_pages(batch: DataFrame) -> DataFrame:
    return jobs.merged_text_pages(fx.cut_pages(batch.select(F.col("id").alias("document_id"), "text")))


def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "ingest")
    jobs.ingest(arriving(spark, d), f"{folder}/out", f"{folder}/progress", text_pages)
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def q_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Contents of all documents that no processed document holds yet, with the first that brought them."""
    folder = scratch(spark, "dedupe")
    hashed = scattered(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"),
        F.expr(f"CAST({fx.EPOCH} + doc_id * INTERVAL '1' MINUTE AS timestamp)").alias("arrived_at"))
    done = fx.documents(spark, d).filter("status = 'processed'").select("file_hash")
    jobs.dedupe(hashed, done, folder, f"{folder}/progress", "10 minutes")
    return jobs.first_arrivals(spark, folder).select("file_hash", F.col("id").alias("first_id"))


def q_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "cache")
    asked = scattered(spark, d, "events", "event_id").select(
        "event_id", F.concat("event_type", F.lit("|"), "props").alias("cache_key"), F.col("ts").cast("timestamp").alias("asked_at"))
    jobs.cache_state(asked, folder, f"{folder}/progress")
    return jobs.judged(spark, folder)


def stamped(df: DataFrame) -> DataFrame:
    for c in ("window_start", "window_end"):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df.select("window_start", "window_end", "event_type", "n")


def q_recent_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "recent")
    events = scattered(spark, d, "events", "event_id").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    jobs.recent_activity(events, folder, f"{folder}/progress")
    return stamped(jobs.activity_so_far(spark, folder))


def q_feedback_live(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "feedback")
    rated = fx.feedback_of(source(spark, d, "events"))
    jobs.run_available(jobs.feedback_live(rated), jobs.batch_writer(f"{folder}/out"), f"{folder}/progress", "complete")
    return jobs.newest_batch(spark, f"{folder}/out")


QUERIES = {
    "stream_ingest": q_ingest,
    "stream_dedupe": q_dedupe,
    "cache_hits_ttl": lambda s, d: ca.cache_hits_ttl(fx.cache_requests(s, d)),
    "cache_hits_stream": q_cache_stream,
    "recent_activity": lambda s, d: stamped(jobs.activity_windows(fx.table(s, d, "events"), "ts")),
    "recent_activity_stream": q_recent_stream,
    "feedback_live": q_feedback_live,
}
