"""Streaming forms of ingestion, de-duplication, cache state and live counts.

Every job reads a folder as a stream, keeps its progress in a checkpoint folder and
writes each micro-batch under its own batch id, so a batch that is run again after a
failure replaces its own output.

Rows may come in any order.  ``note_late`` keeps a mark of the newest time so far and writes the rows of a batch that are
further behind it than the delay to a side table, where they can be counted.  No row is dropped for being late: a batch
is folded into what is stored (first arrivals by content, judged requests by key, partial counts by window), and only
the contents, keys and windows that it touches are judged again.  Readers take the newest version of a row, so the
result at any time is that of one batch job over all rows so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.operators import activity as ac
from pagelore.operators import cache as ca
from pagelore.operators import chunks as ch
from pagelore.operators import maintenance as mt
from pagelore.operators import pages as pg


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """``name``.parquet of a folder as a stream: one file, or a folder of files as Spark writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return file_stream(spark, f"{folder}/{name}.parquet", "*.parquet", schema)
    return file_stream(spark, folder, f"{name}.parquet", schema)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop; on a cluster the same job runs with its usual trigger."""
    query = (stream.writeStream.foreachBatch(write).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def batch_writer(folder: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def newest_batch(spark: SparkSession, folder: str) -> DataFrame:
    """For complete mode: the newest batch holds the whole result.  Earlier ones stay for those who read them."""
    stored = spark.read.parquet(folder)
    return stored.join(F.broadcast(stored.agg(F.max("batch_id").alias("batch_id"))), "batch_id", "left_semi").drop("batch_id")


def ingest(uploads: DataFrame, folder: str, checkpoint: str, to_pages: Callable[[DataFrame], DataFrame]) -> None:
    """Landing uploads -> validated -> hashed -> chunks.

    uploads: id, original_name, content_type, file_size, text; ``to_pages`` gives merged pages.
    """
    def prepare(batch: DataFrame) -> DataFrame:
        good = mt.validate_uploads(batch).filter("reject_reason IS NULL")
        hashes = good.select(F.col("id").alias("document_id"), F.sha2("text", 256).alias("file_hash"))
        return ch.chunk_documents(to_pages(good)).join(hashes, "document_id")

    run_available(uploads, batch_writer(folder, prepare), checkpoint)


def merged_text_pages(pages: DataFrame) -> DataFrame:
    """Merged pages of plain text pages (no recognition, no tables)."""
    return pg.merge_columns(pg.page_stats(pages).withColumn("ocr_text", F.lit("")).withColumn("table_text", F.lit("")))


# --- late rows -------------------------------------------------------------------
def stored(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """A table of batches, or only those before a batch; None where nothing is stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(folder)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def note_late(batch: DataFrame, batch_id: int, folder: str, time: str, delay: str) -> None:
    """Set this batch's mark and copy its late rows to ``late``; a batch that runs again replaces both.

    A row is late if its time is more than ``delay`` behind the newest time of the batches before.
    """
    spark = batch.sparkSession
    marks = stored(spark, f"{folder}/marks", batch_id)
    batch.agg(F.max(time).alias("newest"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/marks/batch_id={batch_id}")
    if marks is not None:
        bound = marks.agg(F.max("newest") - F.expr(f"INTERVAL {delay}")).scalar()
        batch.filter(F.col(time) < bound).write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_id``, ``n_rows``, ``n_late`` of every batch of a job."""
    marks = spark.read.parquet(f"{folder}/marks").select("batch_id", F.col("n").alias("n_rows"))
    late = stored(spark, f"{folder}/late")
    if late is None:
        return marks.withColumn("n_late", F.lit(0).cast("long"))
    counts = late.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_late"))
    return marks.join(counts, "batch_id", "left").withColumn("n_late", F.coalesce("n_late", F.lit(0)))


# --- first arrivals --------------------------------------------------------------
ARRIVAL = "struct(arrived_at, id)"


def dedupe(uploads: DataFrame, stored_hashes: DataFrame, folder: str, checkpoint: str, delay: str = "30 days") -> None:
    """First arrival of each content that is not stored already (uploads: id, file_hash, arrived_at).

    A batch writes the contents that are new, and those of which it brings an earlier arrival than the one known.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        note_late(batch, batch_id, folder, "arrived_at", delay)
        firsts = batch.groupBy("file_hash").agg(F.min(F.expr(ARRIVAL)).alias("first")).join(stored_hashes.select("file_hash").distinct(), "file_hash", "left_anti")
        known = stored(batch.sparkSession, f"{folder}/firsts", batch_id)
        if known is not None:
            known = known.groupBy("file_hash").agg(F.min(F.expr(ARRIVAL)).alias("known"))
            firsts = firsts.join(known, "file_hash", "left").filter(F.col("known").isNull() | (F.col("first") < F.col("known")))
        firsts.select("file_hash", "first.*").write.mode("overwrite").parquet(f"{folder}/firsts/batch_id={batch_id}")
        batch.unpersist()

    run_available(uploads, write, checkpoint)


def first_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """``file_hash``, ``arrived_at``, ``id`` of the first arrival of each content so far."""
    return spark.read.parquet(f"{folder}/firsts").groupBy("file_hash").agg(F.min(F.expr(ARRIVAL)).alias("first")).select("file_hash", "first.*")


# --- cache -----------------------------------------------------------------------
def cache_state(requests: DataFrame, folder: str, checkpoint: str, ttl_seconds: int = fv.CACHE_TTL_SECONDS, delay: str = "1 hour") -> None:
    """Hit or miss per request (event_id, cache_key, asked_at), by the batch operator over the keys that a batch touches.

    A key is judged again from its first new request on; the last set ahead of that is a stored miss at most one
    life time older.  Judged requests are stored by day, so a batch in order reads the newest days only and a late one
    as far back as it is late.
    """
    ttl = ttl_seconds * 1_000_000
    day = F.floor(F.col("at") / 86_400_000_000).cast("long")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        note_late(batch, batch_id, folder, "asked_at", delay)
        asked = batch.select("event_id", F.coalesce("cache_key", F.lit("")).alias("cache_key"), F.unix_micros("asked_at").alias("at"))
        rows, known = asked, stored(spark, f"{folder}/judged", batch_id)
        since = asked.groupBy("cache_key").agg(F.min("at").alias("since"))
        oldest = since.agg(F.min("since")).first()[0]  # one value
        if known is not None and oldest is not None:
            near = newest_judged(known.filter(F.col("day") >= (oldest - ttl) // 86_400_000_000)).join(since, "cache_key").filter(F.col("at") >= F.col("since") - ttl)
            sets = near.filter((F.col("at") < F.col("since")) & ~F.col("is_hit")).groupBy("cache_key").agg(F.max("at").alias("before"))
            again = near.filter(F.col("at") >= F.col("since")).select("event_id", "cache_key", "at")
            rows = asked.unionByName(again).join(sets, "cache_key", "left")
        ca.judge_requests(rows, ttl_seconds).withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/judged/batch_id={batch_id}")
        batch.unpersist()

    run_available(requests, write, checkpoint)


def newest_judged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_id", "cache_key", "at").agg(F.max_by("is_hit", "batch_id").alias("is_hit"))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id``, ``cache_key``, ``is_hit`` of all requests so far."""
    return newest_judged(spark.read.parquet(f"{folder}/judged")).drop("at")


# --- counts ----------------------------------------------------------------------
def activity_windows(events: DataFrame, time: str, size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Rolling counts per kind; the same expression serves the batch and the stream."""
    return events.groupBy(F.window(time, size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")


def recent_activity(events: DataFrame, folder: str, checkpoint: str, delay: str = "1 day") -> None:
    """Partial counts of the windows that a batch touches, open windows too (events: event_type, at)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        note_late(batch, batch_id, folder, "at", delay)
        activity_windows(batch, "at").write.mode("overwrite").parquet(f"{folder}/counts/batch_id={batch_id}")
        batch.unpersist()

    run_available(events, write, checkpoint)


def activity_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/counts").groupBy("window_start", "window_end", "event_type").agg(F.sum("n").alias("n"))


def feedback_live(feedback: DataFrame) -> DataFrame:
    """Running totals over the feedback stream (one row of state)."""
    return feedback.agg(*ac.feedback_aggregates())
