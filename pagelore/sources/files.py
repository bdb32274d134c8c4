"""Reading and writing uploads, tables, processed pages, chunks and vectors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore import schemas
from pagelore.operators import pages as pg


# --- uploads -------------------------------------------------------------------
def scan_uploads(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Landed files; Spark reads the bytes only when ``content`` is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path", "length", F.col("modificationTime").alias("modified_at"), "content")


def safe_filename(c: Column) -> Column:
    """Decomposed name with anything but word characters, dots and dashes turned into underscores."""

    @F.pandas_udf("string")
    def decomposed(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))

    c = F.regexp_replace(decomposed(c), rf"[^\p{{L}}\p{{N}}_.\-]", "_")
    return F.trim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


# --- relational tables -------------------------------------------------------------
def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the thirteen tables with its fixed schema; filters and columns reach the scan."""
    return spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    schemas.conform(df, name).write.mode("overwrite").parquet(f"{folder}/{name}")


# --- processed pages ---------------------------------------------------------------
def write_processed(merged: DataFrame, documents: DataFrame, folder: str, processed_at: str, version: int = 1,
                    part_chars: int = pg.PART_CHARS) -> None:
    """JSON lines partitioned by version: a document is one object, or, if it is long, several with numbered parts of its pages.

    The objects are written in order of document and part.  A part has ``part_chars`` characters and a page at most.
    """
    page = F.struct("page_number", "merged_text", "source_types")
    parted = pg.numbered_parts(merged.select("document_id", *page_columns()), F.length("merged_text").cast("long"), part_chars)
    parts = parted.groupBy("document_id", "part").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy("document_id").agg(F.sum("n").alias("page_count"))
    names = documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("filename"))
    parts.join(totals.join(names, "document_id"), "document_id").select(
        "document_id", "part", "filename", "page_count", F.lit(version).alias("version"),
        F.create_map(F.lit("title"), F.col("filename")).alias("metadata"), "pages", F.lit(processed_at).alias("processed_at"),
    ).repartitionByRange("document_id", "part").sortWithinPartitions("document_id", "part").write.mode("overwrite").partitionBy("version").json(folder)


def page_columns() -> tuple[str, ...]:
    return ("page_number", "merged_text", "source_types")


def read_processed(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the stored JSON objects, whatever part they are in."""
    stored = spark.read.schema(schemas.PROCESSED).json(folder)
    return stored.select("document_id", "filename", "version", F.explode("pages").alias("p")).select(
        "document_id", "filename", "version", "p.page_number", "p.merged_text", "p.source_types")


# --- chunks and vectors ------------------------------------------------------------
def write_batch(rows: DataFrame, folder: str, batch_id: int, documents: DataFrame | None = None) -> None:
    """Rows of some documents as one batch of a store.

    Nothing outside the batch is touched: a document that is written again is superseded when the
    store is read, all others stay.  A repeated run under the same batch id replaces its own files.
    ``documents`` (``document_id``) are all that the batch covers; one without rows is then emptied.
    """
    tagged = rows.withColumn("_covered", F.lit(False))
    if documents is not None:
        tagged = tagged.unionByName(documents.select("document_id").distinct().withColumn("_covered", F.lit(True)), allowMissingColumns=True)
    tagged.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document the rows of the newest batch that covers it."""
    stored = spark.read.parquet(folder)
    newest = stored.groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    return stored.join(newest, ["document_id", "batch_id"], "left_semi").filter(~F.col("_covered")).drop("batch_id", "_covered")


def delete_documents(spark: SparkSession, folder: str, batch_id: int, documents: DataFrame) -> None:
    """Tombstones: a batch that covers ``documents`` (``document_id``) and has no rows of them; ``compact`` drops both."""
    layout = spark.read.parquet(folder).drop("batch_id", "_covered").schema
    write_batch(spark.createDataFrame([], layout), folder, batch_id, documents)


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The newest rows as the first batch of a new store, for when superseded rows weigh too much."""
    write_batch(read_newest(spark, folder), target, 0)


def write_chunks(chunks: DataFrame, folder: str, batch_id: int, documents: DataFrame | None = None) -> None:
    write_batch(chunks.withColumn("embedding_id", F.col("chunk_id")), folder, batch_id, documents)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read_newest(spark, folder).drop("embedding_id")


def write_vectors(vectors: DataFrame, folder: str, batch_id: int, documents: DataFrame | None = None) -> None:
    """Ids, vectors, text and metadata."""
    write_batch(vectors.selectExpr(*[c.split(" ")[0] for c in schemas.CHUNK_VECTORS.split(", ")]), folder, batch_id, documents)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    columns = [c.split(" ")[0] for c in schemas.CHUNK_VECTORS.split(", ")]
    return read_newest(spark, folder).select(*columns)
