"""Catalog: page extraction, tables, merge and chunk queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import chunks as ch
from pagelore.operators import pages as pg
from pagelore.plans import fixtures as fx


#: Small enough that documents of the test tables have several parts.
PART_CHARS = 2000


def joined(c: str) -> Column:
    return F.array_join(c, " ~ ")


def joined_rows(c: str) -> Column:
    return F.array_join(F.transform(c, lambda r: F.array_join(r, " ~ ")), "\n")


def digital(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned pages with the image flag the recognition steps look at."""
    return pg.page_stats(fx.pages(spark, d)).withColumn(
        "has_images", (F.col("document_id") + F.col("page_number")) % 3 == 0
    ).drop("raw_text")


def merged_digital(spark: SparkSession, d: str) -> DataFrame:
    """Digital pages as merged pages (no recognition, no tables): the text the chunks come from."""
    page = pg.page_stats(fx.pages(spark, d)).withColumn("ocr_text", F.lit("")).withColumn("table_text", F.lit(""))
    return pg.merge_columns(page)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return ch.chunk_documents(merged_digital(spark, d))


def ocr_pages(spark: SparkSession, d: str, engine: str) -> DataFrame:
    return pg.ocr_assemble(fx.detections(spark, d).filter(F.col("engine") == engine))


def grids(spark: SparkSession, d: str) -> DataFrame:
    return fx.material_tables(spark, d)


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Best flavour per document, cleaned, as text per page."""
    found = pg.clean_tables(pg.table_from_cells(pg.table_flavour_fallback(grids(spark, d))))
    counts = fx.page_counts(spark, d)
    return pg.tables_by_page(found, counts)


def merged(spark: SparkSession, d: str) -> DataFrame:
    return pg.merge_pages(digital(spark, d), ocr_pages(spark, d, "primary"), page_tables(spark, d))


def table_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("document_id", "page_number", *extra, joined("headers").alias("headers"), joined_rows("rows").alias("rows"), "markdown")


def q_table_to_text(spark: SparkSession, d: str) -> DataFrame:
    t = pg.table_from_cells(grids(spark, d))
    plain = t.withColumn("markdown", F.when(F.col("document_id") % 2 == 0, F.col("markdown")))
    text = pg.table_to_text(F.col("headers"), F.col("rows"), F.col("markdown"))
    return plain.select("document_id", "flavour", text.alias("table_text"))


def q_merge_pages(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("document_id", "page_number", "merged_text", joined("source_types").alias("source_types"))


def page_requests(spark: SparkSession, d: str) -> DataFrame:
    """Two page requests per document: one that exists and one past most documents."""
    return fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.explode(F.array(F.lit(1).cast("long"), F.col("doc_id") % 5 + 2)).alias("page_number"),
    )


def status_errors(spark: SparkSession, d: str) -> DataFrame:
    return fx.documents(spark, d).filter(F.col("status") == "failed").select(
        F.col("id").alias("document_id"), F.concat(F.lit("Extraction error: "), "original_name").alias("error_message")
    )


QUERIES = {
    "extract_pages": lambda s, d: pg.extract_pages(fx.web_pages(s, d)),
    "extract_metadata": lambda s, d: pg.extract_metadata(fx.web_pages(s, d)),
    "page_has_tables": lambda s, d: pg.page_has_tables(fx.order_sheets(s, d)),
    "page_stats": lambda s, d: pg.page_stats(fx.pages(s, d)).select("document_id", "page_number", "text", "char_count"),
    "needs_ocr": lambda s, d: pg.needs_ocr(digital(s, d)),
    "ocr_candidates": lambda s, d: pg.ocr_candidates(digital(s, d)),
    "ocr_assemble": lambda s, d: pg.ocr_assemble(fx.detections(s, d)),
    "ocr_fallback": lambda s, d: pg.ocr_fallback(
        fx.pages(s, d), ocr_pages(s, d, "primary"), ocr_pages(s, d, "fallback")),
    "tables_from_text": lambda s, d: table_out(pg.tables_from_text(fx.order_sheets(s, d)), "table_index"),
    "table_flavour_fallback": lambda s, d: pg.table_flavour_fallback(grids(s, d)).select(
        "document_id", "page_number", "flavour", F.size("cells").cast("long").alias("n_rows")),
    "table_from_cells": lambda s, d: table_out(pg.table_from_cells(grids(s, d)), "flavour"),
    "table_to_markdown": lambda s, d: pg.tables_from_text(fx.order_sheets(s, d)).select("document_id", "table_index", "markdown"),
    "table_to_text": q_table_to_text,
    "clean_tables": lambda s, d: table_out(pg.clean_tables(pg.tables_from_text(fx.order_sheets(s, d))), "table_index"),
    "tables_by_page": page_tables,
    "merge_pages": q_merge_pages,
    "full_text": lambda s, d: pg.full_text(merged(s, d), PART_CHARS),
    "document_status": lambda s, d: pg.document_status(fx.documents(s, d), merged(s, d), status_errors(s, d)),
    "single_page_text": lambda s, d: pg.single_page_text(page_requests(s, d), fx.pages(s, d)),
    "page_count": fx.page_counts,
    "chunk_pages": lambda s, d: ch.chunk_pages(fx.pages(s, d)),
    "chunk_documents": chunks,
    "chunk_tables": lambda s, d: ch.chunk_tables(page_tables(s, d)),
}
