"""Sentence chunks with overlap, and their numbering inside a document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators.running import rows_of_wide, segment_offsets

SEGMENT_PAGES = 256


def _bounds(lengths: np.ndarray, size: int, overlap: int) -> list[dict]:
    """First and last sentence (1-based) of each chunk of one page.

    With ``total`` as running sum a chunk from ``first`` reaches as far as the sum
    stays within ``size``; the next one starts at the earliest sentence whose tail
    sum fits ``overlap``.
    """
    total = np.concatenate(([0], np.cumsum(lengths)))
    n, first, fresh, out = len(lengths), 1, 1, []
    while fresh <= n:
        last = max(fresh, int(np.searchsorted(total, size + total[first - 1], side="right")) - 1)
        out.append({"first": first, "last": last})
        tail = int(np.searchsorted(total, total[last] - overlap, side="left")) + 1
        first, fresh = min(max(first, tail), last + 1), last + 1
    return out


def chunk_bounds(lengths: Column, size: int, overlap: int) -> Column:
    """Greedy packing is sequential by nature: only the sentence lengths go to Python."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def bounds(batch: pd.Series) -> pd.Series:
        return batch.map(lambda a: [] if a is None or len(a) == 0 else _bounds(np.asarray(a), size, overlap))

    return bounds(lengths)


def page_chunk_arrays(pages: DataFrame, text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """One row per page with ``contents``, the ordered chunk texts of the page."""
    # no filter on the sentences: it would be pushed below the projection and clean twice
    s = pages.withColumn("sentences", tx.page_sentences(F.col(text)))
    b = s.withColumn("bounds", chunk_bounds(F.transform("sentences", F.length), size, overlap))
    texts = F.transform(
        "bounds",
        lambda x: F.array_join(F.slice(F.col("sentences"), x["first"], x["last"] - x["first"] + 1), " "),
    )
    return b.withColumn("contents", texts).drop("sentences", "bounds")


def chunk_pages(pages: DataFrame, text: str = "raw_text", size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Chunks numbered within their page."""
    arrays = page_chunk_arrays(pages, text, size, overlap)
    return arrays.select("document_id", "page_number", F.posexplode("contents").alias("chunk_index", "content")).select(
        F.format_string("doc%d_p%d_c%d", "document_id", "page_number", "chunk_index").alias("chunk_id"),
        "document_id", "page_number", F.col("chunk_index").cast("long").alias("chunk_index"), "content",
        F.length("content").cast("long").alias("char_count"),
    )


def chunk_documents(merged: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Chunks numbered 0.. through each document.

    Numbers come from per-page counts: pages are numbered inside segments of
    ``SEGMENT_PAGES`` and shifted by the totals of the earlier segments, so a very
    long document is spread over many tasks.
    """
    source = F.coalesce(F.get("source_types", F.lit(0)), F.lit("text"))
    pages = merged.select(  # a blank page yields no chunk
        "document_id", "page_number", "merged_text", source.alias("source_type"),
        F.floor(F.col("page_number") / SEGMENT_PAGES).alias("segment"),
    )
    def counted(p: DataFrame) -> DataFrame:
        arrays = page_chunk_arrays(p, "merged_text", size, overlap).drop("merged_text")
        return arrays.withColumn("n", F.size("contents").cast("long"))

    long_documents = rows_of_wide(pages, ["document_id"], "segment")
    numbered = segment_offsets(
        counted(pages), ["document_id"], "segment", "page_number", "n", "before", counted(long_documents)
    )
    return numbered.select(
        "document_id", "page_number", "source_type", "before", F.posexplode("contents").alias("pos", "content")
    ).select(
        F.format_string("doc%d_c%d", "document_id", F.col("before") + F.col("pos")).alias("chunk_id"),
        "document_id", "page_number", (F.col("before") + F.col("pos")).alias("chunk_index"), "source_type", "content",
        F.length("content").cast("long").alias("char_count"),
    )


def chunk_tables(tables: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """A table stays one chunk up to twice the chunk size; a longer one is chunked as text."""
    columns = ["chunk_id", "document_id", "page_number", "chunk_index", "source_type", "content", "char_count"]
    whole = F.length("table_text") <= size * 2
    kept = tables.filter(whole).select(
        F.format_string("doc%d_p%d_table", "document_id", "page_number").alias("chunk_id"), "document_id", "page_number",
        F.lit(0).cast("long").alias("chunk_index"), F.lit("table").alias("source_type"),
        F.col("table_text").alias("content"), F.length("table_text").cast("long").alias("char_count"),
    )
    split = chunk_pages(tables.filter(~whole), "table_text", size, overlap).withColumn("source_type", F.lit("table"))
    return kept.unionByName(split.select(*columns))
