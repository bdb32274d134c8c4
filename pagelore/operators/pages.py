"""Page extraction, recognition fallback, tables and page merge.

All steps that concern one page stay inside its row; only the steps that bring
several sources of a page together join on (document_id, page_number).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators.running import rows_of_wide, segment_offsets
from pagelore.session import ensure_checkpoint_dir, once

PAGE = ["document_id", "page_number"]
BLOCK_END = r"(?i)</(?:p|div|h[1-6]|li|tr|article|section|title|ul|ol|nav|table)>|<br */?>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
META_FIELDS = ("author", "subject", "creator", "producer")


def html_to_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, BLOCK_END, "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_text(c: Column) -> Column:
    return tx.let(tx.clean_text(c), tx.remove_header_footer)


def page_stats(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Cleaned page text without running headers and footers, and its length."""
    cleaned = pages.withColumn("text", page_text(F.col(text)))
    return cleaned.withColumn("char_count", F.length("text").cast("long"))


def extract_pages(raw: DataFrame) -> DataFrame:
    """Page text from raw HTML with the flags the later steps read."""
    found = page_stats(raw.withColumn("plain", html_to_text(F.col("html"))), "plain")
    return found.select(
        *PAGE, "text", F.col("html").rlike("(?i)<img").alias("has_images"), "char_count",
        F.lit("text").alias("source_type"),
    )


def extract_metadata(raw: DataFrame) -> DataFrame:
    html = F.col("html")
    fields = [
        F.coalesce(
            F.regexp_extract(html, rf'(?is)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1), F.lit("")
        ).alias(name)
        for name in META_FIELDS
    ]
    first = F.struct(
        F.coalesce(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.coalesce(F.regexp_extract(html, r'(?is)<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("language"),
        *fields)
    # the fields are cut out of each page, so that no page text is aggregated or shuffled
    return raw.select("document_id", "page_number", first.alias("first")).groupBy("document_id").agg(
        F.min_by("first", "page_number").alias("first"), F.count(F.lit(1)).alias("page_count")
    ).select("document_id", "first.*", "page_count")


def page_has_tables(pages: DataFrame, text: str = "text") -> DataFrame:
    lines = F.split(tx.strip(F.col(text)), "\n")
    tabular = F.filter(lines, lambda x: (F.size(F.split(x, "  ")) >= 3) | x.contains("\t"))
    return pages.select(*PAGE, (F.size(tabular) > F.size(lines) * 0.3).alias("has_tables"))


def needs_ocr(pages: DataFrame) -> DataFrame:
    """Per document: does recognition have to run, and is there digital text."""
    return pages.groupBy("document_id").agg(
        F.bool_or(F.col("has_images") & (F.col("char_count") < 50)).alias("needs_ocr"),
        (F.sum("char_count") > 100).alias("has_digital_text"),
    )


def ocr_candidates(pages: DataFrame, min_chars: int = fv.MIN_CHARS_FOR_OCR) -> DataFrame:
    flagged = needs_ocr(pages).filter("needs_ocr").select("document_id")
    short = pages.filter(F.col("char_count") < min_chars)
    return short.join(flagged, "document_id", "left_semi").select(*PAGE, "char_count")


def ocr_assemble(detections: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Accepted detections of a page, in reading order, as cleaned text."""
    kept = detections.filter(F.col("confidence") > min_confidence)
    return kept.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda d: d["text"]), "\n").alias("t")
    ).select(*PAGE, tx.clean_text(F.col("t")).alias("text"))


def ocr_fallback(requested: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    p = primary.select(*PAGE, F.col("text").alias("primary_text"))
    f = fallback.select(*PAGE, F.col("text").alias("fallback_text"))
    first = F.when(~tx.is_blank(F.col("primary_text")), F.col("primary_text"))
    return (
        requested.select(*PAGE).join(p, PAGE, "left").join(f, PAGE, "left")
        .select(*PAGE, tx.clean_text(F.coalesce(first, F.col("fallback_text"), F.lit(""))).alias("text"))
    )


# --- tables ------------------------------------------------------------------
def table_to_markdown(headers: Column, rows: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def fitted(row: Column) -> Column:
        gap = F.array_repeat(F.lit(""), F.greatest(F.size(headers) - F.size(row), F.lit(0)))
        return line(F.slice(F.concat(row, gap), F.lit(1), F.size(headers)))

    head = F.array(line(headers), line(F.array_repeat(F.lit("---"), F.size(headers))))
    head = F.when(F.size(headers) > 0, head).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rows, fitted)), "\n")


def table_to_text(headers: Column, rows: Column, markdown: Column) -> Column:
    top = F.array_join(headers, " | ")
    head = F.when(
        F.size(headers) > 0, F.array(top, F.repeat(F.lit("-"), F.length(top)))
    ).otherwise(F.array().cast("array<string>"))
    plain = F.array_join(F.concat(head, F.transform(rows, lambda r: F.array_join(r, " | "))), "\n")
    return F.when(F.coalesce(markdown, F.lit("")) != "", markdown).otherwise(plain)


def tables_from_text(pages: DataFrame, text: str = "text", min_columns: int = 3, min_lines: int = 3) -> DataFrame:
    """Runs of consecutive column-like lines, found inside the page row."""
    cols = F.transform(F.split(F.col(text), "\n"), lambda x: F.split(tx.strip(x), fv.S + "{2,}|\t"))

    def blocks(c: Column) -> Column:
        return tx.let(F.transform(c, lambda x: F.size(x) >= min_columns), lambda wide: cut(c, wide))

    def cut(c: Column, wide: Column) -> Column:
        at = lambda i: F.coalesce(F.get(wide, i), F.lit(False))
        every = F.sequence(F.lit(0), F.size(c) - 1)
        first = F.filter(every, lambda i: at(i) & ~at(i - 1))
        last = F.filter(every, lambda i: at(i) & ~at(i + 1))
        runs = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                        lambda r: r["b"] - r["a"] + 1 >= min_lines)
        return F.transform(runs, lambda r: F.slice(c, r["a"] + 1, r["b"] - r["a"] + 1))

    found = pages.select(*PAGE, F.posexplode(tx.let(cols, blocks)).alias("table_index", "block"))
    return (
        found.select(*PAGE, F.col("table_index").cast("long").alias("table_index"), F.get("block", F.lit(0)).alias("headers"),
                     F.slice("block", F.lit(2), F.size("block")).alias("rows"))
        .withColumn("markdown", table_to_markdown(F.col("headers"), F.col("rows")))
    )


def table_flavour_fallback(found: DataFrame) -> DataFrame:
    """Bordered ("lattice") tables of a document; "stream" ones only where it has none."""
    bordered = found.filter(F.col("flavour") == "lattice")
    others = found.filter(F.col("flavour") == "stream")
    return bordered.unionByName(others.join(bordered.select("document_id").distinct(), "document_id", "left_anti"))


def table_from_cells(grids: DataFrame) -> DataFrame:
    cells = F.transform("cells", lambda row: F.transform(row, tx.strip))
    body = F.filter(
        F.slice("trimmed", F.lit(2), F.size("trimmed")), lambda row: F.exists(row, lambda x: x != "")
    )
    return (
        grids.withColumn("trimmed", cells)
        .withColumn("headers", F.get("trimmed", F.lit(0))).withColumn("rows", body)
        .drop("cells", "trimmed")
        .withColumn("markdown", table_to_markdown(F.col("headers"), F.col("rows")))
    )


def clean_tables(tables: DataFrame) -> DataFrame:
    full_enough = F.filter(
        "rows",
        lambda row: ~(F.size(F.filter(row, lambda x: tx.strip(x) != "")) < F.size(row) * 0.3),
    )
    rows = F.transform(full_enough, lambda row: F.transform(row, tx.clean_text))
    cleaned = tables.withColumn("rows", rows)
    return cleaned.withColumn("markdown", table_to_markdown(F.col("headers"), F.col("rows")))


def tables_by_page(tables: DataFrame, page_counts: DataFrame, max_pages: int = fv.MAX_PAGES_FOR_TABLES) -> DataFrame:
    """Text of a page's tables, each after a line break, for documents short enough."""
    text = table_to_text(F.col("headers"), F.col("rows"), F.col("markdown"))
    short = page_counts.filter(F.col("page_count") <= max_pages).select("document_id")
    return (
        tables.join(short, "document_id", "left_semi")
        .select(*PAGE, "table_index", F.concat(F.lit("\n"), text).alias("t"))
        .groupBy(*PAGE)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "t"))), lambda x: x["t"]), "").alias("table_text"))
    )


# --- merge -------------------------------------------------------------------
def merge_pages(digital: DataFrame, ocr: DataFrame, tables: DataFrame) -> DataFrame:
    o = ocr.select(*PAGE, F.col("text").alias("ocr_text"))
    t = tables.select(*PAGE, "table_text")
    return merge_columns(
        digital.select(*PAGE, "text").join(o, PAGE, "left").join(t, PAGE, "left")
    )


def merge_columns(joined: DataFrame) -> DataFrame:
    """The merge rule over columns text, ocr_text and table_text of one row per page."""
    def present(name: str) -> Column:
        return ~tx.is_blank(F.col(name))

    body = F.when(present("text"), F.col("text")).when(present("ocr_text"), F.col("ocr_text"))
    boxed = F.when(present("table_text"), F.concat(F.lit("\n\n[TABLE]\n"), F.col("table_text"), F.lit("\n[/TABLE]")))
    kinds = F.array_compact(F.array(
        F.when(present("text"), F.lit("text")), F.when(present("ocr_text"), F.lit("ocr")),
        F.when(present("table_text"), F.lit("table")),
    ))
    return joined.select(*PAGE, F.concat_ws("\n\n", body, boxed).alias("merged_text"), kinds.alias("source_types"))


#: Characters of a part of a document, the page that crosses the bound included, and pages that are summed in one task.
PART_CHARS, SEGMENT_PAGES = 1 << 20, 1000


def numbered_parts(pages: DataFrame, size: Column, part_chars: int) -> DataFrame:
    """``part`` for each page: how often ``part_chars`` went into the pages before it.  A long document is many segments and parts."""
    sized = pages.withColumns({"_size": size, "_segment": F.floor((F.col("page_number") - 1) / SEGMENT_PAGES)})
    return segment_offsets(sized, ["document_id"], "_segment", "page_number", "_size", "_before").withColumn(
        "part", F.floor(F.col("_before") / part_chars).cast("long")).drop("_size", "_before")


def full_text(merged: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The marked pages of a document that are not blank, in numbered parts; parts joined by a blank line are the whole text.

    The pages are written to the checkpoint folder once, since it is asked of them which documents are long.  The pages
    of all others meet once, and their parts are put together where they lie.
    """
    spark = merged.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pagelore-pages-{uuid.uuid4().hex}"
    block = F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("merged_text"))
    once(merged, "block", F.when(~tx.is_blank(F.col("merged_text")), block), *PAGE).filter(F.col("block").isNotNull()).write.parquet(path)
    pages, size = spark.read.parquet(path), F.length("block").cast("long")

    def joined(parted: DataFrame) -> DataFrame:
        return parted.groupBy("document_id", "part").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "block"))), lambda x: x["block"]), "\n\n").alias("full_text"))

    long = pages.filter(F.col("page_number") > SEGMENT_PAGES).select("document_id").distinct()
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    short = pages.join(long, "document_id", "left_anti").withColumn(
        "part", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / part_chars).cast("long"))
    whole = rows_of_wide(pages.withColumn("_segment", F.floor((F.col("page_number") - 1) / SEGMENT_PAGES)), ["document_id"], "_segment")
    return joined(short).unionByName(joined(numbered_parts(whole.drop("_segment"), size, part_chars)))


def document_status(documents: DataFrame, merged: DataFrame, errors: DataFrame) -> DataFrame:
    """Page and character totals; a document with an error row has failed."""
    totals = merged.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum(F.length("merged_text")).alias("total_chars")
    )
    failed = errors.groupBy("document_id").agg(F.min("error_message").alias("error_message"))
    return (
        documents.select(F.col("id").alias("document_id")).join(totals, "document_id", "left").join(failed, "document_id", "left")
        .select(
            "document_id", F.coalesce("page_count", F.lit(0)).alias("page_count"),
            F.coalesce("total_chars", F.lit(0)).alias("total_chars"),
            F.when(F.col("error_message").isNotNull(), "failed").otherwise("processed").alias("status"), "error_message",
        )
    )


def single_page_text(requests: DataFrame, pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Cleaned text of the pages asked for; only those are cleaned."""
    found = requests.join(pages.select(*PAGE, F.col(text).alias("_raw")), PAGE, "left")
    return found.select(*requests.columns, F.when(F.col("_raw").isNotNull(), tx.clean_text(F.col("_raw"))).alias("text"))


def page_count(documents: DataFrame, pages: DataFrame) -> DataFrame:
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.select(F.col("id").alias("document_id")).join(counted, "document_id", "left").select(
        "document_id", F.coalesce("n", F.lit(0)).alias("page_count")
    )
