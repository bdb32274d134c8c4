"""Views that give the driver's tables the shape of the document tables (V1-V15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import text as tx
from pagelore.session import spread

LINES_PER_PAGE = 20
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
AS_OF_EVENTS = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, spread over the cores: the stages behind it are CPU bound."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.expr(
            "CASE c_mktsegment WHEN 'MACHINERY' THEN 'teacher' WHEN 'HOUSEHOLD' THEN 'researcher' "
            "WHEN 'FURNITURE' THEN 'admin' ELSE 'student' END"
        ).alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.expr(f"{EPOCH} + c_custkey * INTERVAL '1' HOUR").alias("created_at"),
    )


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's own row gives without a join, its text hashed and its pages counted at the scan."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr(
            "concat('doc_', doc_id, CASE WHEN doc_id % 50 = 7 THEN '.txt' ELSE '.pdf' END)"
        ).alias("original_name"),
        F.col("n_chars").alias("file_size"),
        F.expr("CAST(substr(source, 4) AS BIGINT)").alias("owner_id"),
        "lang",
        F.expr(f"{EPOCH} + doc_id * INTERVAL '1' MINUTE").alias("created_at"),
        F.sha2("text", 256).alias("file_hash"),
        page_count(F.col("text")).alias("page_count"),
        "text",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their status.  Texts are dropped before the join wherever a query does not select them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = document_rows(spark, sf_dir)
    return docs.join(labels, docs["id"] == labels["doc_id"], "left").select(
        "id", "original_name", "file_size", "owner_id", "lang",
        F.expr(
            "CASE WHEN quality IS NULL THEN 'uploaded' WHEN toxic = 1 THEN 'failed' "
            "WHEN quality = 1 THEN 'processed' ELSE 'processing' END"
        ).alias("status"),
        "created_at", "text", "file_hash",
    )


def page_count(text: Column) -> Column:
    """Pages of a text by its lines; a null text has none."""
    return F.coalesce(F.floor((F.size(F.split(text, "\n")) - 1) / LINES_PER_PAGE) + 1, F.lit(0)).cast("long")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rows(spark, sf_dir).select(F.col("id").alias("document_id"), "page_count")


def cut_pages(texts_df: DataFrame) -> DataFrame:
    """Twenty lines make a page; cut inside the row, so no shuffle is needed."""
    numbered = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_PER_PAGE).cast("int")),
        lambda i: F.struct(
            (i + 1).alias("page_number"),
            F.array_join(F.slice(F.col("lines"), i * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n").alias("raw_text"),
        ),
    )
    return (
        texts_df.select("document_id", F.split("text", "\n").alias("lines"))
        .select("document_id", F.explode(numbered).alias("p"))
        .select("document_id", F.col("p.page_number").cast("long").alias("page_number"), "p.raw_text")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_pages(texts(spark, sf_dir).withColumnRenamed("doc_id", "document_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("long").alias("document_id")
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("id"),
        F.col("conv_id").alias("session_id"),
        F.expr("conv_id % 20").alias("user_id"),
        "turn", "role", F.col("text").alias("content"),
        F.expr("CASE WHEN role = 'assistant' THEN CAST(length(text) % 100 AS DOUBLE) / 100 END").alias("confidence"),
        F.expr(f"{EPOCH} + (conv_id * 60 + turn) * INTERVAL '1' MINUTE").alias("created_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: the title is the head of its first user turn."""
    m = messages(spark, sf_dir)
    first_user = F.when(F.col("role") == "user", F.col("turn"))
    return m.groupBy(F.col("session_id").alias("id"), "user_id").agg(
        F.substring(F.min_by("content", first_user), 1, 100).alias("title"),
        F.min("created_at").alias("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_of(table(spark, sf_dir, "events"))


def feedback_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), "user_id",
        F.expr("CASE WHEN event_type <> 'signup' THEN CAST(1 + event_id % 5 AS INT) END").alias("rating"),
        F.col("event_type").isin("view", "purchase").alias("helpful"),
        F.concat("event_type", F.lit(" "), "props").alias("query"),
        F.col("props").alias("comment"), F.col("ts").alias("created_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.expr("o_orderkey % 200").alias("document_id"),
        F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END").alias("due_date"),
        F.expr(
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' "
            "WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END"
        ).alias("priority"),
        F.expr(
            "CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'in_progress' ELSE 'done' END"
        ).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def task_as_of(spark: SparkSession, sf_dir: str):
    """Latest order date less ninety days (one value read back for the parameter)."""
    value = table(spark, sf_dir, "orders").select(
        F.date_format(F.expr("max(o_orderdate) - INTERVAL '90' DAY"), "yyyy-MM-dd HH:mm:ss")
    ).first()[0]
    return F.lit(value).cast("timestamp_ntz")


def progress_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.expr("l_partkey % 200").alias("document_id"),
        F.col("l_linenumber").cast("long").alias("last_page"), F.col("l_quantity").cast("long").alias("total_pages"),
        (F.col("l_returnflag") == "R").alias("completed"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("version_key"), F.col("l_shipdate").alias("updated_at"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.explode(F.array("lang", "source")).alias("tag")
    )


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turn with the turn before it; turns are consecutive, so an equi-join finds it."""
    m = messages(spark, sf_dir)
    before = m.select("session_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("query"))
    return (
        m.filter(F.col("role") == "assistant").join(before, ["session_id", "turn"])
        .select("id", "user_id", "session_id", "query", F.col("content").alias("answer"), "confidence", "created_at")
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.expr("l_partkey % 200").alias("document_id"),
        F.col("l_suppkey").alias("user_id"), F.col("l_linenumber").cast("long").alias("page_number"),
        F.concat("l_returnflag", "l_linestatus").alias("content"),
        F.lit(None).cast("string").alias("highlight_text"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'green' END").alias("color"),
        F.col("l_shipdate").alias("created_at"),
    )


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat("event_type", F.lit("|"), "props").alias("cache_key"), "ts"
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        texts(spark, sf_dir)
        .select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .select(
            "document_id", (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).alias("page_number"), "pos", "text",
            F.expr("CASE WHEN pos % 3 = 0 THEN 'fallback' ELSE 'primary' END").alias("engine"),
            F.expr("CAST((length(text) * 7 + pos * 13) % 100 AS DOUBLE) / 100").alias("confidence"),
        )
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to score: assistant turn, the question before it, a document as source."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("sources"))
    return bookmarks(spark, sf_dir).join(source, "session_id", "left").select(
        F.col("id").alias("answer_id"), "query", "answer",
        F.coalesce("sources", F.lit("")).alias("sources"), F.col("query").alias("reference"),
    )


def material_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell grids of "lattice" and "stream" flavour made from document lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: tx.words(x)), lambda ws: F.size(ws) > 0)
    return (
        texts(spark, sf_dir)
        .select(F.col("doc_id").alias("document_id"), lines.alias("cells"))
        .filter(F.size("cells") > 1)
        .withColumn("page_number", F.col("document_id") % 3 + 1)
        .withColumn("flavour", F.expr("CASE WHEN document_id % 4 = 0 THEN array('stream') "
                                      "WHEN document_id % 4 = 1 THEN array('lattice') "
                                      "ELSE array('lattice', 'stream') END"))
        .select("document_id", "page_number", F.lit(0).alias("table_index"), F.explode("flavour").alias("flavour"), "cells")
    )


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small page per order with columns set apart by two blanks or a tab."""
    line = F.when(F.col("o_orderkey") % 5 == 0, F.lit("\t")).otherwise(F.lit("   "))
    total = F.col("o_totalprice").cast("bigint").cast("string")
    rows = F.array_compact(F.array(
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
        F.concat_ws("  ", F.lit("field"), F.lit("value"), F.lit("note")),
        F.concat_ws("  ", F.lit("customer"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("status"), line, F.col("o_orderstatus"), line, F.lit("now"))),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("")),
        F.concat(F.lit("total"), line, total, line, F.lit(""), line, F.lit("x")),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("  ", F.lit("a|b"), F.lit("c"), F.lit("d"), F.lit("e"))),
        F.concat_ws("  ", F.lit("last"), F.col("o_orderstatus"), F.lit("z")),
        F.lit("End of order"),
    ))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return spread(orders).select(
        F.col("o_orderkey").alias("document_id"), F.lit(1).cast("long").alias("page_number"),
        F.array_join(rows, "\n").alias("text"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("document_id"), F.lit(1).cast("long").alias("page_number"), "url", "html"
    )


def faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored questions and answers: each bookmark counts as one of the document of its session."""
    return bookmarks(spark, sf_dir).select(
        "id", F.col("session_id").alias("document_id"), F.col("query").alias("question"), "answer",
        F.lit(0.7).alias("confidence"), "created_at")


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user has stored preferences, some without a theme."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("user_id"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'dark' END").alias("theme"),
        F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' END").alias("language"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat('{\"segment\": \"', c_mktsegment, '\"}') END").alias("preferences_json"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cards of the deck of their order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("deck_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("card_id")).distinct()


def card_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("deck_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("card_id")).agg(
        F.expr("CASE max(l_returnflag) WHEN 'R' THEN 'known' WHEN 'A' THEN 'unknown' END").alias("mark"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions to store: every other one has no session yet."""
    return bookmarks(spark, sf_dir).select(
        F.col("id").alias("query_id"), "user_id",
        F.expr("CASE WHEN (id div 2) % 2 = 0 THEN session_id END").alias("session_id"), "query", "answer", "confidence")
