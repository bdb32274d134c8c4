"""Catalog: word statistics, relationships, overviews and activity queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import activity as ac
from pagelore.operators import analytics as al
from pagelore.operators import pages as pg
from pagelore.plans import fixtures as fx
from pagelore.plans import shared as sh

ADMIN_AS_OF = "TIMESTAMP_NTZ '2024-01-10 00:00:00'"


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.page_counts(spark, d)


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return al.doc_keywords(sh.chunks(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the next one."""
    return fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"))


def history_requests(spark: SparkSession, d: str) -> DataFrame:
    return fx.text_queries(spark, d).select(
        F.col("query_id").alias("request_id"), (F.col("query_id") % 20).alias("user_id"),
        F.upper(F.get(F.split("query", " "), F.lit(2))).alias("needle"))


def progress_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier account asks for three documents, read or not."""
    return fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.explode(F.array(F.col("s_suppkey") % 200, (F.col("s_suppkey") * 7) % 200, F.lit(1000000000).cast("long"))).alias("document_id")).distinct()


def q_append_turns(spark: SparkSession, d: str) -> DataFrame:
    _, messages = ac.append_turns(fx.answered(spark, d), fx.sessions(spark, d))
    return messages.withColumn("turn", F.col("turn").cast("long"))


def q_new_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ac.append_turns(fx.answered(spark, d), fx.sessions(spark, d))[0]


QUERIES = {
    "top_words": lambda s, d: al.top_words(sh.chunks(s, d)),
    "document_insights": lambda s, d: al.document_insights(fx.documents(s, d), sh.chunks(s, d)),
    "compare_word_counts": lambda s, d: al.compare_word_counts(pairs(s, d), sh.chunks(s, d)),
    "doc_keywords": lambda s, d: keywords(s, d).select("document_id", F.explode("keywords").alias("keyword")),
    "doc_relationships": lambda s, d: al.doc_relationships(fx.documents(s, d), keywords(s, d)),
    "relationship_nodes": lambda s, d: al.relationship_nodes(fx.documents(s, d), keywords(s, d)),
    "analytics_overview": lambda s, d: al.analytics_overview(
        fx.users(s, d), fx.documents(s, d), sh.chunks(s, d), page_counts(s, d), fx.sessions(s, d), fx.messages(s, d)),
    "stats_overview": lambda s, d: al.stats_overview(
        fx.users(s, d), fx.documents(s, d), sh.chunks(s, d), page_counts(s, d), fx.faqs(s, d)),
    "admin_stats": lambda s, d: al.admin_stats(
        fx.users(s, d), fx.documents(s, d), sh.chunks(s, d), fx.sessions(s, d), fx.messages(s, d), fx.faqs(s, d), fx.feedback(s, d), F.expr(ADMIN_AS_OF)),
    "dashboard_counts": lambda s, d: al.dashboard_counts(fx.documents(s, d)),
    "document_detail": lambda s, d: al.document_detail(fx.documents(s, d), sh.chunks(s, d), page_counts(s, d)).withColumn("created_at", stamp("created_at")),
    "list_documents": lambda s, d: al.owner_row_filter(fx.documents(s, d), fx.users(s, d)).select(
        "owner_id", "id", "original_name", "file_size", "status", stamp("created_at")),
    "owner_row_filter": lambda s, d: al.owner_row_filter(fx.feedback(s, d), fx.users(s, d), "user_id", ("admin", "teacher")).select("id", "user_id", "query"),
    "users_with_doc_count": lambda s, d: al.users_with_doc_count(fx.users(s, d), fx.documents(s, d)),
    "reading_text": lambda s, d: al.reading_text(fx.documents(s, d), sh.chunks(s, d)),
    "session_history": lambda s, d: ac.session_history(fx.messages(s, d)).select("session_id", "position", "id", "role", "content", "confidence", stamp("created_at")),
    "context_window": lambda s, d: ac.context_window(fx.messages(s, d)),
    "list_sessions": lambda s, d: ac.list_sessions(fx.sessions(s, d), fx.messages(s, d)),
    "session_title": lambda s, d: ac.session_title(fx.messages(s, d)),
    "append_turns": q_append_turns,
    "open_sessions": q_new_sessions,
    "search_history": lambda s, d: ac.search_history(history_requests(s, d), fx.sessions(s, d), fx.bookmarks(s, d)),
    "feedback_stats": lambda s, d: ac.feedback_stats(fx.feedback(s, d)),
    "low_rated_queries": lambda s, d: ac.low_rated_queries(fx.feedback(s, d)).withColumn("rating", F.col("rating").cast("long")).withColumn("created_at", stamp("created_at")),
    "list_bookmarks": lambda s, d: ac.list_bookmarks(fx.bookmarks(s, d)).withColumn("created_at", stamp("created_at")),
    "document_tags": lambda s, d: ac.document_tags(fx.tags(s, d), fx.documents(s, d)),
    "list_faqs": lambda s, d: ac.list_faqs(fx.faqs(s, d), fx.documents(s, d)).withColumn("created_at", stamp("created_at")),
    "list_annotations": lambda s, d: ac.list_annotations(fx.annotations(s, d)).withColumn("created_at", stamp("created_at")),
    "reading_progress": lambda s, d: ac.reading_progress(progress_requests(s, d), ac.latest_progress(fx.progress_updates(s, d)), fx.documents(s, d)),
    "preferences_with_defaults": lambda s, d: ac.preferences_with_defaults(fx.users(s, d), fx.preferences(s, d)),
    "list_tasks": lambda s, d: ac.list_tasks(fx.tasks(s, d), fx.documents(s, d)).withColumn(
        "due_date", stamp("due_date")).withColumn("created_at", stamp("created_at")),
    "task_board": lambda s, d: ac.task_board(fx.tasks(s, d)).withColumn("due_date", stamp("due_date")),
    "task_stats": lambda s, d: ac.task_stats(fx.tasks(s, d), fx.task_as_of(s, d)),
    "confidence_band": lambda s, d: ac.confidence_band(fx.messages(s, d)),
    "flashcard_progress": lambda s, d: ac.flashcard_progress(fx.cards(s, d), fx.card_marks(s, d)),
}
