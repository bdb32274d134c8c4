"""Catalog: text functions over whole documents, and study material."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import text as tx

from pagelore.operators import quality as qu
from pagelore.operators import study as st
from pagelore.plans import fixtures as fx
from pagelore.plans import shared as sh





def _lazy(build, name: str):
    """Columns are built when the query runs: they need a session."""
    return lambda s, d: fx.texts(s, d).select("doc_id", build(F.col("text")).alias(name))


def q_simple_overlap(spark: SparkSession, d: str) -> DataFrame:
    return fx.bookmarks(spark, d).select("id", tx.simple_overlap(F.col("query"), F.col("answer")).alias("overlap"))


def q_cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked of three documents given in any order, or of all."""
    ids = F.when(F.col("query_id") % 4 != 0, F.array(F.col("query_id") * 3 % 10, F.col("query_id") % 10, F.col("query_id") * 7 % 10))
    return fx.text_queries(spark, d).select("query_id", tx.cache_key(F.col("query"), ids).alias("cache_key"))


def q_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Each document searched for its own third word, in small letters."""
    needle = F.lower(F.get(tx.words(F.col("text")), F.lit(2)))
    return fx.texts(spark, d).select("doc_id", tx.snippet(F.col("text"), F.coalesce(needle, F.lit("x"))).alias("snippet"))


def q_language_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Detected against labelled language, counted."""
    docs = fx.table(spark, d, "documents").select("lang", tx.detect_language(F.col("text")).alias("detected"))
    return docs.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


def faq_material(s: SparkSession, d: str) -> DataFrame:
    return sh.keep(s, d, "faq_material", lambda: st.faq_candidates(sh.chunks(s, d)))


def faq_topics(s: SparkSession, d: str) -> DataFrame:
    return st.faq_topics(faq_material(s, d))


def faq_answers(s: SparkSession, d: str) -> DataFrame:
    return st.faq_answers(st.faq_context(faq_topics(s, d)))


def q_faq_table(s: SparkSession, d: str) -> DataFrame:
    t = st.faq_table(faq_answers(s, d), sh.chunks(s, d), fx.documents(s, d))
    return t.withColumn("page_numbers", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",")).withColumn(
        "position", F.col("position").cast("long"))


def card_topics(s: SparkSession, d: str) -> DataFrame:
    return st.flashcard_topics(st.flashcard_material(sh.chunks(s, d)))


def longs(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


QUERIES = {
    "clean_text": _lazy(tx.clean_text, "cleaned"),
    "remove_header_footer": _lazy(tx.remove_header_footer, "body"),
    "clean_chunk_for_display": _lazy(tx.clean_chunk_for_display, "shown"),
    "split_sentences": lambda s, d: fx.texts(s, d).select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos").cast("long")),
    "truncate_text": _lazy(lambda c: tx.truncate_text(c, 500), "short"),
    "clean_ocr_text": _lazy(tx.clean_ocr_text, "repaired"),
    "is_quality_text": _lazy(tx.is_quality_text, "is_quality"),
    "clean_faq_text": lambda s, d: st.clean_faq_text(sh.chunks(s, d)),
    "faq_noise_clean": lambda s, d: st.faq_noise_clean(sh.chunks(s, d).select(F.col("chunk_id").alias("document_id"), F.col("content").alias("text"))).select(
        F.col("document_id").alias("chunk_id"), "cleaned"),
    "detect_language": _lazy(tx.detect_language, "language"),
    "language_agreement": q_language_agreement,
    "language_name": lambda s, d: fx.table(s, d, "documents").select("doc_id", tx.language_name(F.col("lang")).alias("language")),
    "key_terms": _lazy(lambda c: tx.key_terms(c, 4), "terms"),
    "card_terms": _lazy(lambda c: tx.key_terms(c, 4, skip_parentheses=True), "terms"),
    "clean_subject": _lazy(lambda c: F.array_join(F.transform(tx.loose_sentences(c), tx.clean_subject), " | "), "subjects"),
    "snippet": q_snippet,
    "simple_overlap": q_simple_overlap,
    "cache_key": q_cache_key,
    "source_overlap": lambda s, d: qu.overlap_measures(fx.evaluations(s, d)).select("answer_id", "source_overlap"),
    "query_relevance": lambda s, d: qu.overlap_measures(fx.evaluations(s, d)).select("answer_id", "query_relevance"),
    "length_ratio": lambda s, d: qu.overlap_measures(fx.evaluations(s, d)).select("answer_id", "length_ratio"),
    "groundedness": lambda s, d: qu.overlap_measures(fx.evaluations(s, d)).select("answer_id", "groundedness"),
    "bleu2": lambda s, d: qu.bleu2(fx.evaluations(s, d)),
    "rouge_n": lambda s, d: qu.rouge_n(fx.evaluations(s, d), 1).join(qu.rouge_n(fx.evaluations(s, d), 2), "answer_id"),
    "rouge_l": lambda s, d: qu.rouge_l(fx.evaluations(s, d)),
    "overlap_fallback": lambda s, d: qu.overlap_fallback(fx.evaluations(s, d)),
    "evaluate_answers": lambda s, d: qu.evaluate_answers(fx.evaluations(s, d)),
    "faq_candidates": lambda s, d: faq_material(s, d).select("document_id", F.array_join("sentences", "\n").alias("sentences"), "cleaned"),
    "faq_topics": lambda s, d: longs(faq_topics(s, d).select("document_id", "topic", "pass", "at", "question"), "topic", "pass", "at"),
    "faq_context": lambda s, d: longs(st.faq_context(faq_topics(s, d)).select("document_id", "topic", "question", "context"), "topic"),
    "faq_answers": lambda s, d: longs(faq_answers(s, d), "position"),
    "faq_table": q_faq_table,
    "flashcard_material": lambda s, d: st.flashcard_material(sh.chunks(s, d)),
    "flashcard_topics": lambda s, d: longs(card_topics(s, d), "topic", "pass", "at", "window"),
    "flashcards": lambda s, d: longs(st.flashcards(card_topics(s, d)), "position"),
}
