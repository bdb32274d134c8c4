"""Catalog: answering queries over the retrieved hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import answers as an
from pagelore.operators import retrieval as rt
from pagelore.plans import fixtures as fx
from pagelore.plans import shared as sh


def source_lines(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(
        " | ", x["file"], x["page"].cast("string"), F.format_string("%.4f", x["score"]), x["source_type"], x["content_preview"])), "\n")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Question with the joined previews of its sources, as the direct answer mode reads them."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content_preview"))), lambda x: x["content_preview"]), " ")
    joined = an.source_rows(sh.hits(spark, d)).groupBy("query_id").agg(text.alias("context"))
    return sh.questions(spark, d).select("query_id", "query").join(joined, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit("")))


def flat_answers(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", F.coalesce(source_lines("sources"), F.lit("")))


def q_rag(spark: SparkSession, d: str) -> DataFrame:
    answers = an.rag_query(sh.questions(spark, d), sh.chunk_vectors(spark, d), fx.documents(spark, d), blocks=sh.vector_blocks(spark, d))
    return flat_answers(answers).withColumn("suggested_questions", F.coalesce(F.array_join("suggested_questions", "\n"), F.lit("")))


def q_compare(spark: SparkSession, d: str) -> DataFrame:
    asked = sh.questions(spark, d).withColumn("document_ids", F.array("query_id", F.col("query_id") + 40, F.col("query_id") * 2 + 1))
    return flat_answers(an.compare_documents_answers(asked, sh.chunk_vectors(spark, d), fx.documents(spark, d)))


def q_answer_mode(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("pdf"), F.lit("ai"), F.lit("both")), (F.col("query_id") % 3 + 1).cast("int"))
    asked = sh.questions(spark, d)
    answers = an.compose_answers(asked, sh.hits(spark, d))
    return flat_answers(an.answer_mode(answers, asked.select("query_id", mode.alias("answer_mode"))))


def q_explain(spark: SparkSession, d: str) -> DataFrame:
    out = an.explain_confidence(sh.questions(spark, d), sh.hits(spark, d))
    lines = F.array_join(F.transform("factors", lambda x: F.concat_ws(" / ", x["factor"], x["impact"], x["detail"])), "\n")
    return out.withColumn("factors", lines)


QUERIES = {
    "sentence_scores": lambda s, d: an.sentence_scores(sh.hits(s, d)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("pos").cast("long").alias("pos"), "sentence",
        F.col("overlap").cast("long").alias("overlap")),
    "answer_student": lambda s, d: an.answer_student(sh.hits(s, d)),
    "answer_teacher": lambda s, d: an.answer_teacher(sh.hits(s, d)),
    "answer_researcher": lambda s, d: an.answer_researcher(sh.hits(s, d)),
    "answer_by_role": lambda s, d: an.answer_by_role(sh.questions(s, d), sh.hits(s, d)),
    "confidence": lambda s, d: an.confidence(sh.hits(s, d)),
    "out_of_scope": lambda s, d: an.out_of_scope(sh.hits(s, d)),
    "sources": lambda s, d: an.source_rows(sh.hits(s, d)),
    "reasoning": lambda s, d: an.reasoning(sh.hits(s, d)),
    "suggest_questions": lambda s, d: an.suggest_questions(sh.hits(s, d)).select(
        "query_id", F.array_join("suggested_questions", "\n").alias("suggested_questions")),
    "rag_query": q_rag,
    "compare_documents_answers": q_compare,
    "extractive_context": lambda s, d: an.extractive_context(contexts(s, d)),
    "extractive_fallback_answer": lambda s, d: an.extractive_fallback_answer(contexts(s, d)),
    "answer_mode": q_answer_mode,
    "explain_confidence": q_explain,
    "fact_check_heuristic": lambda s, d: an.fact_check_heuristic(fx.evaluations(s, d)).select(
        "answer_id", F.array_join("claims", "\n").alias("claims"), "confidence_rating", "consistency"),
}
