"""Catalog wiring and a small sample of the DuckDB comparison (all keys: tests/oracle_check.py)."""

import pytest

from oracle_check import compare, duck
from pagelore.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["page_stats", "chunk_documents", "tables_from_text", "vector_topk", "hybrid_search", "top_words", "doc_relationships",
          "merge_progress", "patch_tasks", "task_stats", "bleu2", "faq_topics", "flashcards", "feedback_live", "stream_dedupe", "rag_query"]


def test_every_check_statement_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("key", SAMPLE)
def test_against_duckdb(spark, key):
    ok, note = compare(spark, duck(SF), SF, key, catalog.queries()[key], catalog.oracle_sql()[key])
    assert ok, note


def test_plans_have_no_cartesian_product(spark):
    for key in ("hybrid_search", "rag_query", "compare_word_counts", "analytics_overview", "search_content"):
        plan = catalog.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
