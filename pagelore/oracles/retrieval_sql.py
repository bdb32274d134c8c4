"""Check statements for the retrieval queries."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C
from pagelore.oracles.search_base import add_bm25, add_hybrid, cosine, embedding

_all = f"""
SELECT q.chunk_id AS query_id, v.chunk_id, q.document_id AS q_doc, v.document_id AS v_doc,
       {cosine('q.embedding', 'v.embedding')} AS vector_score
FROM vectors_v q JOIN vectors_v v ON q.chunk_id <> v.chunk_id"""
C.add("pairs_v", _all, "vectors_v")
_rank = "row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS vector_rank"


def ranked(where: str, after: str = "true") -> str:
    return (f"SELECT query_id, chunk_id, vector_score, vector_rank FROM (SELECT *, {_rank} FROM pairs_v WHERE {where}) "
            f"WHERE vector_rank <= 10 AND {after}")


C.add("corpus_d", "SELECT 0 AS corpus_id, chunk_id, content FROM chunks_v", "chunks_v")
C.add("corpus_q", "SELECT query_id, 0 AS corpus_id, query FROM queries_v", "queries_v")
add_bm25("all", "corpus_q", "corpus_d", ("corpus_q", "corpus_d"))

C.add("high_q", """
SELECT query_id, query, embedding, [query_id * 3] AS document_ids, query_id * 3 AS wanted, CASE WHEN query_id % 2 = 0 THEN 1 END AS only_page
FROM questions_v q JOIN docs_v d ON d.id = q.query_id * 3 WHERE query_id % 4 <> 3 OR 19 - d.owner_id = d.owner_id""", "questions_v", "docs_v")
add_hybrid("high", "high_q", "chunk_vectors_v", 10, ("high_q", "chunk_vectors_v"))
_ov = dk.overlap_size(dk.word_set("query"), dk.word_set("s"))

C.add("rel_base", """
SELECT q.query_id, q.query, q.document_ids, q.owner_id, h.content AS answer_text
FROM questions_v q LEFT JOIN hits_v h ON h.query_id = q.query_id AND h.rank = 1""", "questions_v", "hits_v")
_extra = ("list_sort(" + dk.tfilter(dk.word_set("coalesce(answer_text, '')"),
          lambda w: f"NOT list_contains({dk.strlist(fv.RELATED_STOP)}, {w}) AND length({w}) > 3") + ")[1:8]")
C.add("rel_wide", f"""
SELECT query_id, document_ids, owner_id, answer_text, CASE WHEN len(extra) > 0 THEN query || ' ' || array_to_string(extra, ' ') ELSE query END AS query
FROM (SELECT *, {_extra} AS extra FROM rel_base)""", "rel_base")
C.add("rel_q", f"SELECT query_id, query, document_ids, owner_id, {embedding('query')} AS embedding FROM rel_wide", "rel_wide")
add_hybrid("rel", "rel_q", "chunk_vectors_v", 10, ("rel_q", "chunk_vectors_v"), True)
_preview = dk.let(dk.split_sentences("content"), lambda s: f"CASE WHEN len({s}) > 0 THEN array_to_string({s}[1:3], ' ') ELSE substring(content, 1, 300) END")

_emb = dk.tmap("embedding", lambda x: f"CAST(round({x}::DOUBLE, 4) AS VARCHAR)")

SQL = {
    "embed_texts": C.sql(f"SELECT query_id, array_to_string({_emb}, ',') AS embedding FROM (SELECT query_id, {embedding('query')} AS embedding FROM queries_v)",
                         "queries_v"),
    "vector_topk": C.sql(ranked("true"), "pairs_v"),
    "vector_topk_prefilter": C.sql(ranked("q_doc = v_doc"), "pairs_v"),
    "vector_topk_postfilter": C.sql(ranked("true", "v_doc IN (q_doc, (q_doc + 1) % 10)"), "pairs_v"),
    "vector_count": "SELECT count(*) AS n_vectors FROM embeddings",
    "bm25_scores": C.sql("SELECT * FROM all_bm25", "all_bm25"),
    "bm25_topk": C.sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank "
                       "FROM all_bm25) WHERE bm25_rank <= 5", "all_bm25"),
    "normalize_scores": C.sql("SELECT query_id, chunk_id, round(coalesce((bm25_score - min(bm25_score) OVER g) / "
                              "nullif(max(bm25_score) OVER g - min(bm25_score) OVER g, 0), 1.0), 6) AS norm_score FROM all_bm25 "
                              "WINDOW g AS (PARTITION BY query_id)", "all_bm25"),
    "hybrid_search": C.sql("SELECT query_id, rank, chunk_id, document_id, bm25_score, vector_score, final_score FROM rag_hits", "rag_hits"),
    "rerank": C.sql(f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, chunk_id, score AS final_score
FROM (SELECT *, {dk.simple_overlap('query', 'content')} AS score FROM hits_v)""", "hits_v"),
    "search_content": C.sql(f"""
SELECT request_id, position, document_id, original_name AS filename, page_number, chunk_id, {dk.snippet('content', 'needle')} AS snippet FROM (
  SELECT r.request_id, r.needle, c.*, d.original_name,
         row_number() OVER (PARTITION BY request_id ORDER BY c.document_id, c.chunk_index) AS position
  FROM (SELECT query_id AS request_id, query_id % 20 AS owner_id, string_split(query, ' ')[2] AS needle FROM queries_v) r
  JOIN docs_v d USING (owner_id) JOIN chunks_v c ON c.document_id = d.id
  WHERE c.content ILIKE '%' || r.needle || '%') WHERE position <= 20""", "queries_v", "docs_v", "chunks_v"),
    "highlight": C.sql(f"""
SELECT h.query_id, h.document_id, d.original_name AS file, h.page_number AS page, h.chunk_index, substring(h.content, 1, 500) AS content,
       CASE WHEN b.o > 0 AND b.s <> '' THEN b.s ELSE substring(h.content, 1, 200) END AS highlight_text, h.final_score AS score, h.source_type
FROM high_hits h JOIN high_q q USING (query_id) JOIN docs_v d ON d.id = h.document_id
JOIN (SELECT query_id, chunk_id, arg_min({dk.strip('s')}, [-o, i]) AS s, max(o) AS o FROM (
        SELECT query_id, chunk_id, s, i, {_ov} AS o FROM (
          SELECT h.query_id, h.chunk_id, q.query, unnest(string_split(h.content, '.')) AS s,
                 generate_subscripts(string_split(h.content, '.'), 1) AS i FROM high_hits h JOIN high_q q USING (query_id)))
      GROUP BY 1, 2) b USING (query_id, chunk_id)
WHERE q.only_page IS NULL OR q.only_page = h.page_number""", "high_hits", "high_q", "docs_v"),
    "related_content": C.sql(f"""
SELECT query_id, rank, {_preview} AS content, page_number AS page, coalesce(original_name, 'Document ' || document_id) AS file,
       final_score AS score, source_type FROM (
  SELECT h.* EXCLUDE (rank), d.original_name, row_number() OVER (PARTITION BY h.query_id ORDER BY final_score DESC, h.rank) AS rank
  FROM rel_hits h JOIN rel_wide w USING (query_id) LEFT JOIN docs_v d ON d.id = h.document_id
  WHERE coalesce(answer_text, '') = '' OR NOT (contains(lower(answer_text), lower(content)) OR contains(lower(content), lower(answer_text))))
WHERE rank <= 5""", "rel_hits", "rel_wide", "docs_v"),
}
