"""Shared relations of the retrieval checks: embeddings, BM25 and fused hits."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C

DIM = 256


def embedding(text: str) -> str:
    buckets = dk.tmap(dk.lower_words(text), lambda w: f"(('0x' || substring(md5({w}), 1, 8))::BIGINT % {DIM})")

    def dense(h: str) -> str:
        return dk.let(f"list_transform(range(0, {DIM}), lambda b: coalesce({h}[b], 0))", unit)

    def unit(c: str) -> str:
        norm = f"greatest(sqrt(list_sum(list_transform({c}, lambda x: x * x))::DOUBLE), 1e-12)"
        return f"list_transform({c}, lambda x: CAST(x / {norm} AS FLOAT))"

    return dk.let(f"list_histogram({buckets})", dense)


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def add_bm25(prefix: str, queries: str, docs: str, needs: tuple[str, ...]) -> None:
    """<prefix>_bm25(query_id, chunk_id, bm25_score) from queries(query_id, corpus_id, query)
    and docs(corpus_id, chunk_id, content)."""
    C.add(f"{prefix}_tok", f"SELECT corpus_id, chunk_id, {dk.lower_words('content')} AS toks FROM {docs}", *needs)
    C.add(f"{prefix}_tf", f"""
SELECT corpus_id, chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
  SELECT corpus_id, chunk_id, len(toks) AS dl, unnest(toks) AS term FROM {prefix}_tok) GROUP BY 1, 2, 3""", f"{prefix}_tok")
    C.add(f"{prefix}_size", f"SELECT corpus_id, count(*) AS n, avg(len(toks)) AS avgdl FROM {prefix}_tok GROUP BY 1", f"{prefix}_tok")
    C.add(f"{prefix}_idf", f"""
SELECT *, avg(idf) OVER (PARTITION BY corpus_id) AS avg_idf FROM (
  SELECT t.corpus_id, term, any_value(avgdl) AS avgdl, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
  FROM {prefix}_tf t JOIN {prefix}_size s USING (corpus_id) GROUP BY 1, 2)""", f"{prefix}_tf", f"{prefix}_size")
    k1, b = fv.BM25_K1, fv.BM25_B
    C.add(f"{prefix}_bm25", f"""
SELECT query_id, chunk_id, round(sum(CASE WHEN idf < 0 THEN {fv.BM25_EPSILON} * avg_idf ELSE idf END
         * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / avgdl))), 6) AS bm25_score
FROM (SELECT query_id, corpus_id, unnest({dk.lower_words('query')}) AS term FROM {queries}) q
JOIN {prefix}_idf i USING (corpus_id, term) JOIN {prefix}_tf t USING (corpus_id, term) GROUP BY 1, 2""",
          f"{prefix}_idf", f"{prefix}_tf", *needs)


def add_hybrid(prefix: str, queries: str, vectors: str, k: int, needs: tuple[str, ...], owners: bool = False) -> None:
    """<prefix>_hits: fused ranking of queries(query_id, query, embedding, document_ids) over vectors.

    ``owners``: a question without documents is asked of the processed documents of its owner_id.
    """
    owned = "EXISTS (FROM docs_v d WHERE d.id = document_id AND d.owner_id = asker AND d.status = 'processed')" if owners else "true"
    asker = "q.owner_id AS asker, " if owners else ""
    if owners:
        needs = (*needs, "docs_v")
    C.add(f"{prefix}_cand", f"""
SELECT * FROM (
  SELECT q.query_id, q.document_ids, {asker}v.* EXCLUDE (embedding), {cosine('q.embedding', 'v.embedding')} AS vscore,
         row_number() OVER (PARTITION BY query_id ORDER BY {cosine('q.embedding', 'v.embedding')} DESC, chunk_id) AS vrank
  FROM {queries} q JOIN {vectors} v ON q.document_ids IS NULL OR len(q.document_ids) <> 1 OR v.document_id = q.document_ids[1])
WHERE vrank <= {3 * k} AND CASE WHEN document_ids IS NULL OR len(document_ids) = 0 THEN {owned} ELSE len(document_ids) = 1 OR list_contains(document_ids, document_id) END""", *needs)
    C.add(f"{prefix}_cd", f"SELECT query_id AS corpus_id, chunk_id, content FROM {prefix}_cand", f"{prefix}_cand")
    C.add(f"{prefix}_cq", f"SELECT query_id, query_id AS corpus_id, query FROM {queries}", *needs)
    add_bm25(prefix, f"{prefix}_cq", f"{prefix}_cd", (f"{prefix}_cq", f"{prefix}_cd"))
    C.add(f"{prefix}_hits", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vrank) AS rank FROM (
  SELECT * EXCLUDE (nv, nb), round(nv, 6) AS vector_score, round(nb, 6) AS bm25_score,
         round({fv.VECTOR_WEIGHT} * nv + {fv.BM25_WEIGHT} * nb, 4) AS final_score FROM (
    SELECT *, coalesce((vscore - min(vscore) OVER g) / nullif(max(vscore) OVER g - min(vscore) OVER g, 0), 1.0) AS nv,
           coalesce((bscore - min(bscore) OVER g) / nullif(max(bscore) OVER g - min(bscore) OVER g, 0), 1.0) AS nb
    FROM (SELECT c.*, coalesce(b.bm25_score, 0.0) AS bscore FROM {prefix}_cand c LEFT JOIN {prefix}_bm25 b USING (query_id, chunk_id))
    WINDOW g AS (PARTITION BY query_id)))) WHERE rank <= {k}""", f"{prefix}_cand", f"{prefix}_bm25")


C.add("chunk_vectors_v", f"SELECT *, {embedding('content')} AS embedding FROM chunks_v", "chunks_v")
C.add("questions_v", f"""
SELECT query_id, query, ['student', 'teacher', 'researcher', 'admin'][query_id % 4 + 1] AS role,
       CASE query_id % 3 WHEN 1 THEN [query_id] WHEN 2 THEN list_transform(range(0, 50), lambda i: i * 2 + query_id % 2) END AS document_ids,
       query_id % 20 AS owner_id, {embedding('query')} AS embedding FROM queries_v""", "queries_v")
add_hybrid("rag", "questions_v", "chunk_vectors_v", 5, ("questions_v", "chunk_vectors_v"), True)
C.add("hits_v", """
SELECT h.*, q.query, q.role, coalesce(d.original_name, 'Document ' || h.document_id) AS filename
FROM rag_hits h JOIN questions_v q USING (query_id) LEFT JOIN docs_v d ON d.id = h.document_id""",
      "rag_hits", "questions_v", "docs_v")
