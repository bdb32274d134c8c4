"""Check statements for the answering queries."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C
from pagelore.oracles.search_base import add_hybrid

NL = "chr(10)"


def shared(s: str) -> str:
    return dk.overlap_size(dk.word_set("query"), dk.word_set(s))


def add_answers(p: str, hits: str, queries: str) -> None:
    """<p>_answers: the full answer row of each query of ``queries`` from ``hits``."""
    sentences = dk.split_sentences(dk.clean_chunk_for_display("content"))
    C.add(f"{p}_sent", f"""
SELECT query_id, rank, query, pos, sentence, {shared('sentence')} AS overlap FROM (
  SELECT query_id, rank, query, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos
  FROM (SELECT *, {sentences} AS s FROM {hits}))""", hits)
    C.add(f"{p}_best", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, pos) AS n FROM {p}_sent WHERE rank = 1", f"{p}_sent")
    C.add(f"{p}_rel", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY pos) AS n FROM {p}_sent WHERE overlap > 0) WHERE n <= 2""", f"{p}_sent")
    C.add(f"{p}_student", f"""
SELECT h.query_id, coalesce(b.t, {dk.truncate_text('h.content', 300)}) AS answer FROM {hits} h LEFT JOIN (
  SELECT query_id, string_agg(sentence, ' ' ORDER BY n) AS t FROM {p}_best WHERE n <= 3 GROUP BY 1) b USING (query_id) WHERE h.rank = 1""",
          hits, f"{p}_best")
    C.add(f"{p}_teacher", f"""
SELECT h.query_id, CASE WHEN t.t IS NULL THEN {dk.truncate_text('h.content', 500)} ELSE {dk.q(fv.MSG_TEACHER_HEAD)} || {NL} || t.t END AS answer
FROM {hits} h LEFT JOIN (
  SELECT query_id, string_agg(rank || '. ' || r || ' (Page ' || page_number || ')', {NL} ORDER BY rank) AS t FROM (
    SELECT query_id, rank, string_agg(sentence, ' ' ORDER BY n) AS r FROM {p}_rel WHERE rank <= 3 GROUP BY 1, 2)
  JOIN {hits} USING (query_id, rank) GROUP BY 1) t USING (query_id) WHERE h.rank = 1""", hits, f"{p}_rel")
    C.add(f"{p}_researcher", f"""
SELECT h.query_id, coalesce(t.t, {dk.truncate_text('h.content', 600)}) || {NL} || {dk.q(fv.MSG_REFERENCES_HEAD)} || {NL} || r.refs AS answer
FROM {hits} h
LEFT JOIN (SELECT query_id, string_agg(sentence || ' [' || m || ']', {NL} ORDER BY m) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, n) AS m FROM {p}_rel WHERE rank <= 4) GROUP BY 1) t USING (query_id)
JOIN (SELECT query_id, string_agg('[' || rank || '] ' || filename || ', Page ' || page_number, {NL} ORDER BY rank) AS refs
      FROM {hits} WHERE rank <= 4 GROUP BY 1) r USING (query_id)
WHERE h.rank = 1""", hits, f"{p}_rel")
    C.add(f"{p}_by_role", f"""
SELECT q.query_id, q.query, q.role, coalesce(CASE q.role WHEN 'student' THEN s.answer WHEN 'teacher' THEN t.answer ELSE r.answer END,
       {dk.q(fv.MSG_NO_EXTRACT)}) AS answer
FROM {queries} q LEFT JOIN {p}_student s USING (query_id) LEFT JOIN {p}_teacher t USING (query_id) LEFT JOIN {p}_researcher r USING (query_id)""",
          f"{p}_student", f"{p}_teacher", f"{p}_researcher", queries)
    C.add(f"{p}_sum", f"""
SELECT query_id, count(*) AS n, count(DISTINCT document_id) AS docs, count(DISTINCT filename) AS files, max(final_score) AS top, floor(sum(round(final_score * 10000, 0)) / count(*) + 0.5) / 10000 AS mean,
       round(least(sum(final_score / rank) / (CASE WHEN max(final_score) > 0 THEN max(final_score) ELSE 1 END) / sum(1.0::DOUBLE / rank), 1.0), 4) AS confidence
FROM {hits} GROUP BY 1""", hits)
    C.add(f"{p}_texts", f"""
SELECT *, 'Answer derived from ' || n || ' document segments across ' || docs || ' document(s). Top score: ' || printf('%.4f', round(top, 4))
         || ', Average score: ' || printf('%.4f', round(mean, 4)) || '.' AS reasoning,
       'All ' || n || ' retrieved segments had very low relevance (max score: ' || printf('%.4f', round(top, 4)) || ', avg: '
         || printf('%.4f', round(mean, 4)) || '). The question likely falls outside the scope of uploaded documents.' AS weak_reason
FROM {p}_sum""", f"{p}_sum")
    C.add(f"{p}_src", f"""
SELECT query_id, rank, filename AS file, page_number AS page, final_score AS score, source_type, {dk.truncate_text('content', 150)} AS content_preview
FROM {hits}""", hits)
    C.add(f"{p}_lines", f"""
SELECT query_id, string_agg(file || ' | ' || page || ' | ' || printf('%.4f', score) || ' | ' || source_type || ' | ' || content_preview, {NL} ORDER BY rank) AS sources
FROM {p}_src GROUP BY 1""", f"{p}_src")
    C.add(f"{p}_sug", f"""
SELECT g.query_id, coalesce(t.t, '') AS suggested_questions FROM (SELECT DISTINCT query_id FROM {hits}) g LEFT JOIN (
  SELECT query_id, string_agg(question, {NL} ORDER BY pos) AS t FROM (
    SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n,
           CASE WHEN contains(lower(s), 'is') THEN 'What ' || lower({dk.strip("string_split(s, 'is')[1]")}) || '?'
                WHEN contains(lower(s), 'are') THEN 'What ' || lower({dk.strip("string_split(s, 'are')[1]")}) || '?'
                ELSE 'Can you explain: ' || {dk.truncate_text('s', 80)} || '?' END AS question
    FROM (SELECT query_id, unnest(ss[1:10]) AS s, generate_subscripts(ss[1:10], 1) AS pos FROM (
            SELECT query_id, {dk.split_sentences('t')} AS ss FROM (
              SELECT query_id, string_agg(content, ' ' ORDER BY rank) AS t FROM {hits} WHERE rank <= 3 GROUP BY 1)))
    WHERE regexp_matches(lower(s), {dk.q('|'.join(fv.QUESTION_MARKERS))}) AND length(s) > 20 AND length(s) < 200)
  WHERE n <= 5 GROUP BY 1) t USING (query_id)""", hits)
    C.add(f"{p}_answers", f"""
SELECT q.query_id, q.query, q.role,
       CASE WHEN x.n IS NULL THEN {dk.q(fv.MSG_NO_HITS)} WHEN x.top < {fv.LOW_RELEVANCE} THEN {dk.q(fv.MSG_LOW_RELEVANCE)} ELSE q.answer END AS answer,
       CASE WHEN x.n IS NULL THEN 0.0 WHEN x.top < {fv.LOW_RELEVANCE} THEN x.top ELSE x.confidence END AS confidence,
       CASE WHEN x.n IS NULL THEN {dk.q(fv.MSG_NO_HITS_REASON)} WHEN x.top < {fv.LOW_RELEVANCE} THEN x.weak_reason ELSE x.reasoning END AS reasoning,
       CASE WHEN x.n IS NULL OR x.top < {fv.LOW_RELEVANCE} THEN '' ELSE l.sources END AS sources,
       coalesce(g.suggested_questions, '') AS suggested_questions
FROM {p}_by_role q LEFT JOIN {p}_texts x USING (query_id) LEFT JOIN {p}_lines l USING (query_id) LEFT JOIN {p}_sug g USING (query_id)""",
          f"{p}_by_role", f"{p}_texts", f"{p}_lines", f"{p}_sug")


add_answers("ans", "hits_v", "questions_v")

C.add("cmp_q", """
SELECT query_id || ':' || did AS query_id, query_id AS qid, did, query, role, embedding, [did] AS document_ids
FROM (SELECT query_id, query, role, embedding, unnest(list_distinct([query_id, query_id + 40, query_id * 2 + 1])) AS did FROM questions_v)""", "questions_v")
add_hybrid("cmp", "cmp_q", "chunk_vectors_v", 5, ("cmp_q", "chunk_vectors_v"))
C.add("cmp_named", """
SELECT h.*, q.query, q.role, coalesce(d.original_name, 'Document ' || h.document_id) AS filename
FROM cmp_hits h JOIN cmp_q q USING (query_id) LEFT JOIN docs_v d ON d.id = h.document_id""", "cmp_hits", "cmp_q", "docs_v")
add_answers("cmp", "cmp_named", "cmp_q")

C.add("contexts_v", """
SELECT q.query_id, q.query, coalesce(t.t, '') AS context FROM questions_v q LEFT JOIN (
  SELECT query_id, string_agg(content_preview, ' ' ORDER BY rank) AS t FROM ans_src GROUP BY 1) t USING (query_id)""", "questions_v", "ans_src")


def runs(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), {dk.q(fv.W + '+')}))"


def focus(n: int) -> str:
    """Context reduced to its n best sentences, by exploding and ranking."""
    keys = dk.tfilter(runs("query"), lambda w: f"NOT list_contains({dk.strlist(fv.CONTEXT_STOP)}, {w}) AND length({w}) > 2")
    kept = dk.tfilter(dk.loose_sentences("context"), lambda s: f"length({s}) > 20")
    near = "len(list_filter(keys, lambda w: contains(lower(s), w))) > 0"
    return f"""
SELECT c.query_id, c.context AS raw, coalesce(t.t, substring(c.context, 1, 1024)) AS context FROM contexts_v c LEFT JOIN (
  SELECT query_id, string_agg(s, ' ' ORDER BY i) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS n FROM (
      SELECT query_id, s, i, {dk.overlap_size('keys', runs('s'))} + CASE WHEN {near} THEN 0.5 ELSE 0 END AS score FROM (
        SELECT query_id, {keys} AS keys, unnest({kept}) AS s, generate_subscripts({kept}, 1) AS i FROM contexts_v)))
  WHERE n <= {n} GROUP BY 1) t USING (query_id)"""


C.add("focus8", focus(8), "contexts_v")
C.add("focus4", focus(4), "contexts_v")
C.add("fallback_v", f"""
SELECT query_id, CASE WHEN length({dk.strip('raw')}) > 50 AND length({dk.strip('context')}) > 30
       THEN {dk.q(fv.MSG_FALLBACK_HEAD)} || {dk.strip('context')} || {dk.q(fv.MSG_FALLBACK_TAIL)} ELSE {dk.q(fv.MSG_FALLBACK_NONE)} END AS answer
FROM focus4""", "focus4")

_pct = "'Best match: ' || CAST(round(top * 100, 0) AS BIGINT) || '%'"
SQL = {
    "sentence_scores": C.sql("SELECT query_id, rank, pos, sentence, overlap FROM ans_sent", "ans_sent"),
    "answer_student": C.sql("SELECT * FROM ans_student", "ans_student"),
    "answer_teacher": C.sql("SELECT * FROM ans_teacher", "ans_teacher"),
    "answer_researcher": C.sql("SELECT * FROM ans_researcher", "ans_researcher"),
    "answer_by_role": C.sql("SELECT * FROM ans_by_role", "ans_by_role"),
    "confidence": C.sql("SELECT query_id, confidence FROM ans_sum", "ans_sum"),
    "out_of_scope": C.sql(f"SELECT query_id, top < {fv.LOW_RELEVANCE} AS out_of_scope, top AS confidence, "
                          f"CASE WHEN top < {fv.LOW_RELEVANCE} THEN {dk.q(fv.MSG_LOW_RELEVANCE)} END AS answer, "
                          f"CASE WHEN top < {fv.LOW_RELEVANCE} THEN weak_reason END AS reasoning FROM ans_texts", "ans_texts"),
    "sources": C.sql("SELECT * FROM ans_src", "ans_src"),
    "reasoning": C.sql("SELECT query_id, reasoning FROM ans_texts", "ans_texts"),
    "suggest_questions": C.sql("SELECT * FROM ans_sug", "ans_sug"),
    "rag_query": C.sql("SELECT * FROM ans_answers", "ans_answers"),
    "compare_documents_answers": C.sql("SELECT q.qid AS query_id, q.did AS document_id, a.query, a.answer, a.confidence, a.sources, "
                                       "coalesce(d.original_name, 'Document ' || q.did) AS filename FROM cmp_answers a "
                                       "JOIN cmp_q q USING (query_id) LEFT JOIN docs_v d ON d.id = q.did", "cmp_answers", "cmp_q", "docs_v"),
    "extractive_context": C.sql("SELECT query_id, context FROM focus8", "focus8"),
    "extractive_fallback_answer": C.sql("SELECT * FROM fallback_v", "fallback_v"),
    "answer_mode": C.sql(f"""
SELECT query_id, mode AS answer_mode, CASE WHEN mode = 'ai' THEN {dk.q(fv.MSG_FALLBACK_NONE)} ELSE a.answer END AS answer,
       CASE mode WHEN 'ai' THEN {dk.q(fv.MSG_FALLBACK_NONE)} WHEN 'both' THEN CASE WHEN a.sources = '' THEN {dk.q(fv.MSG_FALLBACK_NONE)} ELSE f.answer END END AS direct_ai_answer,
       CASE WHEN mode = 'ai' THEN 0.0 ELSE a.confidence END AS confidence, CASE WHEN mode = 'ai' THEN '' ELSE a.sources END AS sources,
       CASE WHEN mode = 'ai' THEN {dk.q(fv.MSG_AI_REASON)} ELSE a.reasoning END AS reasoning
FROM ans_answers a JOIN (SELECT query_id, ['pdf', 'ai', 'both'][query_id % 3 + 1] AS mode FROM questions_v) m USING (query_id)
JOIN fallback_v f USING (query_id)""", "ans_answers", "fallback_v", "questions_v"),
    "explain_confidence": C.sql(f"""
SELECT query_id, coalesce(confidence, 0.0) AS score, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS level,
       concat_ws({NL}, CASE WHEN n >= 3 THEN 'Multiple sources found / positive / ' || n || ' relevant sources identified'
                            WHEN n IS NULL THEN 'No sources found / negative / No matching content in documents'
                            ELSE 'Limited sources / neutral / Only ' || n || ' source(s) found' END,
                 CASE WHEN top > 0.8 THEN 'High relevance match / positive / ' || {_pct} WHEN top > 0.5 THEN 'Moderate relevance / neutral / ' || {_pct}
                      WHEN n > 0 THEN 'Low relevance scores / negative / ' || {_pct} END,
                 CASE WHEN files > 1 THEN 'Cross-document validation / positive / Found in ' || files || ' different documents' END) AS factors,
       CASE WHEN confidence > 0.7 THEN {dk.q(fv.MSG_HIGH)} WHEN confidence > 0.4 THEN {dk.q(fv.MSG_MEDIUM)} ELSE {dk.q(fv.MSG_LOW)} END AS recommendation
FROM (SELECT query_id FROM questions_v) LEFT JOIN ans_sum USING (query_id)""", "questions_v", "ans_sum"),
    "fact_check_heuristic": C.sql(f"SELECT answer_id, array_to_string({dk.tfilter(dk.split_sentences('answer'), lambda s: f'length({s}) > 20')}[1:5], {NL}) AS claims, "
                                  "'medium' AS confidence_rating, 'unknown' AS consistency FROM evals_v", "evals_v"),
}
