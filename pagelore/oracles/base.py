"""Shared relations of the check statements: the fixture views and the chunk table."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk

C = dk.Ctes()

C.add("users_v", """
SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@example.com' AS email,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'teacher' WHEN 'HOUSEHOLD' THEN 'researcher'
            WHEN 'FURNITURE' THEN 'admin' ELSE 'student' END AS role,
       c_acctbal >= 0 AS is_active,
       TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' HOUR AS created_at
FROM customer""")

C.add("docs_v", """
SELECT d.doc_id AS id, 'doc_' || d.doc_id || CASE WHEN d.doc_id % 50 = 7 THEN '.txt' ELSE '.pdf' END AS original_name,
       d.n_chars AS file_size, CAST(substr(d.source, 4) AS BIGINT) AS owner_id, d.lang,
       CASE WHEN l.quality IS NULL THEN 'uploaded' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'processed' ELSE 'processing' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' MINUTE AS created_at, d.text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

C.add("pages_v", """
SELECT doc_id AS document_id, CAST(floor(pos / 20) AS BIGINT) + 1 AS page_number, string_agg(line, chr(10) ORDER BY pos) AS raw_text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
GROUP BY 1, 2""")

C.add("vectors_v", "SELECT vec_id AS chunk_id, embedding, label::BIGINT AS document_id FROM embeddings")
C.add("queries_v", "SELECT item_id AS query_id, text AS query FROM benchmark")

C.add("messages_v", """
SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 20 AS user_id, turn, role, text AS content,
       CASE WHEN role = 'assistant' THEN CAST(length(text) % 100 AS DOUBLE) / 100 END AS confidence,
       TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE AS created_at
FROM conversations""")

C.add("sessions_v", """
SELECT session_id AS id, user_id, substring(arg_min(content, turn) FILTER (role = 'user'), 1, 100) AS title,
       min(created_at) AS created_at
FROM messages_v GROUP BY 1, 2""", "messages_v")

C.add("feedback_v", """
SELECT event_id AS id, user_id, CASE WHEN event_type <> 'signup' THEN CAST(1 + event_id % 5 AS INT) END AS rating,
       event_type IN ('view', 'purchase') AS helpful, event_type || ' ' || props AS query, props AS comment, ts AS created_at
FROM events""")

C.add("tasks_v", """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 200 AS document_id,
       CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS due_date,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
       CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status, o_orderdate AS created_at
FROM orders""")
C.add("task_now", "SELECT max(o_orderdate) - INTERVAL '90' DAY AS ts FROM orders")

C.add("progress_v", """
SELECT l_suppkey AS user_id, l_partkey % 200 AS document_id, l_linenumber::BIGINT AS last_page, CAST(l_quantity AS BIGINT) AS total_pages,
       l_returnflag = 'R' AS completed, l_orderkey * 10 + l_linenumber AS version_key, l_shipdate AS updated_at
FROM lineitem""")

C.add("tags_v", """
SELECT doc_id AS document_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents""")

C.add("bookmarks_v", """
SELECT id, user_id, session_id, query, content AS answer, confidence, created_at
FROM (SELECT id, user_id, session_id, role, content, confidence, created_at,
             lag(content) OVER (PARTITION BY session_id ORDER BY turn) AS query FROM messages_v) m
WHERE role = 'assistant' AND query IS NOT NULL""", "messages_v")

C.add("annotations_v", """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 200 AS document_id, l_suppkey AS user_id, l_linenumber::BIGINT AS page_number,
       l_returnflag || l_linestatus AS content, NULL::VARCHAR AS highlight_text,
       CASE WHEN l_linenumber % 2 = 0 THEN 'green' END AS color, l_shipdate AS created_at
FROM lineitem""")

C.add("requests_v", "SELECT event_id, event_type || '|' || props AS cache_key, ts FROM events")

C.add("detections_v", """
SELECT doc_id AS document_id, CAST(floor(pos / 20) AS BIGINT) + 1 AS page_number, pos, line AS text,
       CASE WHEN pos % 3 = 0 THEN 'fallback' ELSE 'primary' END AS engine,
       CAST((length(line) * 7 + pos * 13) % 100 AS DOUBLE) / 100 AS confidence
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)""")

C.add("evals_v", """
SELECT b.id AS answer_id, b.query, b.answer, coalesce(d.text, '') AS sources, b.query AS reference
FROM bookmarks_v b LEFT JOIN documents d ON d.doc_id = b.session_id""", "bookmarks_v")

C.add("faqs_v", """
SELECT id, session_id AS document_id, query AS question, answer, 0.7::DOUBLE AS confidence, created_at FROM bookmarks_v""", "bookmarks_v")
C.add("prefs_v", """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'dark' END AS theme,
       CASE c_nationkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' END AS language,
       CASE WHEN c_custkey % 4 = 0 THEN '{"segment": "' || c_mktsegment || '"}' END AS preferences_json
FROM customer WHERE c_custkey % 3 = 0""")
C.add("cards_v", """
SELECT l_suppkey AS deck_id, l_orderkey * 10 + l_linenumber AS card_id,
       CASE max(l_returnflag) WHEN 'R' THEN 'known' WHEN 'A' THEN 'unknown' END AS mark FROM lineitem GROUP BY 1, 2""")
C.add("answered_v", """
SELECT id AS query_id, user_id, CASE WHEN (id // 2) % 2 = 0 THEN session_id END AS session_id, query, answer, confidence
FROM bookmarks_v""", "bookmarks_v")

_line = "CASE WHEN o_orderkey % 5 = 0 THEN chr(9) ELSE '   ' END"
C.add("sheets_v", f"""
SELECT o_orderkey AS document_id, 1::BIGINT AS page_number, array_to_string(list_filter([
  'Order ' || o_orderkey, 'field  value  note', 'customer  ' || o_custkey || '  ' || o_orderpriority,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'status' || {_line} || o_orderstatus || {_line} || 'now' END,
  CASE WHEN o_orderkey % 4 = 0 THEN '' END,
  'total' || {_line} || CAST(trunc(o_totalprice) AS BIGINT) || {_line} || '' || {_line} || 'x',
  CASE WHEN o_orderkey % 2 = 0 THEN 'a|b  c  d  e' END,
  'last  ' || o_orderstatus || '  z', 'End of order'], lambda x: x IS NOT NULL), chr(10)) AS text
FROM orders""")

C.add("grids_v", f"""
SELECT document_id, document_id % 3 + 1 AS page_number, 0::BIGINT AS table_index, unnest(flavour) AS flavour, cells FROM (
  SELECT doc_id AS document_id,
         CASE WHEN doc_id % 4 = 0 THEN ['stream'] WHEN doc_id % 4 = 1 THEN ['lattice'] ELSE ['lattice', 'stream'] END AS flavour,
         {dk.tfilter(dk.tmap("string_split(text, chr(10))", dk.words), lambda w: f"len({w}) > 0")} AS cells
  FROM documents) WHERE len(cells) > 1""")


# --- chunking as a walk along the running sentence length ---------------------
def add_chunks(prefix: str, pages: str, text: str, needs: tuple[str, ...], size: int = fv.CHUNK_SIZE,
               overlap: int = fv.CHUNK_OVERLAP) -> None:
    """Relations <prefix>_walk (per page) for pages(document_id, page_number, text)."""
    C.add(f"{prefix}_sents", f"""
SELECT document_id, page_number, sents, list_transform(range(1, len(sents) + 1),
       lambda i: list_sum(list_transform(sents[1:i], lambda s: length(s)))) AS total
FROM (SELECT document_id, page_number, {dk.page_sentences(text)} AS sents FROM {pages}) WHERE len(sents) > 0""", *needs)
    nxt = (f"least(greatest(w.first, CASE WHEN p.total[w.last] <= {overlap} THEN 1 "
           f"ELSE len(list_filter(p.total, lambda x: x < p.total[w.last] - {overlap})) + 2 END), w.last + 1)")
    C.add(f"{prefix}_walk", f"""! AS (
SELECT document_id, page_number, 0 AS k, 1::BIGINT AS first,
       greatest(1, len(list_filter(total, lambda x: x <= {size})))::BIGINT AS last FROM {prefix}_sents
UNION ALL
SELECT document_id, page_number, k + 1, first,
       greatest(fresh, len(list_filter(total, lambda x: x <= {size} + coalesce(total[first - 1], 0))))::BIGINT
FROM (SELECT w.document_id, w.page_number, w.k, w.last + 1 AS fresh, ({nxt})::BIGINT AS first, p.total
      FROM {prefix}_walk w JOIN {prefix}_sents p USING (document_id, page_number) WHERE w.last < len(p.total)))""",
          f"{prefix}_sents")
    C.add(f"{prefix}_page_chunks", f"""
SELECT w.document_id, w.page_number, w.k::BIGINT AS chunk_index, array_to_string(s.sents[w.first:w.last], ' ') AS content
FROM {prefix}_walk w JOIN {prefix}_sents s USING (document_id, page_number)""", f"{prefix}_walk", f"{prefix}_sents")


add_chunks("raw", "pages_v", "raw_text", ("pages_v",))

page_text = dk.let(dk.clean_text("raw_text"), dk.remove_header_footer)
C.add("digital_v", f"""
SELECT *, length(text) AS char_count FROM (SELECT document_id, page_number, {page_text} AS text,
       (document_id + page_number) % 3 = 0 AS has_images FROM pages_v)""", "pages_v")
C.add("merged_v", f"""
SELECT document_id, page_number, text AS merged_text FROM digital_v WHERE {dk.strip('text')} <> ''""", "digital_v")
add_chunks("doc", "merged_v", "merged_text", ("merged_v",))
C.add("chunks_v", """
SELECT 'doc' || document_id || '_c' || chunk_index AS chunk_id, * FROM (
  SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index) - 1 AS chunk_index,
         'text' AS source_type, content, length(content) AS char_count FROM doc_page_chunks)""", "doc_page_chunks")
C.add("page_counts", "SELECT document_id, count(*) AS page_count FROM pages_v GROUP BY 1", "pages_v")
