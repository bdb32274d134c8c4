"""Check statements for word statistics, overviews and activity."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C

NL = "chr(10)"


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.split('.')[-1]}"


def listing(words) -> str:
    return "(" + ", ".join(dk.q(w) for w in words) + ")"


C.add("needles_v", "SELECT query_id AS request_id, query_id % 20 AS user_id, lower(string_split(query, ' ')[3]) AS needle FROM queries_v", "queries_v")
C.add("runs_v", f"""
SELECT document_id, chunk_index, pos, w FROM (
  SELECT document_id, chunk_index, unnest(r) AS w, generate_subscripts(r, 1) AS pos FROM (
    SELECT document_id, chunk_index, regexp_extract_all(lower(content), {dk.q(fv.W + '+')}) AS r FROM chunks_v))
WHERE regexp_full_match(w, '[a-z]{{4,}}')""", "chunks_v")
C.add("top_words_v", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first_at) AS rank FROM (
  SELECT document_id, w AS word, count(*) AS n, min(chunk_index * 1000000 + pos) AS first_at FROM runs_v
  WHERE w NOT IN {listing(fv.INSIGHT_STOP)} GROUP BY 1, 2)) WHERE rank <= 10""", "runs_v")
C.add("texts_v", """
SELECT document_id, string_agg(content, ' ' ORDER BY chunk_index) AS t,
       string_agg(content, ' ' ORDER BY chunk_index) FILTER (chunk_index < 30) AS t30,
       count(*) AS n, sum(char_count)::BIGINT AS chars, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS kinds
FROM chunks_v GROUP BY 1""", "chunks_v")
C.add("lang_v", f"SELECT document_id, {dk.detect_language('substring(t, 1, 500)')} AS language FROM texts_v", "texts_v")

C.add("cmp_words", f"""
SELECT document_id, w, count(*) AS n FROM runs_v WHERE w NOT IN {listing(fv.COMPARE_STOP)} GROUP BY 1, 2""", "runs_v")
C.add("pair_words", """
SELECT pair_id, w, sum(na)::BIGINT AS na, sum(nb)::BIGINT AS nb,
       CASE WHEN sum(na) > 0 AND sum(nb) > 0 THEN 's' WHEN sum(na) > 0 THEN 'a' ELSE 'b' END AS kind FROM (
  SELECT document_id AS pair_id, w, n AS na, 0 AS nb FROM cmp_words
  UNION ALL SELECT document_id - 1, w, 0, n FROM cmp_words WHERE document_id > 0) GROUP BY 1, 2""", "cmp_words")
C.add("pair_top", """
SELECT *, row_number() OVER (PARTITION BY pair_id, kind ORDER BY na + nb DESC, w) AS r FROM pair_words""", "pair_words")
C.add("word_totals", f"""
SELECT c.document_id, l.language, count(*) AS chunks, coalesce(any_value(r.n), 0) AS words
FROM chunks_v c JOIN lang_v l USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n FROM runs_v GROUP BY 1) r USING (document_id) GROUP BY 1, 2""", "chunks_v", "lang_v", "runs_v")

_letters = dk.sub("lower(substring(t30, 1, 3000))", f"[^a-zA-Z{fv.WS_CLASS}]", " ")
C.add("keywords_v", f"""
SELECT document_id, list_sort({dk.tfilter(f"list_distinct({dk.words(_letters)})", lambda w: f"length({w}) > 3 AND NOT list_contains({dk.strlist(fv.RELATIONSHIP_STOP)}, {w}) AND replace({w}, {w}[1], '') <> ''")}) AS keywords
FROM texts_v WHERE length({dk.strip('substring(t30, 1, 3000)')}) >= 20""", "texts_v")
C.add("owned_kw", """
SELECT * FROM (SELECT k.*, d.owner_id, d.original_name, count(*) OVER (PARTITION BY owner_id) AS n
               FROM keywords_v k JOIN docs_v d ON d.id = k.document_id WHERE d.status = 'processed') WHERE n >= 2""", "keywords_v", "docs_v")
C.add("edges_v", """
SELECT a.owner_id, a.document_id AS source, b.document_id AS target, len(a.keywords) AS na, len(b.keywords) AS nb,
       list_intersect(a.keywords, b.keywords) AS common
FROM owned_kw a JOIN owned_kw b ON a.owner_id = b.owner_id AND a.document_id < b.document_id
WHERE len(a.keywords) >= 3 AND len(b.keywords) >= 3""", "owned_kw")
_topics = "array_to_string(list_transform(list_sort(list_transform(common, lambda w: {'l': -length(w), 'w': w})), lambda x: x.w)[1:8], ',')"

C.add("per_doc", """
SELECT d.id AS document_id, d.owner_id, d.status, p.page_count, t.n AS chunks, t.chars,
       (SELECT count(*) FROM faqs_v f WHERE f.document_id = d.id) AS faqs
FROM docs_v d LEFT JOIN page_counts p ON p.document_id = d.id LEFT JOIN texts_v t ON t.document_id = d.id""",
      "docs_v", "page_counts", "texts_v", "faqs_v")

SQL = {
    "top_words": C.sql("SELECT document_id, rank, word, n FROM top_words_v", "top_words_v"),
    "document_insights": C.sql("""
SELECT d.id AS document_id, d.original_name AS filename, coalesce(k.topics, '') AS key_topics, l.language AS detected_language,
       coalesce(t.n, 0) AS total_chunks, coalesce(t.chars, 0) AS total_characters, coalesce(t.chars, 0) // 5 AS estimated_words, coalesce(t.kinds, '') AS source_types
FROM docs_v d LEFT JOIN texts_v t ON t.document_id = d.id LEFT JOIN lang_v l ON l.document_id = d.id
LEFT JOIN (SELECT document_id, string_agg(word || ':' || n, ',' ORDER BY rank) AS topics FROM top_words_v GROUP BY 1) k ON k.document_id = d.id""",
                               "docs_v", "texts_v", "lang_v", "top_words_v"),
    "compare_word_counts": C.sql("""
SELECT p.doc_id AS pair_id, p.doc_id AS doc_a, p.doc_id + 1 AS doc_b, coalesce(a.words, 0) AS word_count_a, coalesce(b.words, 0) AS word_count_b,
       coalesce(a.chunks, 0) AS chunk_count_a, coalesce(b.chunks, 0) AS chunk_count_b, coalesce(a.language, 'en') AS language_a, coalesce(b.language, 'en') AS language_b,
       greatest(1, round_even(coalesce(a.words, 0) / 200, 0))::BIGINT AS reading_time_a, greatest(1, round_even(coalesce(b.words, 0) / 200, 0))::BIGINT AS reading_time_b,
       coalesce(s.shared, '') AS shared_topics, coalesce(s.ua, '') AS top_unique_a, coalesce(s.ub, '') AS top_unique_b,
       coalesce(round(s.ns / nullif(s.nall, 0)::DOUBLE, 3), 0.0) AS similarity, coalesce(s.ns, 0) AS total_shared_words
FROM documents p LEFT JOIN word_totals a ON a.document_id = p.doc_id LEFT JOIN word_totals b ON b.document_id = p.doc_id + 1
LEFT JOIN (SELECT pair_id, count(*) FILTER (kind = 's') AS ns, count(*) AS nall,
                  string_agg(w || ':' || na || '/' || nb, ',' ORDER BY r) FILTER (kind = 's' AND r <= 15) AS shared,
                  string_agg(w || ':' || (na + nb), ',' ORDER BY r) FILTER (kind = 'a' AND r <= 10) AS ua,
                  string_agg(w || ':' || (na + nb), ',' ORDER BY r) FILTER (kind = 'b' AND r <= 10) AS ub FROM pair_top GROUP BY 1) s ON s.pair_id = p.doc_id""",
                                 "word_totals", "pair_top"),
    "doc_keywords": C.sql("SELECT document_id, unnest(keywords) AS keyword FROM keywords_v", "keywords_v"),
    "doc_relationships": C.sql(f"""
SELECT owner_id, source, target, round(sim, 3) AS similarity, len(common) AS shared_count,
       CASE WHEN sim > 0.15 THEN 'strong' WHEN sim > 0.07 THEN 'moderate' ELSE 'weak' END AS relationship, {_topics} AS shared_topics
FROM (SELECT *, greatest(len(common) / (na + nb - len(common)), len(common) / least(na, nb) * 0.7) AS sim FROM edges_v)
WHERE sim > 0.03 AND len(common) >= 2""", "edges_v"),
    "relationship_nodes": C.sql("SELECT owner_id, document_id, original_name AS label, len(keywords) AS keyword_count FROM owned_kw", "owned_kw"),
    "analytics_overview": C.sql("""
SELECT u.id AS owner_id, coalesce(t.docs, 0) AS total_documents, coalesce(t.pages, 0) AS total_pages, coalesce(t.chunks, 0) AS total_chunks,
       coalesce(t.chars, 0) AS total_characters, coalesce(s.n, 0) AS total_sessions, coalesce(m.n, 0) AS total_queries,
       coalesce(t.chars, 0) // 5 AS estimated_words, coalesce(k.l, '') AS source_breakdown, coalesce(st.l, '') AS status_counts
FROM users_v u
LEFT JOIN (SELECT owner_id, count(*) AS docs, sum(page_count)::BIGINT AS pages, sum(chunks)::BIGINT AS chunks, sum(chars)::BIGINT AS chars FROM per_doc GROUP BY 1) t ON t.owner_id = u.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM sessions_v GROUP BY 1) s ON s.user_id = u.id
LEFT JOIN (SELECT s.user_id, count(*) AS n FROM messages_v m JOIN sessions_v s ON s.id = m.session_id WHERE m.role = 'user' GROUP BY 1) m ON m.user_id = u.id
LEFT JOIN (SELECT owner_id, string_agg(source_type || '=' || n, ',' ORDER BY source_type) AS l FROM (
             SELECT owner_id, source_type, count(*) AS n FROM chunks_v c JOIN docs_v d ON d.id = c.document_id GROUP BY 1, 2) GROUP BY 1) k ON k.owner_id = u.id
LEFT JOIN (SELECT owner_id, string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) AS l FROM (
             SELECT owner_id, status, count(*) AS n FROM docs_v GROUP BY 1, 2) GROUP BY 1) st ON st.owner_id = u.id""",
                                "users_v", "per_doc", "sessions_v", "messages_v", "chunks_v", "docs_v"),
    "stats_overview": C.sql("""
SELECT u.id AS owner_id, coalesce(docs, 0) AS total_documents, coalesce(done, 0) AS processed_documents, coalesce(pages, 0) AS total_pages,
       coalesce(t.chunks, 0) AS total_chunks, coalesce(t.faqs, 0) AS total_faqs, coalesce(chars, 0) // 5 AS total_words,
       greatest(1, round_even((coalesce(chars, 0) // 5) / 200, 0))::BIGINT AS estimated_reading_time_min
FROM users_v u LEFT JOIN (SELECT owner_id, count(*) AS docs, count(*) FILTER (status = 'processed') AS done, sum(page_count)::BIGINT AS pages,
  sum(chunks)::BIGINT AS chunks, sum(chars)::BIGINT AS chars, sum(faqs)::BIGINT AS faqs FROM per_doc GROUP BY 1) t ON t.owner_id = u.id""", "users_v", "per_doc"),
    "admin_stats": C.sql("""
SELECT u.*, d.*, c.*, s.*, m.*, f.*, b.* FROM
 (SELECT count(*) AS total_users, count(*) FILTER (is_active) AS active_users, count(*) FILTER (role = 'student') AS role_student,
         count(*) FILTER (role = 'teacher') AS role_teacher, count(*) FILTER (role = 'researcher') AS role_researcher,
         count(*) FILTER (role = 'admin') AS role_admin, count(*) FILTER (created_at >= TIMESTAMP '2024-01-03 00:00:00') AS new_users FROM users_v) u,
 (SELECT count(*) AS total_documents, count(*) FILTER (status = 'processed') AS processed_documents, count(*) FILTER (status = 'failed') AS failed_documents,
         count(*) FILTER (created_at >= TIMESTAMP '2024-01-03 00:00:00') AS new_documents FROM docs_v) d,
 (SELECT count(*) AS total_chunks FROM chunks_v) c, (SELECT count(*) AS total_sessions FROM sessions_v) s,
 (SELECT count(*) AS total_messages, count(*) FILTER (created_at >= TIMESTAMP '2024-01-03 00:00:00') AS new_messages FROM messages_v) m,
 (SELECT count(*) AS total_faqs FROM faqs_v) f, (SELECT count(*) AS total_feedback FROM feedback_v) b""",
                         "users_v", "docs_v", "chunks_v", "sessions_v", "messages_v", "faqs_v", "feedback_v"),
    "dashboard_counts": C.sql("SELECT owner_id, count(*) AS total, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'processing') AS processing, "
                              "count(*) FILTER (status = 'failed') AS failed FROM docs_v GROUP BY 1", "docs_v"),
    "document_detail": C.sql(f"""
SELECT d.id AS document_id, d.original_name AS filename, d.status, coalesce(p.page_count, 0) AS page_count, d.file_size, sha256(d.text) AS file_hash,
       coalesce(t.n, 0) AS chunk_count, {ts('d.created_at')}
FROM docs_v d LEFT JOIN page_counts p ON p.document_id = d.id LEFT JOIN texts_v t ON t.document_id = d.id""", "docs_v", "page_counts", "texts_v"),
    "list_documents": C.sql(f"SELECT owner_id, id, original_name, file_size, status, {ts('created_at')} FROM docs_v "
                            "WHERE owner_id IN (SELECT id FROM users_v WHERE is_active)", "docs_v", "users_v"),
    "owner_row_filter": C.sql("SELECT id, user_id, query FROM feedback_v WHERE user_id IN "
                              "(SELECT id FROM users_v WHERE is_active AND role IN ('admin', 'teacher'))", "feedback_v", "users_v"),
    "users_with_doc_count": C.sql("SELECT u.id, username, email, role, is_active, coalesce(n, 0) AS document_count FROM users_v u "
                                  "LEFT JOIN (SELECT owner_id, count(*) AS n FROM docs_v GROUP BY 1) d ON d.owner_id = u.id", "users_v", "docs_v"),
    "reading_text": C.sql("""
SELECT d.id AS document_id, d.original_name AS filename, coalesce(r.t, '') AS text, length(coalesce(r.t, '')) AS total_chars, coalesce(r.p, '') AS pages
FROM docs_v d LEFT JOIN (
  SELECT document_id, substring(string_agg(content, ' ' ORDER BY chunk_index), 1, 5000) AS t, string_agg(DISTINCT page_number::VARCHAR, ',' ORDER BY page_number::VARCHAR) AS p0,
         array_to_string(list_sort(list_distinct(list(page_number))), ',') AS p
  FROM (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM chunks_v)
  WHERE spent < 5000 GROUP BY 1) r ON r.document_id = d.id""", "docs_v", "chunks_v"),
    "session_history": C.sql(f"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS position, id, role, content, confidence, {ts('created_at')} FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM messages_v) WHERE n <= 10""", "messages_v"),
    "context_window": C.sql(f"""
SELECT session_id, coalesce(string_agg(line, {NL} ORDER BY id) FILTER (total <= 2000), '') AS context FROM (
  SELECT *, sum(length(line)) OVER (PARTITION BY session_id ORDER BY id) AS total FROM (
    SELECT session_id, id, upper(role[1]) || lower(role[2:]) || ': ' || content AS line,
           row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM messages_v) WHERE n <= 6) GROUP BY 1""", "messages_v"),
    "list_sessions": C.sql("""
SELECT user_id, id, title, position, message_count FROM (
  SELECT s.*, coalesce(n, 0) AS message_count, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position
  FROM sessions_v s LEFT JOIN (SELECT session_id, count(*) AS n FROM messages_v GROUP BY 1) m ON m.session_id = s.id) WHERE position <= 20""", "sessions_v", "messages_v"),
    "session_title": C.sql("SELECT session_id, substring(arg_min(content, turn), 1, 100) AS title FROM messages_v WHERE role = 'user' GROUP BY 1", "messages_v"),
    "append_turns": C.sql("""
SELECT session_id, query_id, t.turn::BIGINT AS turn, t.role, t.content, t.confidence FROM (
  SELECT session_id, query_id, unnest([{'turn': 0, 'role': 'user', 'content': query, 'confidence': NULL::DOUBLE},
                                       {'turn': 1, 'role': 'assistant', 'content': answer, 'confidence': confidence}]) AS t FROM (
    SELECT query_id, query, answer, confidence, coalesce(session_id, (SELECT max(id) FROM sessions_v)
             + row_number() OVER (PARTITION BY session_id IS NULL ORDER BY query_id)) AS session_id FROM answered_v))""", "answered_v", "sessions_v"),
    "open_sessions": C.sql("SELECT (SELECT max(id) FROM sessions_v) + row_number() OVER (ORDER BY query_id) AS id, user_id, substring(query, 1, 100) AS title "
                           "FROM answered_v WHERE session_id IS NULL", "answered_v", "sessions_v"),
    "search_history": C.sql("""
SELECT request_id, 'session' AS kind, id FROM needles_v JOIN sessions_v USING (user_id)
WHERE contains(lower(CASE WHEN coalesce(title, '') <> '' THEN title ELSE 'Session ' || id END), needle)
UNION ALL
SELECT request_id, 'bookmark', id FROM needles_v JOIN bookmarks_v b USING (user_id) WHERE contains(lower(b.query), needle) OR contains(lower(b.answer), needle)""",
                            "needles_v", "sessions_v", "bookmarks_v"),
    "feedback_stats": C.sql("SELECT count(*) AS total, coalesce(round(coalesce(sum(rating), 0)::DOUBLE / count(*), 2), 0.0) AS average_rating, "
                            "coalesce(round((count(*) FILTER (helpful))::DOUBLE / count(*) * 100, 1), 0.0) AS helpful_pct, "
                            + ", ".join(f"count(*) FILTER (rating = {i}) AS rating_{i}" for i in range(1, 6)) + " FROM feedback_v", "feedback_v"),
    "low_rated_queries": C.sql(f"SELECT id, query, rating::BIGINT AS rating, comment, {ts('created_at')} FROM (SELECT * FROM feedback_v WHERE rating <= 2 "
                               "ORDER BY created_at DESC, id DESC LIMIT 50)", "feedback_v"),
    "list_bookmarks": C.sql(f"SELECT user_id, id, query, answer, confidence, {ts('created_at')} FROM bookmarks_v", "bookmarks_v"),
    "document_tags": C.sql("SELECT DISTINCT owner_id, document_id, tag FROM tags_v t JOIN docs_v d ON d.id = t.document_id", "tags_v", "docs_v"),
    "list_faqs": C.sql(f"SELECT owner_id, f.id, document_id, coalesce(original_name, 'Unknown') AS filename, question, answer, confidence, "
                       f"count(*) OVER (PARTITION BY document_id) AS faq_count, {ts('f.created_at')} FROM faqs_v f LEFT JOIN docs_v d ON d.id = f.document_id",
                       "faqs_v", "docs_v"),
    "list_annotations": C.sql(f"SELECT document_id, user_id, id, page_number, content, coalesce(highlight_text, '') AS highlight_text, "
                              f"coalesce(color, 'yellow') AS color, {ts('created_at')} FROM annotations_v", "annotations_v"),
    "reading_progress": C.sql("""
SELECT r.user_id, r.document_id, coalesce(d.original_name, 'Unknown') AS filename, coalesce(last_page, 0) AS last_page, coalesce(total_pages, 0) AS total_pages,
       coalesce(completed, false) AS completed,
       CASE WHEN coalesce(total_pages, 0) = 0 THEN 0 ELSE round_even(last_page / total_pages * 100, 0) END::BIGINT AS percentage
FROM (SELECT DISTINCT s_suppkey AS user_id, unnest([s_suppkey % 200, s_suppkey * 7 % 200, 1000000000]) AS document_id FROM supplier) r
LEFT JOIN (SELECT * FROM progress_v QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY version_key DESC, last_page DESC, total_pages DESC, completed DESC, updated_at DESC) = 1) p USING (user_id, document_id)
LEFT JOIN docs_v d ON d.id = r.document_id""", "progress_v", "docs_v"),
    "preferences_with_defaults": C.sql("SELECT u.id AS user_id, coalesce(theme, 'light') AS theme, coalesce(language, 'en') AS language, "
                                       "coalesce(preferences_json, '{}') AS preferences_json FROM users_v u LEFT JOIN prefs_v p ON p.user_id = u.id", "users_v", "prefs_v"),
    "list_tasks": C.sql(f"SELECT user_id, t.id, document_id, original_name AS document_name, {ts('due_date')}, priority, t.status, {ts('t.created_at')} "
                        "FROM tasks_v t LEFT JOIN docs_v d ON d.id = t.document_id", "tasks_v", "docs_v"),
    "task_board": C.sql(f"SELECT user_id, status AS lane, id, priority, {ts('due_date')} FROM tasks_v", "tasks_v"),
    "task_stats": C.sql("""
SELECT user_id, count(*) AS total, count(*) FILTER (status = 'todo') AS todo, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'done') AS done,
       count(*) FILTER (due_date < ts AND status <> 'done') AS overdue, round((count(*) FILTER (status = 'done'))::DOUBLE / count(*) * 100, 1) AS completion_rate
FROM tasks_v, task_now GROUP BY 1""", "tasks_v", "task_now"),
    "confidence_band": C.sql("SELECT id, confidence, CASE WHEN confidence > 0.7 THEN 'green' WHEN confidence > 0.4 THEN 'yellow' ELSE 'red' END AS band, "
                             "CAST(round(confidence * 100, 0) AS BIGINT) || '%' AS percent FROM messages_v WHERE confidence > 0", "messages_v"),
    "flashcard_progress": C.sql("SELECT deck_id, count(*) AS total, count(*) FILTER (mark = 'known') AS known, "
                                "CAST(floor((count(*) FILTER (mark = 'known'))::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS progress, "
                                "count(*) FILTER (mark IS DISTINCT FROM 'known') AS unknown_deck FROM cards_v GROUP BY 1", "cards_v"),
}
