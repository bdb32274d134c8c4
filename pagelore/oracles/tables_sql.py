"""Check statements for sources, sinks and table maintenance."""

from __future__ import annotations

from pagelore import schemas
from pagelore.functions import fixed_values as fv
from pagelore.operators.maintenance import HTML_STYLE, ISO_SHAPE
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C
from pagelore.plans.tables_plan import EXPORTED_AT

NL = "chr(10)"
DUE = "strftime(due_date, '%Y-%m-%d %H:%M:%S') AS due_date"

C.add("uploads_v", """
SELECT id AS upload_id, CASE WHEN id % 60 = 3 THEN '' WHEN id % 70 = 4 THEN 'dir.v2/scan_' || id WHEN id % 40 = 9 THEN 'Report ' || id || '.PDF' ELSE original_name END AS original_name,
       CASE WHEN id % 45 = 2 THEN 'text/plain' WHEN id % 30 = 8 THEN '' ELSE 'application/pdf' END AS content_type,
       file_size * CASE WHEN id % 80 = 6 THEN 100000 ELSE 1 END AS file_size, owner_id, text FROM docs_v""", "docs_v")
_suffix = "lower(regexp_extract(regexp_extract(original_name, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1))"
C.add("checked_v", f"""
SELECT *, CASE WHEN original_name <> '' AND {_suffix} <> '.pdf' THEN 'Invalid file type ''' || {_suffix} || '''. Only PDF files are allowed.'
     WHEN content_type <> '' AND NOT contains(lower(content_type), 'pdf') THEN 'File content type must be application/pdf'
     WHEN file_size > {fv.MAX_FILE_MB * 1024 * 1024} THEN 'File size ' || printf('%.1f', round(file_size / {1024 * 1024}, 1)) || 'MB exceeds limit of {fv.MAX_FILE_MB}MB' END AS reject_reason
FROM uploads_v""", "uploads_v")


def safe(c: str) -> str:
    return f"trim({dk.sub(dk.sub(c, '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_.' + chr(92) + '-]', '_'), '_+', '_')}, '_')"


_name = "CASE WHEN original_name = '' THEN 'document.pdf' ELSE original_name END"

C.add("progress_latest", "SELECT * FROM progress_v QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY version_key DESC, last_page DESC, total_pages DESC, completed DESC, updated_at DESC) = 1", "progress_v")
_TABLES = {
    "document_chunks": "chunks_v", "document_tags": "tags_v", "faqs": "faqs_v", "reading_progress": "progress_latest", "annotations": "annotations_v",
}
_NEEDS = ("docs_v", "users_v", "tasks_v", "chunk_vectors_v", *_TABLES.values())


def checksum(text: str) -> str:
    return f"coalesce(sum(('0x' || substring(md5({text}), 1, 8))::BIGINT), 0)::BIGINT"


def row_sum(*columns: str) -> str:
    return checksum(f"concat_ws('|', {', '.join(columns)})")


_VALUES = {
    "document_chunks": ("chunk_id", "document_id", "content"), "document_tags": ("document_id", "tag"), "faqs": ("document_id", "question", "answer"),
    "reading_progress": ("user_id", "document_id", "last_page"), "annotations": ("id", "document_id", "content"),
    "stored_chunks": ("chunk_id", "document_id", "content"), "stored_vectors": ("chunk_id", "document_id", "content", "embedding"),
}


def after_delete(doomed: str) -> str:
    parts = [f"SELECT 'documents' AS table_name, count(*) AS n_rows, count(*) AS n_linked, {row_sum('id', 'owner_id', 'status')} AS checksum FROM docs_v WHERE id NOT IN ({doomed})"]
    views = _TABLES | {"stored_chunks": "chunks_v", "stored_vectors": f"(SELECT {_VEC_COLUMNS} FROM chunk_vectors_v)"}
    parts += [f"SELECT '{n}', count(*), count(*), {row_sum(*_VALUES[n])} FROM {v} WHERE document_id NOT IN ({doomed})" for n, v in views.items()]
    kept = f"CASE WHEN document_id NOT IN ({doomed}) THEN document_id END"
    parts.append(f"SELECT 'study_tasks', count(*), count(kept), {row_sum('id', 'kept', 'priority')} FROM (SELECT *, {kept} AS kept FROM tasks_v)")
    return " UNION ALL ".join(parts)


def column_sums(name: str, view: str, lacking: tuple[str, ...]) -> str:
    """Values and checksum of every column of a table; those that the test data lack are empty."""
    parts = []
    for c, kind in schemas.fields(name):
        text = {"double": f"round({c} * 1000000)::BIGINT::VARCHAR", "timestamp_ntz": f"strftime({c}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"{c}::VARCHAR")
        sums = "0, 0" if c in lacking or "<" in kind else f"count({c}), {checksum(text)}"
        parts.append(f"SELECT '{name}' AS table_name, count(*) AS n_rows, '{c}' AS column_name, {sums.replace(', ', ' AS n_values, ', 1)} AS checksum FROM {view}")
    return " UNION ALL ".join(parts)


C.add("registrations_v", """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 11 = 0 AND is_active THEN 'New' || o_orderkey ELSE username END AS username,
       CASE WHEN (o_orderkey % 11 = 0 AND is_active) OR o_orderkey % 3 = 0 THEN email ELSE 'alt' || o_orderkey || '@example.com' END AS email, role
FROM orders JOIN users_v u ON u.id = o_custkey""", "users_v")


def iso(c: str) -> str:
    plain = dk.sub(c, r"(?:Z|[+-]\d{2}:\d{2})$", "")
    return f"CASE WHEN regexp_matches({c}, {dk.q(ISO_SHAPE)}) THEN TRY_CAST(CASE WHEN contains({c}, ':') THEN {plain} ELSE {c} END AS TIMESTAMP) END"


_patches = """
SELECT id, user_id, CASE id % 6 WHEN 0 THEN 0 WHEN 2 THEN id % 97 END AS p_doc, CASE id % 8 WHEN 0 THEN 'high' WHEN 2 THEN 'urgent' END AS p_priority,
       CASE id % 10 WHEN 0 THEN 'done' WHEN 4 THEN 'paused' END AS p_status,
       CASE id % 14 WHEN 0 THEN '' WHEN 2 THEN '2024-03-05T10:30:00Z' WHEN 4 THEN '2024-04-01' WHEN 6 THEN 'next week' WHEN 8 THEN '2024-05-06T07:08:09+02:00' END AS p_due
FROM tasks_v WHERE id % 2 = 0"""
C.add("patches_v", f"""
SELECT *, CASE WHEN p_priority NOT IN ('low', 'medium', 'high') THEN 'Priority must be low, medium, or high'
     WHEN p_status NOT IN ('todo', 'in_progress', 'done') THEN 'Status must be todo, in_progress, or done'
     WHEN p_due <> '' AND due IS NULL THEN 'Invalid date format' END AS reason FROM (SELECT *, {iso('p_due')} AS due FROM ({_patches}))""", "tasks_v")

C.add("new_tasks_v", """
SELECT o_orderkey AS id, o_custkey % 20 AS user_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 300 END AS document_id,
       CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '2024-13-01' WHEN 2 THEN '2024-02-03T04:05:06Z' WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_text,
       CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN '' END AS priority FROM orders""")

C.add("upd_v", "SELECT *, CASE WHEN version_key % 3 = 0 THEN 'note ' || version_key END AS notes FROM progress_v", "progress_v")
C.add("upd_stored", """
SELECT user_id, document_id, last_page, total_pages, coalesce(notes, '') AS notes, completed FROM upd_v WHERE version_key % 2 = 0
QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY version_key DESC, last_page DESC, total_pages DESC, completed DESC, updated_at DESC) = 1""", "upd_v")
C.add("upd_batch", """
SELECT user_id, document_id, arg_max(last_page, [version_key, last_page]) AS last_page, arg_max(total_pages, [version_key, total_pages]) FILTER (total_pages IS NOT NULL) AS total_pages,
       arg_max(notes, version_key) FILTER (notes IS NOT NULL) AS notes, arg_max(completed, [version_key, completed::BIGINT]) FILTER (completed IS NOT NULL) AS completed FROM (
  SELECT CASE WHEN version_key % 5 = 0 THEN document_id % 20 ELSE user_id END AS user_id, document_id, last_page, notes, version_key,
         CASE WHEN version_key % 4 = 1 THEN total_pages END AS total_pages, CASE WHEN version_key % 7 = 0 THEN completed END AS completed
  FROM upd_v WHERE version_key % 2 = 1) GROUP BY 1, 2""", "upd_v")

C.add("recent_v", "SELECT * FROM messages_v QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) <= 100", "messages_v")
_pct = "CAST(round(confidence * 100, 0) AS BIGINT) || '%'"
_sure = "coalesce(confidence, 0.0) <> 0"


def export(head: str, part: str, tail: str = "") -> str:
    return (f"SELECT session_id, {dk.q(head)} || string_agg({part}, '' ORDER BY created_at, id) || {dk.q(tail)} AS content FROM recent_v GROUP BY 1")


_VEC_COLUMNS = "chunk_id, document_id, page_number, chunk_index, source_type, content, char_count, " + (
    "array_to_string(" + dk.tmap("embedding", lambda x: f"CAST(round({x}::DOUBLE, 4) AS VARCHAR)") + ", ',') AS embedding")
C.add("docs_hashed", "SELECT v.* EXCLUDE (text), sha256(d.text) AS file_hash FROM docs_v v JOIN documents d ON d.doc_id = v.id", "docs_v")
#: View of each table, and the columns that no test table gives.
_SCANNED = {
    "users": ("users_v", ("hashed_password",)),
    "documents": ("docs_hashed", ("filename", "file_path", "page_count", "version", "error_message", "updated_at")),
    "document_chunks": ("chunks_v", ("id", "embedding_id", "created_at")), "chat_sessions": ("sessions_v", ()),
    "chat_messages": ("messages_v", ("ai_summary", "reasoning")), "feedbacks": ("feedback_v", ("message_id",)), "bookmarks": ("bookmarks_v", ("note",)),
    "document_tags": ("tags_v", ("id", "created_at")), "faqs": ("faqs_v", ()), "reading_progress": ("progress_latest", ("id", "notes")),
    "user_preferences": ("prefs_v", ("id", "updated_at")), "annotations": ("annotations_v", ()),
    "study_tasks": ("tasks_v", ("title", "description", "updated_at")),
}

SQL = {
    "validate_uploads": C.sql("SELECT upload_id, original_name, reject_reason FROM checked_v", "checked_v"),
    "safe_filename": f"SELECT page_id AS document_id, {safe('url')} AS name FROM pages",
    "file_hash": "SELECT doc_id AS id, sha256(text) AS file_hash FROM documents",
    "find_duplicates": "SELECT * FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, sha256(text) AS file_hash FROM documents) WHERE id <> first_id",
    "register_documents": C.sql(f"""
SELECT (SELECT max(id) FROM docs_v) + row_number() OVER (ORDER BY upload_id) AS id, 'u_' || upload_id || '_' || {safe(_name)} AS filename, {_name} AS original_name,
       file_size, sha256(text) AS file_hash, 'uploaded' AS status, owner_id FROM checked_v WHERE reject_reason IS NULL""", "checked_v", "docs_v"),
    "write_processed": C.sql(f"""
SELECT document_id, original_name AS filename, 1::BIGINT AS version, page_number, CASE WHEN {dk.strip('d.text')} <> '' THEN d.text ELSE '' END AS merged_text,
       CASE WHEN {dk.strip('d.text')} <> '' THEN 'text' ELSE '' END AS source_types FROM digital_v d JOIN docs_v ON id = document_id""", "digital_v", "docs_v"),
    "read_processed": C.sql(f"SELECT document_id, count(*) AS n_pages, sum(CASE WHEN {dk.strip('text')} <> '' THEN length(text) ELSE 0 END)::BIGINT AS n_chars FROM digital_v GROUP BY 1", "digital_v"),
    "read_tables": C.sql(" UNION ALL ".join(column_sums(n, *t) for n, t in _SCANNED.items()), "docs_hashed", *[v for v, _ in _SCANNED.values() if v != "docs_hashed"]),
    "read_vectors": """
SELECT vec_id AS chunk_id, label::BIGINT AS document_id,
  array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS millionths FROM embeddings""",
    "write_chunks": C.sql("SELECT * FROM chunks_v", "chunks_v"),
    "write_vectors": C.sql(f"SELECT {_VEC_COLUMNS} FROM chunk_vectors_v", "chunk_vectors_v"),
    "delete_document_cascade": C.sql(after_delete("SELECT id FROM docs_v WHERE status = 'failed'"), *_NEEDS),
    "delete_user_cascade": C.sql(after_delete("SELECT d.id FROM docs_v d JOIN users_v u ON u.id = d.owner_id WHERE NOT u.is_active")
                                 + " UNION ALL SELECT 'users', count(*), count(*), " + row_sum("id", "username") + " FROM users_v WHERE is_active", *_NEEDS),
    "delete_session_cascade": C.sql("""
SELECT s.id, s.user_id, count(*) AS n_messages FROM sessions_v s JOIN messages_v m ON m.session_id = s.id WHERE NOT (s.id % 2 = 0 AND s.id % 3 <> 0) GROUP BY 1, 2""", "sessions_v", "messages_v"),
    "upsert_tags": C.sql("""
SELECT document_id, tag FROM tags_v UNION ALL
(SELECT DISTINCT id, lower(trim(t)) FROM (SELECT id, unnest(['  ' || upper(lang) || ' ', 'Status:' || status, ' status:' || status]) AS t FROM docs_v WHERE id % 10 <> 1)
 EXCEPT SELECT document_id, tag FROM tags_v)""", "tags_v", "docs_v"),
    "merge_progress": C.sql("""
SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.document_id, b.document_id) AS document_id, coalesce(b.last_page, s.last_page) AS last_page,
       coalesce(b.total_pages, s.total_pages, p.page_count, 0) AS total_pages, coalesce(b.notes, s.notes, '') AS notes, coalesce(b.completed, s.completed, false) AS completed
FROM upd_stored s FULL JOIN upd_batch b ON s.user_id = b.user_id AND s.document_id = b.document_id
LEFT JOIN docs_v d ON d.id = coalesce(s.document_id, b.document_id) AND d.owner_id = coalesce(s.user_id, b.user_id)
LEFT JOIN page_counts p ON p.document_id = coalesce(s.document_id, b.document_id)
WHERE s.user_id IS NOT NULL OR d.id IS NOT NULL""", "upd_stored", "upd_batch", "docs_v", "page_counts"),
    "patch_tasks": C.sql(f"""
SELECT id, user_id, document_id, {DUE}, priority, status, patched, reason FROM (
  SELECT t.id, t.user_id, CASE WHEN g.p_doc IS NULL THEN t.document_id ELSE nullif(g.p_doc, 0) END AS document_id,
         CASE WHEN g.p_due IS NULL THEN t.due_date WHEN g.p_due <> '' THEN g.due END AS due_date, coalesce(g.p_priority, t.priority) AS priority,
         coalesce(g.p_status, t.status) AS status, g.id IS NOT NULL AS patched, r.reason
  FROM tasks_v t LEFT JOIN (SELECT * FROM patches_v WHERE reason IS NULL) g USING (id) LEFT JOIN (SELECT * FROM patches_v WHERE reason IS NOT NULL) r USING (id))""", "tasks_v", "patches_v"),
    "validate_feedback": C.sql("SELECT id, rating::BIGINT AS rating, CASE WHEN rating BETWEEN 1 AND 5 THEN NULL ELSE 'Rating must be between 1 and 5' END AS reason FROM ("
                               "SELECT id, rating - CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 9 = 0 THEN 2 ELSE 0 END AS rating FROM feedback_v)", "feedback_v"),
    "validate_tasks": C.sql(f"""
SELECT id, user_id, document_id, {DUE}, coalesce(nullif(priority, ''), 'medium') AS priority,
       CASE WHEN due_text <> '' AND due_date IS NULL THEN 'Invalid date format. Use ISO format.' WHEN coalesce(document_id, 0) <> 0 AND owner_id IS NULL THEN 'Document not found' END AS reject_reason
FROM (SELECT t.*, {iso('due_text')} AS due_date, d.owner_id FROM new_tasks_v t LEFT JOIN docs_v d ON d.id = t.document_id AND d.owner_id = t.user_id)""", "new_tasks_v", "docs_v"),
    "register_users": C.sql("""
SELECT request_id, username, email, role FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY request_id) AS n FROM registrations_v r
  WHERE username NOT IN (SELECT username FROM users_v WHERE is_active) AND email NOT IN (SELECT email FROM users_v WHERE is_active)) WHERE n = 1""", "registrations_v", "users_v"),
    "export_md": C.sql(export(f"# Assistant Chat Export\n_Exported: {EXPORTED_AT}_\n\n---\n\n",
                              f"CASE WHEN role = 'user' THEN '**You:** ' || content || {NL} || {NL} ELSE '**Assistant:** ' || content || {NL} || {NL} || "
                              f"CASE WHEN {_sure} THEN '> Confidence: ' || {_pct} || {NL} || {NL} ELSE '' END || '---' || {NL} || {NL} END"), "recent_v"),
    "export_txt": C.sql(export(f"Assistant Chat Export - {EXPORTED_AT}\n{'=' * 50}\n\n",
                               f"CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || ': ' || content || {NL} || {NL}"), "recent_v"),
    "export_json": C.sql(f"""
SELECT session_id, '{EXPORTED_AT}' AS exported_at, 'Assistant' AS service, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS position,
       id, role, content, confidence FROM recent_v""", "recent_v"),
    "export_html": C.sql(export(
        f'<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>Assistant Chat Export</title>\n<style>\n{HTML_STYLE}</style></head><body>\n'
        f'<h1>Assistant Chat Export</h1><p style="color:#6b7280">Exported: {EXPORTED_AT}</p><hr>\n',
        f"'<div class=\"msg ' || CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || '\">' || content || "
        f"CASE WHEN {_sure} THEN '<div class=\"meta\">Confidence: ' || {_pct} || '</div>' ELSE '' END || '</div>' || {NL}", "</body></html>"), "recent_v"),
}
