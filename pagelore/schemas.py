"""Fixed schemas of the thirteen relational tables and of the stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = "array<struct<file:string,page:bigint,score:double,source_type:string,content_preview:string>>"
COLUMNS = {
    "users": "id bigint, username string, email string, hashed_password string, role string, is_active boolean, created_at timestamp_ntz",
    "documents": "id bigint, filename string, original_name string, file_path string, file_size bigint, file_hash string, status string, "
                 "page_count bigint, version int, metadata_json map<string,string>, error_message string, owner_id bigint, "
                 "created_at timestamp_ntz, updated_at timestamp_ntz",
    "document_chunks": "id bigint, document_id bigint, chunk_index bigint, content string, page_number bigint, source_type string, "
                       "char_count bigint, embedding_id string, metadata_json map<string,string>, created_at timestamp_ntz",
    "chat_sessions": "id bigint, user_id bigint, title string, created_at timestamp_ntz",
    "chat_messages": f"id bigint, session_id bigint, role string, content string, sources {SOURCES}, confidence double, ai_summary string, "
                     "reasoning string, created_at timestamp_ntz",
    "feedbacks": "id bigint, user_id bigint, message_id bigint, rating int, comment string, query string, helpful boolean, created_at timestamp_ntz",
    "bookmarks": f"id bigint, user_id bigint, query string, answer string, confidence double, sources {SOURCES}, note string, created_at timestamp_ntz",
    "document_tags": "id bigint, document_id bigint, tag string, created_at timestamp_ntz",
    "faqs": "id bigint, document_id bigint, question string, answer string, page_numbers array<bigint>, confidence double, created_at timestamp_ntz",
    "reading_progress": "id bigint, user_id bigint, document_id bigint, last_page bigint, total_pages bigint, notes string, completed boolean, updated_at timestamp_ntz",
    "user_preferences": "id bigint, user_id bigint, theme string, language string, preferences_json map<string,string>, updated_at timestamp_ntz",
    "annotations": "id bigint, document_id bigint, user_id bigint, page_number bigint, content string, highlight_text string, color string, created_at timestamp_ntz",
    "study_tasks": "id bigint, user_id bigint, title string, description string, document_id bigint, due_date timestamp_ntz, priority string, "
                   "status string, created_at timestamp_ntz, updated_at timestamp_ntz",
}
CHUNK_VECTORS = ("chunk_id string, document_id bigint, page_number bigint, chunk_index bigint, source_type string, content string, "
                 "char_count bigint, embedding array<float>")
PROCESSED = ("document_id bigint, part bigint, filename string, page_count bigint, version int, metadata map<string,string>, "
             "pages array<struct<page_number:bigint,merged_text:string,source_types:array<string>>>, processed_at string")


def fields(name: str) -> list[tuple[str, str]]:
    """(column, type) of a table, without a session."""
    return [tuple(c.split(" ", 1)) for c in COLUMNS[name].split(", ")]


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(COLUMNS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in order and type; a column the frame lacks is null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])
