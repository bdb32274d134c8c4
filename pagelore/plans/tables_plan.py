"""Catalog: sources, sinks and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore import schemas
from pagelore.operators import activity as ac
from pagelore.operators import maintenance as mt
from pagelore.operators import pages as pg
from pagelore.operators import retrieval as rt
from pagelore.plans import fixtures as fx
from pagelore.plans import pages_plan
from pagelore.plans import shared as sh
from pagelore.session import ensure_checkpoint_dir
from pagelore.sources import files

EXPORTED_AT = "2024-02-01 12:00"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder for one run."""
    return f"{ensure_checkpoint_dir(spark)}/pagelore-{name}-{uuid.uuid4().hex}"


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploads: odd names, foreign content types and oversized files among them."""
    docs = fx.document_rows(spark, d)
    return docs.select(
        F.col("id").alias("upload_id"),
        F.expr("CASE WHEN id % 60 = 3 THEN '' WHEN id % 70 = 4 THEN concat('dir.v2/scan_', id) "
               "WHEN id % 40 = 9 THEN concat('Report ', id, '.PDF') ELSE original_name END").alias("original_name"),
        F.expr("CASE WHEN id % 45 = 2 THEN 'text/plain' WHEN id % 30 = 8 THEN '' ELSE 'application/pdf' END").alias("content_type"),
        F.expr("file_size * CASE WHEN id % 80 = 6 THEN 100000 ELSE 1 END").alias("file_size"), "owner_id", "file_hash")


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return fx.document_rows(spark, d).select("id", "file_hash")


def q_register(spark: SparkSession, d: str) -> DataFrame:
    good = mt.validate_uploads(uploads(spark, d)).filter("reject_reason IS NULL").select(
        "upload_id", F.concat(F.lit("u_"), F.col("upload_id").cast("string"), F.lit("_"), files.safe_filename(F.coalesce(F.nullif("original_name", F.lit("")), F.lit("document.pdf")))).alias("filename"),
        F.coalesce(F.nullif("original_name", F.lit("")), F.lit("document.pdf")).alias("original_name"), "file_size",
        "file_hash", "owner_id")
    return mt.register_documents(good, fx.table(spark, d, "documents").select(F.col("doc_id").alias("id")).agg(F.max("id").alias("max_id")))


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "documents": fx.documents(spark, d).drop("text", "lang"), "document_chunks": sh.chunks(spark, d), "document_tags": fx.tags(spark, d),
        "faqs": fx.faqs(spark, d), "reading_progress": ac.latest_progress(fx.progress_updates(spark, d)),
        "annotations": fx.annotations(spark, d), "study_tasks": fx.tasks(spark, d),
    }


#: What tells the rows of a table apart after a delete.
VALUES = {
    "documents": ["id", "owner_id", "status"], "document_chunks": ["chunk_id", "document_id", "content"], "document_tags": ["document_id", "tag"],
    "faqs": ["document_id", "question", "answer"], "reading_progress": ["user_id", "document_id", "last_page"],
    "annotations": ["id", "document_id", "content"], "study_tasks": ["id", "document_id", "priority"], "users": ["id", "username"],
    "stored_chunks": ["chunk_id", "document_id", "content"], "stored_vectors": ["chunk_id", "document_id", "content", "embedding"],
}


def checksum(text: Column) -> Column:
    """Sum of hashes of the rows' texts: equal for equal rows in any order."""
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")), F.lit(0))


def counted(after: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in after.items():
        linked = F.count("document_id") if "document_id" in df.columns else F.count(F.lit(1))
        values = checksum(F.concat_ws("|", *[F.col(c).cast("string") for c in VALUES[name]]))
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), linked.alias("n_linked"), values.alias("checksum")).select(
            F.lit(name).alias("table_name"), "n_rows", "n_linked", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


def vector_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.round(x.cast("double"), 4).cast("string")), ",")


def stores(spark: SparkSession, d: str) -> tuple[str, str]:
    """All chunks and vectors as stores of two batches."""
    chunks, vectors = scratch(spark, "chunks"), scratch(spark, "vectors")
    for batch_id, odd in ((0, 1), (1, 0)):
        files.write_chunks(sh.chunks(spark, d).filter(F.col("document_id") % 2 == odd), chunks, batch_id)
        files.write_vectors(sh.chunk_vectors(spark, d).filter(F.col("document_id") % 2 == odd), vectors, batch_id)
    return chunks, vectors


def read_back(spark: SparkSession, chunks: str, vectors: str) -> dict[str, DataFrame]:
    return {"stored_chunks": files.read_chunks(spark, chunks), "stored_vectors": files.read_vectors(spark, vectors).withColumn("embedding", vector_text("embedding"))}


def q_delete_documents(spark: SparkSession, d: str) -> DataFrame:
    doomed = fx.documents(spark, d).filter("status = 'failed'").select(F.col("id").alias("document_id"))
    chunks, vectors = stores(spark, d)
    after = mt.delete_document_cascade(doomed, tables(spark, d), {chunks: 2, vectors: 2})
    return counted(after | read_back(spark, chunks, vectors))


def q_delete_users(spark: SparkSession, d: str) -> DataFrame:
    """The same for the documents of inactive users; the stores are compacted before they are read."""
    doomed = fx.users(spark, d).filter("NOT is_active").select(F.col("id").alias("user_id"))
    chunks, vectors = stores(spark, d)
    after = mt.delete_user_cascade(doomed, fx.users(spark, d), tables(spark, d), {chunks: 2, vectors: 2})
    for folder in (chunks, vectors):
        files.compact(spark, folder, f"{folder}-compact")
    return counted(after | read_back(spark, f"{chunks}-compact", f"{vectors}-compact"))


def q_delete_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Requests for every session, every third one by somebody else."""
    s = fx.sessions(spark, d)
    asked = s.filter("id % 2 = 0").select(F.col("id").alias("session_id"), F.expr("user_id + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END").alias("user_id"))
    sessions, messages = mt.delete_session_cascade(asked, s, fx.messages(spark, d))
    kept = messages.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n_messages"))
    return sessions.select("id", "user_id").join(kept, "id", "full_outer")


def q_upsert_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    asked = docs.select(
        F.col("id").alias("document_id"), F.expr("CASE WHEN id % 10 = 1 THEN owner_id + 1 ELSE owner_id END").alias("user_id"),
        F.explode(F.array(F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")), F.concat(F.lit("Status:"), "status"), F.concat(F.lit(" status:"), "status"))).alias("tag"))
    return mt.upsert_tags(asked, fx.tags(spark, d), docs)


def q_merge_progress(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as updates: older orders are stored, newer ones come in as a batch."""
    rows = fx.progress_updates(spark, d).withColumn("notes", F.expr("CASE WHEN version_key % 3 = 0 THEN concat('note ', version_key) END"))
    docs = fx.documents(spark, d)
    stored = ac.latest_progress(rows.filter("version_key % 2 = 0")).withColumn("notes", F.coalesce("notes", F.lit("")))
    batch = rows.filter("version_key % 2 = 1").withColumn(
        "user_id", F.when(F.col("version_key") % 5 == 0, F.col("document_id") % 20).otherwise(F.col("user_id"))).withColumn(
        "total_pages", F.when(F.col("version_key") % 4 == 1, F.col("total_pages"))).withColumn("completed", F.when(F.col("version_key") % 7 == 0, F.col("completed")))
    return mt.merge_progress(stored, batch, docs, fx.page_counts(spark, d))


def task_patches(spark: SparkSession, d: str) -> DataFrame:
    return fx.tasks(spark, d).filter("id % 2 = 0").select(
        "id", "user_id", F.expr("CASE id % 6 WHEN 0 THEN 0 WHEN 2 THEN id % 97 END").alias("document_id"),
        F.expr("CASE id % 8 WHEN 0 THEN 'high' WHEN 2 THEN 'urgent' END").alias("priority"),
        F.expr("CASE id % 10 WHEN 0 THEN 'done' WHEN 4 THEN 'paused' END").alias("status"),
        F.expr("CASE id % 14 WHEN 0 THEN '' WHEN 2 THEN '2024-03-05T10:30:00Z' WHEN 4 THEN '2024-04-01' WHEN 6 THEN 'next week' "
               "WHEN 8 THEN '2024-05-06T07:08:09+02:00' END").alias("due_date"))


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def q_patch_tasks(spark: SparkSession, d: str) -> DataFrame:
    after, refused = mt.patch_tasks(fx.tasks(spark, d), task_patches(spark, d))
    return after.join(refused, ["id", "user_id"], "left").select("id", "user_id", "document_id", stamp("due_date"), "priority", "status", "patched", "reason")


def q_validate_feedback(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.feedback(spark, d).withColumn("rating", F.expr("rating - CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 9 = 0 THEN 2 ELSE 0 END"))
    good, bad = mt.validate_feedback(asked)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("id", F.col("rating").cast("long").alias("rating"), "reason")


def q_validate_tasks(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("o_custkey % 20").alias("user_id"),
        F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 300 END").alias("document_id"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '2024-13-01' WHEN 2 THEN '2024-02-03T04:05:06Z' WHEN 3 THEN '' "
               "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias("due_text"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN '' END").alias("priority"))
    return mt.validate_tasks(asked, fx.documents(spark, d)).withColumn("due_date", stamp("due_date"))


def registrations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sign-ups: the customer's own name again, or a new name with a customer's mail."""
    known = fx.users(spark, d).select(F.col("id").alias("o_custkey"), "username", "email", "role", "is_active")
    joined = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey")
    taken = "o_orderkey % 11 = 0 AND is_active"
    return joined.select(
        F.col("o_orderkey").alias("request_id"),
        F.expr(f"CASE WHEN {taken} THEN concat('New', o_orderkey) ELSE username END").alias("username"),
        F.expr(f"CASE WHEN {taken} OR o_orderkey % 3 = 0 THEN email ELSE concat('alt', o_orderkey, '@example.com') END").alias("email"), "role")


def q_register_users(spark: SparkSession, d: str) -> DataFrame:
    return mt.register_users(registrations(spark, d), fx.users(spark, d).filter("is_active"))


def export(fmt: str):
    return lambda s, d: mt.export_messages(fx.messages(s, d), fmt, EXPORTED_AT)


def q_export_json(spark: SparkSession, d: str) -> DataFrame:
    """The exported texts parsed back, a row per message."""
    texts = mt.export_messages(fx.messages(spark, d), "json", EXPORTED_AT)
    layout = "exported_at string, service string, messages array<struct<id:bigint,role:string,content:string,confidence:double>>"
    parsed = texts.select("session_id", F.from_json("content", layout).alias("j"))
    return parsed.select("session_id", "j.exported_at", "j.service", F.posexplode("j.messages").alias("pos", "m")).select(
        "session_id", "exported_at", "service", (F.col("pos") + 1).cast("long").alias("position"), "m.id", "m.role", "m.content", "m.confidence")


def q_processed(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "processed")
    files.write_processed(pages_plan.merged_digital(spark, d), fx.documents(spark, d), folder, EXPORTED_AT, part_chars=2000)
    return files.read_processed(spark, folder).select(
        "document_id", "filename", F.col("version").cast("long").alias("version"), "page_number", "merged_text", F.array_join("source_types", ",").alias("source_types"))


def in_batches(rows: DataFrame, folder: str, write) -> None:
    """Odd documents, then even ones, then every third again, and the last batch a second time."""
    again = rows.filter("document_id % 3 = 0")
    for batch_id, part in ((0, rows.filter("document_id % 2 = 1")), (1, rows.filter("document_id % 2 = 0")), (2, again), (2, again)):
        write(part, folder, batch_id)


def q_write_chunks(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "chunks")
    in_batches(sh.chunks(spark, d), folder, files.write_chunks)
    return files.read_chunks(spark, folder).select(*sh.chunks(spark, d).columns)


def q_write_vectors(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "vectors")
    in_batches(sh.chunk_vectors(spark, d), folder, files.write_vectors)
    v = files.read_vectors(spark, folder)
    return v.select("chunk_id", "document_id", "page_number", "chunk_index", "source_type", "content", "char_count", vector_text("embedding").alias("embedding"))


def q_read_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The given vectors stored in two batches and read back, every component of them."""
    folder = scratch(spark, "given-vectors")
    v = fx.vectors(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    for name in ("page_number", "chunk_index", "char_count"):
        v = v.withColumn(name, F.lit(0).cast("long"))
    v = v.withColumn("source_type", F.lit("digital")).withColumn("content", F.lit(""))
    files.write_vectors(v.filter("document_id % 2 = 1"), folder, 0)
    files.write_vectors(v.filter("document_id % 2 = 0"), folder, 1)
    values = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ",")
    return files.read_vectors(spark, folder).select(F.col("chunk_id").cast("long").alias("chunk_id"), "document_id", values.alias("millionths"))


def value_text(field) -> Column:
    """A value as text that other engines write alike."""
    kind, c = field.dataType.simpleString(), F.col(field.name)
    if kind == "double":
        return F.round(c * 1_000_000).cast("bigint").cast("string")
    if kind == "timestamp_ntz":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def q_read_tables(spark: SparkSession, d: str) -> DataFrame:
    """Write all thirteen tables, scan them back with their fixed schemas: values and checksum of every column."""
    folder = scratch(spark, "tables")
    found = tables(spark, d)
    found.update({"users": fx.users(spark, d), "chat_sessions": fx.sessions(spark, d), "chat_messages": fx.messages(spark, d),
                  "feedbacks": fx.feedback(spark, d), "bookmarks": fx.bookmarks(spark, d),
                  "user_preferences": fx.preferences(spark, d).drop("preferences_json")})
    out = None
    for name in schemas.COLUMNS:
        files.write_table(found[name], folder, name)
        back = files.read_table(spark, folder, name)
        sums = [F.struct(F.lit(f.name).alias("column_name"), F.count(f.name).alias("n_values"), checksum(value_text(f)).alias("checksum")) for f in back.schema.fields]
        row = back.agg(F.array(*sums).alias("c"), F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.inline("c"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    "validate_uploads": lambda s, d: mt.validate_uploads(uploads(s, d)).select("upload_id", "original_name", "reject_reason"),
    "safe_filename": lambda s, d: fx.web_pages(s, d).select("document_id", files.safe_filename(F.col("url")).alias("name")),
    "file_hash": hashed,
    "find_duplicates": lambda s, d: mt.find_duplicates(hashed(s, d)),
    "register_documents": q_register,
    "write_processed": q_processed,
    "read_processed": lambda s, d: q_processed(s, d).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("merged_text")).alias("n_chars")),
    "read_tables": q_read_tables,
    "read_vectors": q_read_vectors,
    "write_chunks": q_write_chunks,
    "write_vectors": q_write_vectors,
    "delete_document_cascade": q_delete_documents,
    "delete_user_cascade": q_delete_users,
    "delete_session_cascade": q_delete_sessions,
    "upsert_tags": q_upsert_tags,
    "merge_progress": q_merge_progress,
    "patch_tasks": q_patch_tasks,
    "validate_feedback": q_validate_feedback,
    "validate_tasks": q_validate_tasks,
    "register_users": q_register_users,
    "export_md": export("md"),
    "export_txt": export("txt"),
    "export_json": q_export_json,
    "export_html": export("html"),
}
