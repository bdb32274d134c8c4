"""Table maintenance: validation, upserts, cascading deletes and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators.components import components, pair_key
from pagelore.operators.running import number_rows
from pagelore.session import ensure_checkpoint_dir
from pagelore.sources import files


# --- deletes -------------------------------------------------------------------
def delete_document_cascade(doomed: DataFrame, tables: dict[str, DataFrame], stores: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Tables after removing documents: dependants go with them, tasks lose the link.

    ``stores`` are folders of chunk or vector batches with the id of the batch that takes the tombstones.
    """
    ids = doomed.select("document_id").distinct()
    for folder, batch_id in (stores or {}).items():
        files.delete_documents(doomed.sparkSession, folder, batch_id, ids)
    out = {}
    for name, df in tables.items():
        if name == "documents":
            out[name] = df.join(ids.withColumnRenamed("document_id", "id"), "id", "left_anti")
        elif name == "study_tasks":
            gone = ids.withColumn("_gone", F.lit(True))
            kept = df.join(gone, "document_id", "left")
            out[name] = kept.withColumn("document_id", F.when(F.col("_gone").isNull(), F.col("document_id"))).drop("_gone")
        else:
            out[name] = df.join(ids, "document_id", "left_anti")
    return out


def delete_user_cascade(doomed: DataFrame, users: DataFrame, tables: dict[str, DataFrame], stores: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Remove users, their documents and everything that hangs on those documents, stored chunks and vectors too."""
    ids = doomed.select("user_id").distinct()
    theirs = tables["documents"].join(ids.withColumnRenamed("user_id", "owner_id"), "owner_id", "left_semi")
    out = delete_document_cascade(theirs.select(F.col("id").alias("document_id")), tables, stores)
    out["users"] = users.join(ids.withColumnRenamed("user_id", "id"), "id", "left_anti")
    return out


def delete_session_cascade(requests: DataFrame, sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the owner's request removes a session; its messages go with it."""
    asked = requests.select(F.col("session_id").alias("id"), "user_id").distinct()
    gone = sessions.join(asked, ["id", "user_id"], "left_semi").select("id")
    return (sessions.join(gone, "id", "left_anti"),
            messages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti"))


# --- upserts -------------------------------------------------------------------
def upsert_tags(requests: DataFrame, existing: DataFrame, documents: DataFrame) -> DataFrame:
    """Normalised new tags of owned documents added to the stored ones."""
    owned = documents.select(F.col("id").alias("document_id"), F.col("owner_id").alias("user_id"))
    fresh = requests.withColumn("tag", F.lower(tx.strip(F.col("tag")))).join(owned, ["document_id", "user_id"], "left_semi")
    new = fresh.select("document_id", "tag").dropDuplicates().join(existing, ["document_id", "tag"], "left_anti")
    return existing.select("document_id", "tag").unionByName(new)


def merge_progress(stored: DataFrame, updates: DataFrame, documents: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Upsert of reading positions; a batch may hold many updates of one key.

    Folded per key by aggregation: the newest update gives last_page, the newest given
    value of every other field wins, and a first insert needs an owned document.
    updates: user_id, document_id, last_page, total_pages, notes, completed, version_key.
    """
    keys = ["user_id", "document_id"]

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("version_key", c))).alias(f"new_{c}")

    folded = updates.groupBy(*keys).agg(
        newest("last_page"), newest("total_pages"), newest("notes"), newest("completed"))
    owned = documents.select(F.col("id").alias("document_id"), F.col("owner_id").alias("user_id"), F.lit(True).alias("owned"))
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("last_page", "total_pages", "notes", "completed")], F.lit(True).alias("known"))
    j = old.join(folded, keys, "full_outer").join(owned, keys, "left").join(page_counts, "document_id", "left")
    j = j.filter(F.col("known").isNotNull() | F.col("owned").isNotNull())
    start = F.coalesce("page_count", F.lit(0))
    return j.select(
        *keys, F.coalesce("new_last_page", "old_last_page").alias("last_page"),
        F.coalesce("new_total_pages", F.when(F.col("known").isNotNull(), F.col("old_total_pages")).otherwise(start)).alias("total_pages"),
        F.coalesce("new_notes", "old_notes", F.lit("")).alias("notes"), F.coalesce("new_completed", "old_completed", F.lit(False)).alias("completed"))


ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def parse_iso(c: Column) -> Column:
    """ISO date or timestamp as wall-clock time; a trailing zone is dropped, as the task table has none."""
    plain = F.regexp_replace(c, r"(?:Z|[+-]\d{2}:\d{2})$", "")
    return F.when(c.rlike(ISO_SHAPE), F.when(c.contains(":"), plain).otherwise(c).try_cast("timestamp_ntz"))


def patch_tasks(tasks: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks after partial updates, refused patches); null keeps a field, an empty value clears it."""
    due = parse_iso(F.col("p_due_date"))
    reason = (
        F.when(F.col("p_priority").isNotNull() & ~F.col("p_priority").isin(*fv.PRIORITIES), "Priority must be low, medium, or high")
        .when(F.col("p_status").isNotNull() & ~F.col("p_status").isin(*fv.TASK_STATUSES), "Status must be todo, in_progress, or done")
        .when(F.col("p_due_date").isNotNull() & (F.col("p_due_date") != "") & due.isNull(), "Invalid date format"))
    p = patches.select("id", "user_id", *[F.col(c).alias(f"p_{c}") for c in ("document_id", "priority", "status", "due_date")]).withColumn("reason", reason)
    refused = p.filter(F.col("reason").isNotNull()).select("id", "user_id", "reason")
    good = p.filter(F.col("reason").isNull()).drop("reason").withColumn("patched", F.lit(True))
    j = tasks.join(good, ["id", "user_id"], "left")
    after = j.select(
        "id", "user_id",
        F.when(F.col("p_document_id").isNull(), F.col("document_id")).otherwise(F.nullif("p_document_id", F.lit(0))).alias("document_id"),
        F.when(F.col("p_due_date").isNull(), F.col("due_date")).when(F.col("p_due_date") != "", due).alias("due_date"),
        F.coalesce("p_priority", "priority").alias("priority"), F.coalesce("p_status", "status").alias("status"),
        F.coalesce("patched", F.lit(False)).alias("patched"))
    return after, refused


# --- validation ------------------------------------------------------------------
def validate_feedback(submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    return submitted.filter(good), submitted.filter(~good).withColumn("reason", F.lit("Rating must be between 1 and 5"))


def validate_tasks(submitted: DataFrame, documents: DataFrame) -> DataFrame:
    """New tasks with their reject reason; due dates parsed, documents checked for the owner."""
    owned = documents.select(F.col("id").alias("document_id"), F.col("owner_id").alias("user_id"), F.lit(True).alias("owned"))
    has_due = F.coalesce(F.col("due_text"), F.lit("")) != ""
    due = F.when(has_due, parse_iso(F.col("due_text")))
    has_doc = F.coalesce("document_id", F.lit(0)) != 0
    j = submitted.join(owned, ["document_id", "user_id"], "left").withColumn("due_date", due)
    reason = F.when(has_due & F.col("due_date").isNull(), "Invalid date format. Use ISO format.").when(
        has_doc & F.col("owned").isNull(), "Document not found")
    return j.select("id", "user_id", "document_id", "due_date", F.coalesce(F.nullif("priority", F.lit("")), F.lit("medium")).alias("priority"),
                    reason.alias("reject_reason"))


#: Rounds in which first claims are settled in bulk before the rest is folded by clash group.
BULK_ROUNDS = 2


def register_users(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Accepted registrations: user name and e-mail must both be free, earlier requests first.

    Of equal (name, e-mail) pairs only the first can win.  Two bulk rounds accept the requests that come first for both
    their name and their e-mail and drop what clashes with them, which also settles a name that a large share asks
    for.  What is left, chains of clashes, falls into connected groups; each is folded in request order, streaming, with
    the names and e-mails that it has given away.  Jobs grow with the logarithm of the longest chain.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    free = requests.join(existing.select("username"), "username", "left_anti").join(existing.select("email"), "email", "left_anti")
    columns = ["request_id", "username", "email", "role"]
    waiting = free.groupBy("username", "email").agg(F.min(F.struct("request_id", "role")).alias("first")).select(
        "first.request_id", "username", "email", "first.role").checkpoint()
    accepted = []
    for _ in range(BULK_ROUNDS):
        by_name = waiting.groupBy("username").agg(F.min("request_id").alias("_name"))
        by_mail = waiting.groupBy("email").agg(F.min("request_id").alias("_mail"))
        first = waiting.join(by_name, "username").join(by_mail, "email").filter(
            (F.col("request_id") == F.col("_name")) & (F.col("request_id") == F.col("_mail"))).select(*columns).checkpoint()
        accepted.append(first)
        waiting = waiting.join(first.select("username"), "username", "left_anti").join(first.select("email"), "email", "left_anti").checkpoint()

    groups = components(waiting.select(pair_key("name", "username").alias("a"), pair_key("mail", "email").alias("b")))
    chains = waiting.withColumn("node", pair_key("name", "username")).join(groups, "node").select("component", *columns)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, names, mails = None, set(), set()
        for frame in frames:
            won = []
            for component, name, mail in zip(frame["component"], frame["username"], frame["email"]):
                if component != group:
                    group, names, mails = component, set(), set()
                won.append(name not in names and mail not in mails)
                if won[-1]:
                    names.add(name)
                    mails.add(mail)
            yield frame.loc[won, columns]

    kinds = ", ".join(f"{c} {waiting.schema[c].dataType.simpleString()}" for c in columns)
    folded = chains.repartition("component").sortWithinPartitions("component", "request_id").mapInPandas(fold, kinds)
    return accepted[0].unionByName(accepted[1]).unionByName(folded)


# --- uploads -------------------------------------------------------------------
def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Reject reason per upload: suffix, content type, size (in that order), null when accepted."""
    name = F.coalesce("original_name", F.lit(""))
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))
    kind = F.coalesce("content_type", F.lit(""))
    reason = (
        F.when((name != "") & ~suffix.isin(*fv.ALLOWED_SUFFIXES), F.concat(F.lit("Invalid file type '"), suffix, F.lit("'. Only PDF files are allowed.")))
        .when((kind != "") & ~F.lower(kind).contains("pdf"), F.lit("File content type must be application/pdf"))
        .when(F.col("file_size") > fv.MAX_FILE_MB * 1024 * 1024, F.concat(
            F.lit("File size "), F.format_string("%.1f", F.round(F.col("file_size") / (1024 * 1024), 1)), F.lit(f"MB exceeds limit of {fv.MAX_FILE_MB}MB"))))
    return uploads.withColumn("reject_reason", reason)


def find_duplicates(documents: DataFrame) -> DataFrame:
    """Smallest document with the same content, for every document that has one before it.

    The hashes are counted before any join; only repeated ones come back, and Spark splits
    a hash that holds a large share of the rows.
    """
    firsts = documents.groupBy("file_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return documents.join(firsts, "file_hash").filter(F.col("id") != F.col("first_id")).select("id", "first_id", "file_hash")


def register_documents(uploads: DataFrame, existing_max: DataFrame) -> DataFrame:
    """Document rows for accepted uploads; ids continue after the largest stored one."""
    return number_rows(uploads, "upload_id", "n").select(
        (existing_max.select("max_id").scalar() + F.col("n")).alias("id"), "filename", "original_name", "file_size", "file_hash",
        F.lit("uploaded").alias("status"), "owner_id")


# --- exports -------------------------------------------------------------------
HTML_STYLE = fv.HTML_STYLE


def _percent(c: Column) -> Column:
    return F.concat(F.round(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def export_messages(messages: DataFrame, fmt: str, exported_at: str, label: str = "Assistant", limit: int = 100) -> DataFrame:
    """One text per session from its last ``limit`` messages, in md, txt, html or json form.

    messages: session_id, id, created_at, role, content, confidence and, optionally,
    sources (array of structs with file and page).
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    user, sure = F.col("role") == "user", F.coalesce(F.col("confidence"), F.lit(0.0)) != 0
    if fmt == "md":
        listed = F.lit("")
        if "sources" in messages.columns:
            lines = F.transform("sources", lambda s: F.concat(F.lit("- "), F.coalesce(s["file"], F.lit("Document")), F.lit(", Page "),
                                                              F.coalesce(s["page"].cast("string"), F.lit("?")), F.lit("\n")))
            listed = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.concat(F.lit("**Sources:**\n"), F.array_join(lines, ""), F.lit("\n"))).otherwise("")
        part = F.when(user, F.concat(F.lit("**You:** "), F.col("content"), F.lit("\n\n"))).otherwise(F.concat(
            F.lit(f"**{label}:** "), F.col("content"), F.lit("\n\n"),
            F.when(sure, F.concat(F.lit("> Confidence: "), _percent(F.col("confidence")), F.lit("\n\n"))).otherwise(""), listed, F.lit("---\n\n")))
        head, tail = f"# {label} Chat Export\n_Exported: {exported_at}_\n\n---\n\n", ""
    elif fmt == "txt":
        part = F.concat(F.when(user, F.lit("You")).otherwise(F.lit(label)), F.lit(": "), F.col("content"), F.lit("\n\n"))
        head, tail = f"{label} Chat Export - {exported_at}\n{'=' * 50}\n\n", ""
    elif fmt == "html":
        part = F.concat(F.lit('<div class="msg '), F.when(user, "user").otherwise("assistant"), F.lit('">'), F.col("content"),
                        F.when(sure, F.concat(F.lit('<div class="meta">Confidence: '), _percent(F.col("confidence")), F.lit("</div>"))).otherwise(""),
                        F.lit("</div>\n"))
        head = (f'<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>{label} Chat Export</title>\n<style>\n{HTML_STYLE}</style></head><body>\n'
                f'<h1>{label} Chat Export</h1><p style="color:#6b7280">Exported: {exported_at}</p><hr>\n')
        tail = "</body></html>"
    elif fmt == "json":
        fields = [c for c in ("id", "role", "content", "confidence", "sources") if c in messages.columns]
        rows = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", F.struct(*fields).alias("m")))), lambda x: x["m"])
        return kept.groupBy("session_id").agg(F.to_json(F.struct(
            F.lit(exported_at).alias("exported_at"), F.lit(label).alias("service"), rows.alias("messages"))).alias("content"))
    else:
        raise ValueError(f"unsupported format: {fmt}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", part.alias("t")))), lambda x: x["t"])
    return kept.groupBy("session_id").agg(F.concat(F.lit(head), F.array_join(ordered, ""), F.lit(tail)).alias("content"))
