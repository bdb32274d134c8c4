"""Conversations, feedback, tags, progress and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators.running import number_rows
from pagelore.operators.substring import matches


# --- conversations -----------------------------------------------------------
def _latest(df: DataFrame, key: str, n: int, out: str = "newest") -> DataFrame:
    """The n newest rows per key; Spark cuts each key to n before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= n)


def session_history(messages: DataFrame, n: int = 10) -> DataFrame:
    """Last n messages of each session, numbered from old to new."""
    kept = _latest(messages, "session_id", n)
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    return kept.withColumn("position", F.row_number().over(order).cast("long")).drop("newest")


def context_window(messages: DataFrame, n: int = 6, max_chars: int = 2000) -> DataFrame:
    """``Role: text`` lines of the last messages as far as the budget reaches."""
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")))
    lines = session_history(messages, n).withColumn("line", F.concat(role, F.lit(": "), F.col("content")))
    running = Window.partitionBy("session_id").orderBy("position")
    fits = lines.withColumn("total", F.sum(F.length("line")).over(running))
    part = F.when(F.col("total") <= max_chars, F.struct("position", "line"))
    return fits.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["line"]), "\n").alias("context"))


def list_sessions(sessions: DataFrame, messages: DataFrame, n: int = 20) -> DataFrame:
    latest = _latest(sessions, "user_id", n)
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    return latest.join(counts, "id", "left").select(
        "user_id", "id", "title", F.col("newest").cast("long").alias("position"), F.coalesce("message_count", F.lit(0)).alias("message_count"))


def session_title(messages: DataFrame) -> DataFrame:
    """First hundred characters of the first question of a session."""
    asked = messages.filter(F.col("role") == "user")
    return asked.groupBy("session_id").agg(F.substring(F.min_by("content", "turn"), 1, 100).alias("title"))


def append_turns(answered: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sessions, new messages) for answered questions; a session is opened where none is given.

    answered: query_id, user_id, session_id (nullable), query, answer, confidence.
    """
    last = sessions.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    homeless = answered.filter(F.col("session_id").isNull())
    opened = number_rows(homeless, "query_id", "n").withColumn("session_id", last + F.col("n"))
    new_sessions = opened.select(F.col("session_id").alias("id"), "user_id", F.substring("query", 1, 100).alias("title"))
    placed = answered.filter(F.col("session_id").isNotNull()).unionByName(opened.select(*answered.columns))
    empty = F.lit(None).cast("double")
    turns = F.explode(F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("content"), empty.alias("confidence")),
        F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("confidence").alias("confidence"))))
    return new_sessions, placed.select("session_id", "query_id", turns.alias("t")).select("session_id", "query_id", "t.*")


def search_history(requests: DataFrame, sessions: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Sessions and bookmarks of the asking user that contain the text; found per user and needle, hits alone meet the requests."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("Session "), F.col("id").cast("string")))
    both = F.array("query", "answer")
    texts = sessions.select("user_id", F.lit("session").alias("kind"), "id", title.alias("text"), F.lit(0).alias("part")).unionByName(
        bookmarks.select("user_id", F.lit("bookmark").alias("kind"), "id", F.posexplode(both).alias("part", "text")))
    asked = requests.select("user_id", F.lower("needle").alias("key"), "request_id")
    name = F.concat_ws("/", "kind", F.col("id").cast("string"), F.col("part").cast("string"))
    found = matches(requests.select("user_id", "needle"), texts.select("user_id", name.alias("name"), "text"), "user_id", "name")
    hit = F.split("name", "/")
    rows = found.select("user_id", F.col("needle").alias("key"), hit[0].alias("kind"), hit[1].cast("long").alias("id")).distinct()
    return rows.join(asked, ["user_id", "key"]).select("request_id", "kind", "id")


# --- feedback ------------------------------------------------------------------
def feedback_aggregates() -> list[Column]:
    """Total, mean rating over all rows, helpful share and the 1..5 distribution."""
    n = F.count(F.lit(1))
    return [
        n.alias("total"),
        F.coalesce(F.round(F.try_divide(F.sum(F.coalesce("rating", F.lit(0))), n), 2), F.lit(0.0)).alias("average_rating"),
        F.coalesce(F.round(F.try_divide(F.count_if("helpful"), n) * 100, 1), F.lit(0.0)).alias("helpful_pct"),
        *[F.count_if(F.col("rating") == i).alias(f"rating_{i}") for i in range(1, 6)],
    ]


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(*feedback_aggregates())


def low_rated_queries(feedback: DataFrame, threshold: int = 2, limit: int = 50) -> DataFrame:
    low = feedback.filter(F.col("rating") <= threshold)
    return low.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "query", "rating", "comment", "created_at")


# --- lists ---------------------------------------------------------------------
def list_bookmarks(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.select("user_id", "id", "query", "answer", "confidence", "created_at").orderBy("user_id", F.desc("created_at"), F.desc("id"))


def document_tags(tags: DataFrame, documents: DataFrame) -> DataFrame:
    owned = documents.select(F.col("id").alias("document_id"), "owner_id")
    return tags.join(owned, "document_id").select("owner_id", "document_id", "tag").distinct()


def list_faqs(faqs: DataFrame, documents: DataFrame) -> DataFrame:
    """FAQs with the file name and how many the document has, newest first."""
    counts = faqs.groupBy("document_id").agg(F.count(F.lit(1)).alias("faq_count"))
    names = documents.select(F.col("id").alias("document_id"), "original_name", "owner_id")
    j = faqs.join(names, "document_id", "left").join(counts, "document_id")
    return j.select("owner_id", "id", "document_id", F.coalesce("original_name", F.lit("Unknown")).alias("filename"), "question", "answer",
                    "confidence", "faq_count", "created_at").orderBy("owner_id", F.desc("created_at"), F.desc("id"))


def list_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.select(
        "document_id", "user_id", "id", "page_number", "content", F.coalesce("highlight_text", F.lit("")).alias("highlight_text"),
        F.coalesce("color", F.lit("yellow")).alias("color"), "created_at"
    ).orderBy("document_id", "user_id", "page_number", "created_at")


def percentage(last: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0)).otherwise(F.bround(F.try_divide(last, total) * 100, 0).cast("long")).cast("long")


def latest_progress(updates: DataFrame) -> DataFrame:
    """One row per user and document: the fields of the newest version (no window, one aggregate)."""
    fields = [c for c in updates.columns if c not in ("user_id", "document_id", "version_key")]
    newest = F.max_by(F.struct(*fields), F.struct("version_key", *fields)).alias("r")  # equal versions: larger values win
    return updates.groupBy("user_id", "document_id").agg(newest).select("user_id", "document_id", "r.*")


def reading_progress(requests: DataFrame, progress: DataFrame, documents: DataFrame) -> DataFrame:
    """Progress of each asked (user, document); zeros where none is stored."""
    names = documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("filename"))
    j = requests.join(progress, ["user_id", "document_id"], "left").join(names, "document_id", "left")
    last, total = F.coalesce("last_page", F.lit(0)), F.coalesce("total_pages", F.lit(0))
    return j.select("user_id", "document_id", F.coalesce("filename", F.lit("Unknown")).alias("filename"), last.alias("last_page"),
                    total.alias("total_pages"), F.coalesce("completed", F.lit(False)).alias("completed"), percentage(last, total).alias("percentage"))


def preferences_with_defaults(users: DataFrame, preferences: DataFrame) -> DataFrame:
    p = preferences.withColumnRenamed("user_id", "id")
    return users.select("id").join(p, "id", "left").select(
        F.col("id").alias("user_id"), F.coalesce("theme", F.lit("light")).alias("theme"), F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("preferences_json", F.lit("{}")).alias("preferences_json"))


# --- tasks ---------------------------------------------------------------------
def filter_tasks(tasks: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    if status:
        tasks = tasks.filter(F.col("status") == status)
    if priority:
        tasks = tasks.filter(F.col("priority") == priority)
    return tasks


def list_tasks(tasks: DataFrame, documents: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    names = documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("document_name"))
    return filter_tasks(tasks, status, priority).join(names, "document_id", "left").select(
        "user_id", "id", "document_id", "document_name", "due_date", "priority", "status", "created_at"
    ).orderBy("user_id", F.asc_nulls_last("due_date"), F.desc("created_at"))


def task_board(tasks: DataFrame, priority: str | None = None) -> DataFrame:
    """Tasks with their board lane; kept as rows, so no lane is gathered into one value."""
    lane = F.when(F.col("status").isin(*fv.TASK_STATUSES), F.col("status"))
    return filter_tasks(tasks, None, priority).select("user_id", lane.alias("lane"), "id", "priority", "due_date").filter(F.col("lane").isNotNull())


def task_stats(tasks: DataFrame, as_of: Column) -> DataFrame:
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "done")
    return tasks.groupBy("user_id").agg(
        n.alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in fv.TASK_STATUSES],
        F.count_if((F.col("due_date") < as_of) & (F.col("status") != "done")).alias("overdue"),
        F.round(F.try_divide(done, n) * 100, 1).alias("completion_rate"))


def confidence_band(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c > 0.7, "green").when(c > 0.4, "yellow").otherwise("red")
    return rows.filter(c > 0).select("id", "confidence", band.alias("band"), F.concat(F.round(c * 100, 0).cast("bigint").cast("string"), F.lit("%")).alias("percent"))


def flashcard_progress(cards: DataFrame, marks: DataFrame) -> DataFrame:
    """Known share of a deck and the size of the deck still to learn."""
    j = cards.join(marks, ["deck_id", "card_id"], "left")
    known = F.coalesce(F.col("mark") == "known", F.lit(False))
    return j.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(known).alias("known"),
        F.floor(F.try_divide(F.count_if(known), F.count(F.lit(1))) * 100 + 0.5).alias("progress"),
        F.count_if(~known).alias("unknown_deck"))
