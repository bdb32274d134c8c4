"""Batches of requests that are checked against an owner or an administrator, answered request by request.

Earlier requests of a batch come first: a row can be removed once, and a later request for it finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("student", "teacher", "researcher", "admin")


def delete_owned(requests: DataFrame, rows: DataFrame, keys: list[str], label: str, documents: DataFrame | None = None,
                 owner: str | None = "user_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, outcome of each request: ``request_id``, ``outcome``).

    requests: request_id, user_id and ``keys``.  ``owner`` names the column of ``rows`` that must be the asker; with ``documents``
    the asker must own the row's document, else the request is refused; with neither, anybody may remove a row.
    """
    stored = rows.select(*keys, *[c for c in ("document_id",) if documents is not None and "document_id" not in keys])
    if documents is not None:
        theirs = documents.select(F.col("id").alias("document_id"), F.col("owner_id").alias("_owner"))
        stored = stored.join(theirs, "document_id", "left").withColumn("_there", F.lit(True)).select(*keys, "_there", "_owner")
    else:
        held = rows[owner] if owner else F.lit(None).cast("long")
        stored = rows.select(*keys, F.lit(True).alias("_there"), held.alias("_owner"))
    found = requests.join(stored.distinct(), keys, "left")
    mine = F.col("_owner") == F.col("user_id") if owner or documents is not None else F.lit(True)
    there, allowed = F.col("_there").isNotNull(), F.col("_there").isNotNull() & F.coalesce(mine, F.lit(False))
    firsts = found.filter(allowed).groupBy(*keys).agg(F.min("request_id").alias("_first"))
    missing = F.lit(f"{label} not found")
    refused = F.lit("Not authorized") if documents is not None else missing
    outcome = F.when(there & ~allowed & (F.col("_first").isNull() | (F.col("request_id") < F.col("_first"))), refused).when(
        allowed & (F.col("request_id") == F.col("_first")), F.lit(f"{label} deleted")).otherwise(missing)
    answered = found.join(firsts, keys, "left").select("request_id", outcome.alias("outcome"))
    return rows.join(firsts, keys, "left_anti"), answered


def _newest(field: str) -> Column:
    """The field of the newest request that gives one."""
    return F.max(F.when(F.col(field).isNotNull(), F.struct("request_id", field)))[field].alias(f"_{field}")


def upsert_preferences(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Preferences after a batch of updates (request_id, user_id, theme, language, preferences_json); a null field keeps what is there.

    A user's first update starts from the light theme, English and no further preferences.
    """
    fields = {"theme": "light", "language": "en", "preferences_json": "{}"}
    folded = updates.groupBy("user_id").agg(*[_newest(f) for f in fields])
    kept = stored.select("user_id", *fields, F.lit(True).alias("_stored"))
    both = kept.join(folded, "user_id", "full_outer")
    return both.select("user_id", *[F.coalesce(f"_{f}", f, F.when(F.col("_stored").isNull(), F.lit(default))).alias(f) for f, default in fields.items()])


def switch_users(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users afterwards, outcome of each request) for requests (request_id, admin_id, user_id, role) of administrators.

    A request with a role sets it, one without turns ``is_active`` over.  Nobody switches themselves; who is an administrator is
    decided on the table as it is before the batch.
    """
    askers = users.select(F.col("id").alias("admin_id"), F.col("role").alias("_asker"))
    targets = users.select(F.col("id").alias("user_id"), F.col("username").alias("_name"), F.col("is_active").alias("_active"))
    asked = requests.join(askers, "admin_id", "left").join(targets, "user_id", "left")
    sets = F.col("role").isNotNull()
    refusal = (
        F.when(F.coalesce(F.col("_asker") != "admin", F.lit(True)), F.concat(F.lit("Role '"), F.coalesce("_asker", F.lit("")), F.lit("' not authorized")))
        .when(F.col("admin_id") == F.col("user_id"), F.when(sets, F.lit("Cannot change your own role")).otherwise(F.lit("Cannot deactivate yourself")))
        .when(F.col("_name").isNull(), F.lit("User not found"))
        .when(sets & ~F.col("role").isin(*ROLES), F.concat(F.lit("Invalid role: "), "role")))
    judged = asked.withColumn("outcome", refusal)
    good = judged.filter(F.col("outcome").isNull())
    change = good.groupBy("user_id").agg(_newest("role"), (F.count_if(F.col("role").isNull()) % 2 == 1).alias("_turned"))
    after = users.join(change.withColumnRenamed("user_id", "id"), "id", "left").withColumns({
        "role": F.coalesce("_role", "role"), "is_active": F.col("is_active") != F.coalesce("_turned", F.lit(False))}).drop("_role", "_turned")
    return after, judged.select("request_id", F.coalesce("outcome", F.lit("ok")).alias("outcome"))
