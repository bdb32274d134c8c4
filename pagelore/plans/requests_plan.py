"""Catalog: batches of owner-checked requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import requests as rq
from pagelore.plans import fixtures as fx


def q_delete_owned(spark: SparkSession, d: str) -> DataFrame:
    """Requests for some rows of five tables: by their owner, by somebody else, twice, and for rows that are not there."""
    docs, faqs, tags = fx.documents(spark, d), fx.faqs(spark, d), fx.tags(spark, d)
    tables = {"Bookmark": fx.bookmarks(spark, d), "Annotation": fx.annotations(spark, d), "Task": fx.tasks(spark, d), "FAQ": faqs}
    owners = {name: rows.select("id", "user_id") for name, rows in tables.items() if name != "FAQ"}
    owners["FAQ"] = faqs.join(docs.select(F.col("id").alias("document_id"), F.col("owner_id").alias("user_id")), "document_id").select("id", "user_id")
    parts = []
    for name, rows in tables.items():
        some = owners[name].filter("id % 7 < 3")
        batch = some.selectExpr("id * 10 AS request_id", "id", "user_id + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS user_id").unionByName(
            some.filter("id % 2 = 0 OR id % 3 = 0").selectExpr("id * 10 + 1 AS request_id", "id", "user_id")).unionByName(
            some.filter("id % 4 = 1").selectExpr("id * 10 + 2 AS request_id", "-id AS id", "user_id"))
        kept, answers = rq.delete_owned(batch, rows, ["id"], name, docs if name == "FAQ" else None)
        parts.append((name, answers, kept.select(F.col("id").alias("request_id"))))
    batch = tags.filter("document_id % 3 = 0 AND tag LIKE 'src%'").selectExpr("document_id AS request_id", "document_id", "tag", "0L AS user_id")
    kept, answers = rq.delete_owned(batch, tags, ["document_id", "tag"], "Tag", owner=None)
    parts.append(("Tag", answers, kept.select(F.col("document_id").alias("request_id"))))
    out = None
    for name, answers, left in parts:
        part = answers.unionByName(left.withColumn("outcome", F.lit("kept"))).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def q_upsert_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Orders as updates of their customer's preferences, each with some of the fields."""
    updates = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' END").alias("theme"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'es' END").alias("language"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN concat('{\"last\": ', o_orderkey, '}') END").alias("preferences_json"))
    return rq.upsert_preferences(fx.preferences(spark, d), updates)


def q_switch_users(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests of administrators and others to switch their customer."""
    asked = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.expr("o_orderkey % 97").alias("admin_id"),
        F.expr("CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 97 WHEN o_orderkey % 17 = 0 THEN -o_custkey ELSE o_custkey END").alias("user_id"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'teacher' WHEN 1 THEN 'admin' WHEN 2 THEN 'owner' END").alias("role"))
    after, answers = rq.switch_users(asked, fx.users(spark, d))
    state = F.concat_ws("|", "role", F.col("is_active").cast("string"))
    return answers.select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), "outcome").unionByName(
        after.select(F.lit("user").alias("kind"), "id", state.alias("outcome")))


QUERIES = {"delete_owned": q_delete_owned, "upsert_preferences": q_upsert_preferences, "switch_users": q_switch_users}
