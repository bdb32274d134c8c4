"""Which texts hold which needles, without a row for every pair of them.

A needle of three characters or more can only be in a text that has all its trigrams.  Texts are cut into trigrams in the
row and kept where somebody of their scope (an owner, a user) asks for one; these postings tell the rarest trigram
of every needle, and only texts with that one are looked at.  Shorter needles are few different strings: every text of
the scope is held against the list of them in the row.  Needles that several requests share are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text as tx
from pagelore.session import ensure_checkpoint_dir

GRAM = 3
#: Trigrams that a text is held against at once.
LIST_GRAMS = 4096


def grams(text: Column) -> Column:
    """Distinct trigrams; the text is cut into characters once, so a long one costs its length."""
    def cut(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + j) for j in range(GRAM)])))

    return F.when(F.length(text) >= GRAM, tx.let(F.split(text, ""), cut)).otherwise(F.array().cast("array<string>"))


def literal(needle: Column, wildcards: bool) -> Column:
    """The longest part that has to stand in the text as it is."""
    if not wildcards:
        return needle
    parts = F.transform(F.split(needle, r"[%_\\]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.array_max(parts)["p"]


def holds(text: Column, needle: Column, wildcards: bool) -> Column:
    """``text`` (lower case) holds ``needle`` (lower case); with ``wildcards`` as LIKE reads %, _ and the backslash."""
    plain = F.contains(text, needle)
    if not wildcards:
        return plain
    pattern = F.concat(F.lit("%"), needle, F.lit("%"))
    return F.when(needle.rlike(r"[%_\\]"), F.call_function("like", text, pattern)).otherwise(plain)


def matches(asked: DataFrame, texts: DataFrame, scope: str, key: str, wildcards: bool = False) -> DataFrame:
    """``scope``, ``needle``, ``key`` of every text that holds a needle of its scope, regardless of case.

    asked: scope, needle; texts: scope, key (unique), text.  Null needles and texts match nothing; an empty needle is in every text.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    texts = texts.select(scope, key, F.lower("text").alias("text")).filter(F.col("text").isNotNull())
    needles = asked.select(scope, F.lower("needle").alias("needle")).filter(F.col("needle").isNotNull()).distinct()
    sized = needles.withColumn("literal", literal(F.col("needle"), wildcards))
    long, short = sized.filter(F.length("literal") >= GRAM), sized.filter(F.length("literal") < GRAM)

    wanted = long.select(scope, "needle", F.explode(grams(F.col("literal"))).alias("gram"))
    distinct = wanted.select(scope, "gram").distinct()
    parts = distinct.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / LIST_GRAMS).alias("parts"))
    lists = distinct.join(parts, scope).groupBy(scope, F.pmod(F.xxhash64("gram"), F.col("parts")).alias("part")).agg(F.collect_list("gram").alias("grams"))
    postings = texts.join(lists, scope).select(scope, key, F.explode(F.array_intersect(grams(F.col("text")), "grams")).alias("gram")).checkpoint()
    known = postings.groupBy(scope, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(known, [scope, "gram"], "left").groupBy(scope, "needle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    near = rarest.join(postings, [scope, "gram"]).select(scope, "needle", key)
    found = near.join(texts.select(key, "text"), key).filter(holds(F.col("text"), F.col("needle"), wildcards)).select(scope, "needle", key)

    few = short.groupBy(scope).agg(F.collect_list("needle").alias("needles"))
    hit = F.filter("needles", lambda n: holds(F.col("text"), n, wildcards))
    return found.unionByName(texts.join(few, scope).select(scope, F.explode(hit).alias("needle"), key))
