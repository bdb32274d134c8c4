"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / weight``; within its source the
documents are taken in key order until the source's token budget is met.  Complete
epochs of a source precede the fractional one.

The order within a source is never sorted by one task: keys fall into bins of their
logarithm (a bin holds about 0.1% of a source whatever the weights), bins are summed
first, and a window works inside one bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm.common import cut, n_words, replace, table

#: Weights of the sources by rank of their name, repeating; null ranks last.
CYCLE = (1, 2, 3)
#: A source is repeated at most so often.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Bins of the sampling key to one e-fold.
BINS = 256
#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>{}~^=+_@"


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.05 where a fifth of the characters are symbols."""
    chars = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / chars), F.lit(1.0))


def _uniform(seed: str) -> Column:
    """In (0, 1), from the id alone, or from the text where the id is null."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source: shares by weight, stopped at ``max_epochs`` times its size, the excess reshared.

    ``sizes`` has one row per source (``source``, ``source_size``), so its windows see as many
    rows as there are sources.  Filling up is closed form: in order of cap per weight, a source is
    capped if its share of what the earlier ones leave exceeds its cap; the level is the largest share.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int"))
    order = [(F.col("_cap") / F.col("_w")).asc(), F.col("_rank").asc()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        sizes.withColumn("_rank", rank).withColumn("_cap", cap).withColumn("_w", weight)
        .withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))
    )


def mix(docs: DataFrame, weight: Column | None = None, seed: str = SEED, cycle=CYCLE,
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size`` counts words (null text: 0), ``copies`` says how often the mix takes the whole document,
    ``taken`` is ``size * copies``.  The last document of a fractional epoch is taken if that brings the
    source nearer to its target.  A null source is a source of its own, last in order.  Rows that
    repeat an id are separate documents; ties of the key are broken by size and are interchangeable
    beyond that.  Null ids draw their key from the text.  An empty table gives an empty result.
    Input columns named like an output give way to it.
    """
    base = docs
    for name, kind in (("doc_id", "long"), ("text", "string"), ("source", "string")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    key = -F.log(_uniform(seed)) / (quality_weight(F.col("text")) if weight is None else weight)
    base = base.withColumns({
        "_size": n_words(F.col("text")), "_key": key,
        "_group": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")),
    }).withColumn("_bin", F.floor(F.log("_key") * BINS))

    bins = cut(base.groupBy("_group", "_bin").agg(F.sum("_size").alias("_in_bin"), F.first("source").alias("source")))
    sizes = bins.groupBy("_group").agg(F.first("source").alias("source"), F.sum("_in_bin").alias("source_size"))
    goal = targets(sizes, cycle, max_epochs).withColumn("_group", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    earlier = Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        bins.drop("source").withColumn("_start", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0))).join(goal, "_group")
        .withColumn("_epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .select("_group", "_bin", "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_epochs",
                (F.col("target") - F.col("_epochs") * F.col("source_size")).alias("_rest"))
    )
    inside = Window.partitionBy("_group", "_bin").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(plan, ["_group", "_bin"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    nearer = F.lit(2.0) * F.col("_before") + F.col("_size") <= F.lit(2.0) * F.col("_rest")
    copies = (F.col("_epochs") + F.when(nearer & (F.col("_rest") > 0), 1).otherwise(0)).cast("long")
    placed = placed.withColumn("_copies", copies)
    return replace(placed.select(*docs.columns, "_size", "_source_size", "_target", "_copies"), {
        "size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"),
        "copies": F.col("_copies"), "taken": F.col("_copies") * F.col("_size"),
    }).drop("_size", "_source_size", "_target", "_copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    chosen = mix(docs, **options).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return chosen.select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mix_sources": op1_mix_sources}

ORACLE = {"op1_mix_sources": rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5) / {float(2**52)!r} AS u,
    coalesce(greatest(0.05, 1.0::DOUBLE - 5.0::DOUBLE * (length(text) - length(translate(text, '{SYMBOLS}', ''))) / greatest(length(text), 1)), 1.0) AS weight
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sizes),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CAST([1, 2, 3][1 + pos % 3] AS DOUBLE) AS w FROM ranked),
levels AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM caps),
goal AS (SELECT source, source_size, least(cap, max(share) OVER () * w) AS target FROM levels),
placed AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY -ln(b.u) / b.weight, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((epochs + CASE WHEN target - epochs * source_size > 0 AND 2.0 * before + size <= 2.0 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed"""}
