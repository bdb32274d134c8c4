"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash into buckets small enough for a task's memory.
Pass two shuffles each bucket (``shuffle`` over an array is a Fisher-Yates shuffle) and deals the
records out in that order, so that shard counts differ by one at most.

The scatter names its number of partitions and the buckets of a partition are shuffled in order, so
the seeded shuffle gives the same order whenever it is run or recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm.common import table

SHARDS = 16
SEED = 20240607
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20


def record_bytes(name: str = "text"):
    """UTF-8 bytes of the text (null: none) and one for the separator."""
    return F.coalesce(F.octet_length(name), F.lit(0)).cast("long") + F.lit(1)


def external_shuffle(records: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns with ``shard`` (0-based) and ``slot`` (its place there, gapless from 0).

    The place of a record depends on ids, texts, seed and number of buckets alone.  Records without
    an id or text, and rows that repeat, are records like others; equal rows share a bucket.
    An empty table gives an empty result.  Input columns named ``shard`` or ``slot`` give way.
    """
    if "doc_id" not in records.columns or "text" not in records.columns:
        raise ValueError("records need doc_id and text")
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    total = records.agg(F.sum(record_bytes())).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    tagged = records.select(F.pmod(spread, F.lit(buckets)).alias("_bucket"), F.struct(*kept).alias("_row"), spread.alias("_order"))

    counts = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col("_bucket") / 4096)
    per_block = counts.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_n_block"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select("_block", F.coalesce(F.sum("_n_block").over(before().orderBy("_block")), F.lit(0)).alias("_block_start"))
    starts = (
        counts.withColumn("_block", block).withColumn("_inner", F.coalesce(F.sum("_n").over(before("_block").orderBy("_bucket")), F.lit(0)))
        .join(per_block, "_block").select("_bucket", (F.col("_inner") + F.col("_block_start")).alias("_start"))
    )
    shuffled = (
        tagged.repartition(int(buckets), "_bucket").groupBy("_bucket").agg(F.collect_list(F.struct("_order", "_row")).alias("_rows"))
        .sortWithinPartitions("_bucket")  # buckets that share a partition draw from one generator, in this order
        .select("_bucket", F.shuffle(F.array_sort("_rows", lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)), F.lit(seed)).alias("_rows"))
        .select("_bucket", F.posexplode("_rows").alias("_pos", "_item"))
    )
    place = (F.col("_start") + F.col("_pos")).cast("long")
    return shuffled.join(starts, "_bucket").select(
        "_item._row.*", (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(records: DataFrame, path: str, **options) -> None:
    """The shuffled records as one folder per shard, each file in slot order."""
    placed = external_shuffle(records, **options)
    placed.repartition(options.get("shards", SHARDS), "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs).select(
        "doc_id", record_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_external_shuffle": op6_external_shuffle}
