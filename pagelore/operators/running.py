"""Running sums and numbering that never put one key into a single task.

The rows of a key are cut into segments of bounded size.  A window works inside
a segment; the totals of the earlier segments come from a pre-aggregated table
with one row per segment.  Keys with a single segment add nothing to that table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.session import ensure_checkpoint_dir


#: Bits of the table that tells which rows may be asked for: one megabyte, whatever the input.
FILTER_BITS = 23


def bit_table(hashes: DataFrame) -> DataFrame:
    """``_word``, ``_bits``: the hashes (``th``) as a set of bits, one megabyte at most."""
    bit = F.col("th").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.groupBy(F.shiftright(bit, 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))


def marked(docs: DataFrame, bits: DataFrame, th: str) -> DataFrame:
    """``docs`` with ``_may``: false only where the hash in ``th`` is surely not in the table."""
    bit = F.col(th).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    found = F.call_function("shiftrightunsigned", F.col("_bits"), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return docs.join(F.broadcast(bits), F.shiftright(bit, 6) == F.col("_word"), "left").withColumn("_may", F.coalesce(found == 1, F.lit(False))).drop("_word", "_bits")


def segment_offsets(df: DataFrame, keys: list[str], segment: str, order: str, value: str, out: str,
                    wide_rows: DataFrame | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the key that come before, as ``out``.

    ``wide_rows`` may give the rows of just the keys that reach past their first
    segment, so that the totals need not be taken from all rows.
    """
    inside = Window.partitionBy(*keys, segment).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if wide_rows is None:
        wide_rows = rows_of_wide(df, keys, segment)
    totals = wide_rows.groupBy(*keys, segment).agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, segment, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_shift"))

    joined = local.join(shifts, [*keys, segment], "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce("_shift", F.lit(0))).drop("_local", "_shift", segment)


def wide_keys(df: DataFrame, keys: list[str], segment: str) -> DataFrame:
    return df.filter(F.col(segment) > 0).select(*keys).distinct()


def rows_of_wide(df: DataFrame, keys: list[str], segment: str) -> DataFrame:
    """The rows of the keys that reach past their first segment; what surely has no such key stays at the scan."""
    wide, th = wide_keys(df, keys, segment), F.xxhash64(*keys)
    may = marked(df.withColumn("_th", th), bit_table(wide.select(th.alias("th"))), "_th").filter("_may").drop("_th", "_may")
    return may.join(wide, keys, "left_semi")


def number_rows(df: DataFrame, order: str | list[str], out: str) -> DataFrame:
    """1.. over the whole frame in the order of the columns ``order`` (nulls first), as ``out``.

    The rows are dealt out by range, sorted and written to the checkpoint folder, so that a row keeps its
    place.  Its number is that place plus the rows of the partitions before; the sizes of the
    partitions (one row each, whatever the values are) are all that meets in one place.  Rows
    equal in ``order`` are numbered one after the other in no stated order; a hot value that must be
    split over tasks needs a further column.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [F.asc_nulls_first(c) for c in ([order] if isinstance(order, str) else order)]
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count(F.lit(1))).collect())
    before = accumulate([n for _, n in sizes], initial=0)
    shifts = spark.createDataFrame([(part, shift) for (part, _), shift in zip(sizes, before)], "_part long, _shift long")
    return placed.join(F.broadcast(shifts), "_part").withColumn(out, F.col("_place") + F.col("_shift") + 1).drop("_part", "_place", "_shift")
