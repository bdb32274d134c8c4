"""Session helpers shared by the bench, the tests and the query catalog."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only ever broadcast by hand after its row count has been checked
# against this bound; everything else is left to Spark's own size threshold.
BROADCAST_ROWS = 4096


def build_session(app: str = "pagelore", master: str = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", **conf: str) -> SparkSession:
    """Local session for tests and bench; on a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


# The optimizer puts "array is not empty" filters below every explode and pushes them
# through the projections that compute the array, so that a whole cleaning chain runs
# two or more times per row.  Here arrays are computed, never stored: leave it out.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def tune(spark: SparkSession) -> None:
    """Session settings the operators count on; safe to call again."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    excluded = spark.conf.get("spark.sql.optimizer.excludedRules", "") or ""
    if EXCLUDED_RULE not in excluded:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(filter(None, [excluded, EXCLUDED_RULE])))


def once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and a dear ``value``, which later filters read but never evaluate again (no filter passes a generator)."""
    return df.select(*keep, F.inline(F.array(F.struct(value.alias(name)))))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session, whose driver and executors are one machine, may go without it.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pagelore-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores by the hash of their columns.

    Splits say little about rows: a file with one row group has many splits by its size, but all its rows are
    read by one task.  So every scan is dealt out, to as many tasks as it has splits, one for each core at least.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), *df.columns)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="pagelore-package-")) / "pagelore"), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
