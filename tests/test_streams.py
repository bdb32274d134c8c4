"""Streams over several files out of time order, one file a micro-batch, against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from pagelore.operators import cache as ca
from pagelore.streaming import jobs

ROWS = [(i, random.Random(i).choice(["a", "a", "a", "b", "c", None]), random.Random(i + 9000).randrange(40 * 86_400)) for i in range(600)]


@pytest.fixture
def landed(spark, tmp_path):
    """Files by a shuffled part number, so that the newest rows come first in some; equal times and keys are among them."""
    rows = [*ROWS, *[(1000 + i, "a", 7200) for i in range(4)]]
    order = rows[:]
    random.Random(5).shuffle(order)
    order = sorted(order[:200], key=lambda r: -r[2]) + order[200:]
    df = lambda part: spark.createDataFrame(part, "id long, kind string, s long").select("id", "kind", F.timestamp_seconds("s").alias("at"))
    for n in range(6):
        df(order[n::6] if n else order[::6]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df(rows), jobs.file_stream(spark, f"{tmp_path}/in", "*.parquet", df(rows).schema, files_per_batch=1), str(tmp_path)


def test_cache_judges_late_requests(spark, landed):
    rows, stream, folder = landed
    asked = lambda df: df.select(F.col("id").alias("event_id"), F.coalesce("kind", F.lit("")).alias("cache_key"), F.col("at").alias("asked_at"))
    jobs.cache_state(asked(stream), f"{folder}/out", f"{folder}/progress", 3600, "1 hour")
    want = {r.event_id: r.is_hit for r in ca.cache_hits_ttl(asked(rows).withColumnRenamed("asked_at", "ts"), 3600, 7).collect()}
    got = jobs.judged(spark, f"{folder}/out").collect()
    assert {r.event_id: r.is_hit for r in got} == want and len(got) == len(want)
    counts = jobs.late_counts(spark, f"{folder}/out").collect()
    assert len(counts) == 6 and sum(r.n_rows for r in counts) == len(want) and sum(r.n_late for r in counts) > 100
    assert spark.read.parquet(f"{folder}/out/late").count() == sum(r.n_late for r in counts)


def test_windows_count_late_rows(spark, landed):
    rows, stream, folder = landed
    events = lambda df: df.select(F.coalesce("kind", F.lit("?")).alias("event_type"), "at")
    jobs.recent_activity(events(stream), f"{folder}/out", f"{folder}/progress")
    want = sorted(map(tuple, jobs.activity_windows(events(rows), "at").collect()))
    assert sorted(map(tuple, jobs.activity_so_far(spark, f"{folder}/out").collect())) == want


def test_first_arrival_may_come_late(spark, landed):
    rows, stream, folder = landed
    sent = lambda df: df.select("id", F.concat(F.coalesce("kind", F.lit("?")), F.col("id") % 7).alias("file_hash"), F.col("at").alias("arrived_at"))
    done = spark.createDataFrame([("b3",), ("b3",), ("a1",)], "file_hash string")
    jobs.dedupe(sent(stream), done, f"{folder}/out", f"{folder}/progress")
    want = sent(rows).filter("file_hash NOT IN ('b3', 'a1')").groupBy("file_hash").agg(F.min(F.struct("arrived_at", "id")).alias("f")).select("file_hash", "f.*")
    assert sorted(map(tuple, jobs.first_arrivals(spark, f"{folder}/out").collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_that_runs_again_changes_nothing(spark, landed):
    rows, stream, folder = landed
    batch = rows.select(F.col("id").alias("event_id"), F.lit("k").alias("cache_key"), F.col("at").alias("asked_at"))
    for _ in range(2):
        jobs.note_late(batch, 0, f"{folder}/out", "asked_at", "1 hour")
    assert [tuple(r) for r in jobs.late_counts(spark, f"{folder}/out").collect()] == [(0, len(ROWS) + 4, 0)]


def test_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.range(20).withColumn("text", F.lit("a"))
    rows.repartition(3).write.parquet(f"{tmp_path}/many/t.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "t.parquet")
    for kind in ("one", "many"):
        stream = jobs.table_stream(spark, f"{tmp_path}/{kind}", "t", rows.schema)
        jobs.run_available(stream, jobs.batch_writer(f"{tmp_path}/{kind}-out"), f"{tmp_path}/{kind}-progress")
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{kind}-out").collect()) == list(range(20))
