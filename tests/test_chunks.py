import random

from pyspark.sql import functions as F

from pagelore.operators import chunks as ch
from pagelore.session import spread


def plain_chunks(sentences, size, overlap):
    """Straight loop over the packing rule, as a check."""
    out, held = [], []
    for s in sentences:
        if held and sum(map(len, held)) + len(s) > size:
            out.append(" ".join(held))
            tail = []
            for t in reversed(held):
                if sum(map(len, tail)) + len(t) > overlap:
                    break
                tail.insert(0, t)
            held = tail
        held.append(s)
    return out + ([" ".join(held)] if held else [])


def test_bounds_equal_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        sentences = ["s" * rng.choice([1, 5, 20, 60, 63, 64, 65, 200, 511, 512, 600]) for _ in range(rng.randrange(1, 30))]
        for size, overlap in ((512, 64), (200, 50), (10, 0), (100, 100)):
            got = [" ".join(sentences[b["first"] - 1:b["last"]]) for b in ch._bounds([len(s) for s in sentences], size, overlap)]
            assert got == plain_chunks(sentences, size, overlap)


def test_numbers_run_through_a_document_longer_than_a_segment(spark):
    n = ch.SEGMENT_PAGES * 2 + 40
    rows = [(1, p, f"Page text number {p} stands here. Another sentence of it follows.", ["text"]) for p in range(1, n + 1)]
    rows += [(2, 1, "Only one page here.", []), (2, 2, "   ", ["ocr"])]
    df = spark.createDataFrame(rows, "document_id long, page_number long, merged_text string, source_types array<string>")
    got = ch.chunk_documents(df).collect()
    first = sorted((r.chunk_index, r.page_number) for r in got if r.document_id == 1)
    assert first == [(i, i + 1) for i in range(n)]
    second = [r for r in got if r.document_id == 2]
    assert [(r.chunk_id, r.source_type, r.content) for r in second] == [("doc2_c0", "text", "Only one page here.")]


def test_pipes_become_letters_in_table_text(spark):
    df = spark.createDataFrame([(1, 1, "| alpha | beta |")], "document_id long, page_number long, table_text string")
    assert ch.chunk_tables(df).first().content == "| alpha | beta |"
    assert ch.chunk_pages(df, "table_text").first().content == "I alpha I beta I"


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text {i}" * 50) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "t"))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() > 8 and scan.select(F.spark_partition_id()).distinct().count() == 1
        sizes = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert sum(sizes) == 2000 and len(sizes) > 8 and max(sizes) < 500


def test_documents_of_one_segment_stay_at_the_scan(spark):
    pages = spark.createDataFrame([(1, 1, "A sentence that is long enough to stay.", ["text"])], "document_id long, page_number long, merged_text string, source_types array<string>")
    plan = ch.chunk_documents(pages)._jdf.queryExecution().executedPlan().toString()
    assert "_bits" in plan.split("LeftSemi")[1]
