from pyspark.sql import functions as F

from pagelore.operators import pages as pg
from pagelore.sources import files
from pagelore.streaming import jobs

CHUNKS = "chunk_id string, document_id long, content string"


def rows(df):
    return sorted(tuple(r) for r in df.select("chunk_id", "document_id", "content").collect())


def test_a_batch_leaves_other_documents_alone(spark, tmp_path):
    folder = str(tmp_path / "chunks")
    first = spark.createDataFrame([(f"{d}-{i}", d, "old") for d in range(100) for i in range(2)], CHUNKS)
    files.write_chunks(first, folder, 0)
    again = spark.createDataFrame([("7-0", 7, "new")], CHUNKS)
    for _ in range(2):  # a repeated batch replaces itself
        files.write_chunks(again, folder, 1)
    got = rows(files.read_chunks(spark, folder))
    assert got == sorted([(f"{d}-{i}", d, "old") for d in range(100) if d != 7 for i in range(2)] + [("7-0", 7, "new")])


def test_a_document_without_rows_is_emptied(spark, tmp_path):
    folder = str(tmp_path / "chunks")
    files.write_chunks(spark.createDataFrame([("1-0", 1, "a"), ("2-0", 2, "b")], CHUNKS), folder, 0)
    files.write_chunks(spark.createDataFrame([], CHUNKS), folder, 1, spark.createDataFrame([(2,)], "document_id long"))
    assert rows(files.read_chunks(spark, folder)) == [("1-0", 1, "a")]
    files.compact(spark, folder, str(tmp_path / "compact"))
    assert rows(files.read_chunks(spark, str(tmp_path / "compact"))) == [("1-0", 1, "a")]


def test_tombstones_hide_until_a_store_is_compacted(spark, tmp_path):
    folder = str(tmp_path / "chunks")
    files.write_chunks(spark.createDataFrame([(f"{d}-{i}", d, "a") for d in range(6) for i in range(2)], CHUNKS), folder, 0)
    files.delete_documents(spark, folder, 1, spark.createDataFrame([(2,), (2,), (5,), (99,)], "document_id long"))
    left = sorted((f"{d}-{i}", d, "a") for d in (0, 1, 3, 4) for i in range(2))
    assert rows(files.read_chunks(spark, folder)) == left
    files.write_chunks(spark.createDataFrame([("5-0", 5, "back")], CHUNKS), folder, 2)
    assert rows(files.read_chunks(spark, folder)) == [*left, ("5-0", 5, "back")]
    files.compact(spark, folder, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 9


def test_a_long_document_is_several_objects(spark, tmp_path):
    merged = spark.createDataFrame([(d, n, f"page {n} " + "x" * 40, ["text"]) for d, pages in ((1, 2500), (2, 1)) for n in range(1, pages + 1)],
                                   "document_id long, page_number long, merged_text string, source_types array<string>")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "id long, original_name string")
    files.write_processed(merged, names, str(tmp_path), "now", part_chars=10_000)
    objects = spark.read.json(str(tmp_path))
    most = objects.select("document_id", "page_count", F.size("pages").alias("n")).collect()
    assert {(r.document_id, r.page_count) for r in most} == {(1, 2500), (2, 1)}
    assert len(most) > 10 and max(r.n for r in most) < 300
    back = files.read_processed(spark, str(tmp_path)).select("document_id", "page_number", "merged_text", "source_types")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, merged.collect()))
    parts = pg.full_text(merged, 10_000).orderBy("document_id", "part").collect()
    whole = "\n\n".join(f"[Page {n}]\npage {n} " + "x" * 40 for n in range(1, 2501))
    assert "\n\n".join(r.full_text for r in parts if r.document_id == 1) == whole and max(len(r.full_text) for r in parts) < 11_000


def test_newest_batch_is_the_whole_result(spark, tmp_path):
    write = jobs.batch_writer(str(tmp_path))
    for batch_id in (0, 1):
        write(spark.createDataFrame([(batch_id,)], "n int"), batch_id)
    assert [r.n for r in jobs.newest_batch(spark, str(tmp_path)).collect()] == [1]


def test_full_text_reads_its_pages_once_and_keeps_long_documents_whole(spark, monkeypatch):
    monkeypatch.setattr(pg, "SEGMENT_PAGES", 4)
    # document 1 and 3 are longer than a segment, 2 is not; a blank page is left out; one row has no document
    rows = [(d, p, " " if p == 2 else f"{d} page {p} " + "x" * (p % 5)) for d, n in ((1, 11), (2, 4), (3, 5)) for p in range(1, n + 1)] + [(None, 1, "nobody's")]
    merged = spark.createDataFrame(rows, "document_id long, page_number long, merged_text string")
    got = pg.full_text(merged, 40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "merged_text" not in plan  # the pages come from the checkpoint folder
    want = {}
    for d in (1, 2, 3, None):
        spent = 0
        for _, p, t in sorted(r for r in rows if r[0] == d):
            if t.strip():
                block = f"[Page {p}]\n{t}"
                want.setdefault((d, spent // 40), []).append(block)
                spent += len(block)
    assert {(r.document_id, r.part): r.full_text for r in got.collect()} == {k: "\n\n".join(v) for k, v in want.items()}
