from __future__ import annotations

import random

import corpus_pipeline

from pagelore.llm import mixing, order_minhash, packing, toxicity

from . import samples


def tables(spark, folder):
    rng = random.Random(13)
    data, labels = [], []
    for i in range(200):
        text = "\n".join(samples.sentence(rng, 25) for _ in range(3))
        if i % 5 == 0:
            text += "\nyou are an idiot"
        data.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    shared = samples.sentence(rng, 60)
    data += [(500 + i, f"{shared}\n{samples.sentence(rng, 30)}", "en", "s1", 9) for i in range(6)]
    near = samples.sentence(rng, 150).split()
    for i in range(3):
        words = near.copy()
        words[10 * i] = f"edit{i}"
        data.append((600 + i, " ".join(words), "en", "s2", 9))
    data += [(700, None, None, None, None), (701, "", "en", "s0", 0), (702, data[1][1], "en", "s0", 9)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in data}


def test_stages_take_effect(spark, tmp_path):
    before = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = out.collect()
        if name == "toxicity":
            assert {r.doc_id for r in rows} == {i for i in before if not (i < 200 and i % 5 == 0)}
        elif name == "line dedup":
            texts = {r.doc_id: r.text for r in rows}
            first_line = before[500].split("\n")[0]
            assert texts[500] == before[500] and all(first_line not in texts[500 + i] for i in range(1, 6))
            assert 702 not in texts and texts[1] == before[1] and texts[700] is None
        elif name == "near-dedup":
            assert {i for i in (r.doc_id for r in rows) if 600 <= i < 700} <= {600}
            want = order_minhash.near_duplicates(docs).select("class_id").distinct().count()
            assert len(rows) == want
        elif name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            got: dict = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == {i: n for i, n in want.items() if n}
        else:
            cache = packing.WordCache(packing.vocabulary_path())
            assert sum(r.length for r in rows) == sum(len(cache.ids(r.text)) // 2 + 1 for r in docs.collect())
        docs = out
    assert toxicity.__name__


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
