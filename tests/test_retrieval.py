import math
import random

import pandas as pd
from pyspark.sql import functions as F

from pagelore.operators import blocks as bl
from pagelore.operators import bm25 as bm
from pagelore.operators import retrieval as rt
from pagelore.operators import vectors as vc


def plain_bm25(query, docs):
    toks = [d.lower().split() for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for t in toks:
        out.append(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.lower().split()))
    return out


DOCS = ["the cat sat on the mat", "dogs and cats are friends", "the the the quick fox", "a red fox and a cat", "nothing at all"]


def test_bm25_matches_the_formula(spark):
    query = "the cat the fox"
    docs = spark.createDataFrame([(0, i, d) for i, d in enumerate(DOCS)], "corpus_id int, chunk_id int, content string")
    asked = spark.createDataFrame([(7, 0, query)], "query_id int, corpus_id int, query string")
    got = {r.chunk_id: r.bm25_score for r in rt.bm25_scores(asked, docs).collect()}
    for i, want in enumerate(plain_bm25(query, DOCS)):
        assert abs(got.get(i, 0.0) - want) < 1e-6


def test_candidate_bm25_keeps_rows_without_shared_terms(spark):
    query = "cat fox"
    rows = [(1, i, d, float(i), i + 1) for i, d in enumerate(DOCS)]
    found = spark.createDataFrame(rows, "query_id int, chunk_id int, content string, vector_score double, vector_rank int")
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    scored = rt.candidate_bm25(found, asked)
    got = {r.chunk_id: r.bm25_score for r in scored.collect()}
    scaled = {r.chunk_id: r.n for r in rt.normalize_scores(scored, "bm25_score", "n").collect()}
    assert min(scaled.values()) == 0.0 and max(scaled.values()) == 1.0
    assert len(got) == len(DOCS)
    for i, want in enumerate(plain_bm25(query, DOCS)):
        assert abs(got[i] - want) < 1e-6


def test_index_topk_against_every_text(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["the the", "", "rare w1", "w39 " * 50]
    texts += [texts[5]] * 40  # ties across blocks
    docs = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, content string").repartition(7)
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for q in range(30)] + [(90, "rare"), (91, "unknown"), (92, ""), (93, texts[5])]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    for size, k in ((16, 7), (4096, 3), (16, 1)):
        folder = f"{tmp_path}/{size}-{k}"
        bm.write_index(docs, folder, block_texts=size)
        got = sorted(tuple(r) for r in bm.index_topk(queries, folder, k).collect())
        want = []
        for q, text in asked:
            shared = [set(text.split()) & set(t.split()) for t in texts]
            ranked = sorted((-round(s, 6), f"c{i:03d}") for i, s in enumerate(plain_bm25(text, texts)) if shared[i])[:k]
            want += [(q, c, -s, n + 1) for n, (s, c) in enumerate(ranked)]
        assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(want)]
        assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want)))


def test_index_leaves_blocks_out(spark, tmp_path):
    texts = ["gold gold gold" if i in (5, 6, 7) else f"filler{i} {'gold ' if i % 20 == 0 else ''}" + "pad " * (20 + i % 11) for i in range(600)]
    bm.write_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"), str(tmp_path), block_texts=20)
    postings = spark.read.parquet(f"{tmp_path}/postings")
    assert postings.select("term", "block").distinct().count() == postings.count()
    found = bm.bounds(bm.weights(spark, spark.createDataFrame([(1, "gold pad")], "query_id long, query string"), str(tmp_path)), postings)
    scored = bm.score(found.orderBy(F.desc("bound")).limit(2), postings, 2)
    assert bm.still_open(found, scored, 2).count() < found.count()


def test_vector_topk_over_blocks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) + 0.01 * (i % 5) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.0] * 6) for i in range(3)] + [(2000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, i * 1e-4]) for i in range(60)]
    v = spark.createDataFrame([*rows, (5000, None)], "chunk_id long, embedding array<float>").repartition(5)
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding").filter("query_id < 30 OR query_id >= 1000")
    vc.write_blocks(v, str(tmp_path), block_vectors=16)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path)).groupBy("block").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 16
    exact = {r[0]: [float(x) for x in r[1]] for r in v.collect() if r[1]}
    norm = {i: math.sqrt(sum(x * x for x in e)) for i, e in exact.items()}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(exact[a], exact[b])) / (norm[a] * norm[b]), 6) if norm[a] and norm[b] else 0.0

    for k, first in ((7, 2), (1, 1), (90, 2)):
        got = sorted(map(tuple, vc.blocks_topk(q, str(tmp_path), k, True, first).collect()))
        want = []
        for qid in [r.query_id for r in q.filter("embedding IS NOT NULL").collect()]:
            ranked = sorted((-cos(qid, cid), cid) for cid in exact if cid != qid)[:k]
            want += [(qid, cid, -s, n + 1) for n, (s, cid) in enumerate(ranked)]
        want.sort()
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
        assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))
    assert vc.vector_topk(q.limit(0), v, 3).count() == 0 and vc.vector_topk(q, v.limit(0), 3).count() == 0


def test_close_vectors_leave_blocks_out(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c * 100 + i, [(1.0 if j == c else 0.0) + rng.random() * 0.01 for j in range(12)]) for c in range(12) for i in range(40)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    vc.write_blocks(v, str(tmp_path), block_vectors=20)
    asked = v.filter("chunk_id = 305").select(F.col("chunk_id").alias("query_id"), "embedding", F.lit(0.99).alias("floor"), F.array().cast("array<bigint>").alias("seen"))
    n = spark.read.parquet(str(tmp_path)).filter("radius IS NOT NULL").count()
    assert 0 < vc._bounds(asked, str(tmp_path), 2).count() < n / 2


def test_one_document_cells(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", 7 if i < 300 else i % 9, [rng.random() for _ in range(4)]) for i in range(400)]
    v = spark.createDataFrame(rows, "chunk_id string, document_id long, embedding array<float>")
    asked = spark.createDataFrame([(f"c{i}", d, rows[i][2]) for i, d in ((0, 7), (1, 7), (2, 3), (3, 99), (301, 4))], "query_id string, document_id long, embedding array<float>")
    whole = sorted(map(tuple, vc.vector_topk_prefilter(asked, v, 9, True).collect()))
    assert whole == sorted(map(tuple, vc.vector_topk_prefilter(asked, v, 9, True, block_vectors=10).collect()))
    for qid, d in (("c0", 7), ("c2", 3)):
        e = rows[int(qid[1:])][2]
        cos = lambda x: sum(a * b for a, b in zip(e, x)) / math.sqrt(sum(a * a for a in e) * sum(b * b for b in x))
        ranked = sorted((-round(cos(x), 6), c) for c, doc, x in rows if doc == d and c != qid)[:9]
        assert [(c, n + 1) for n, (_, c) in enumerate(ranked)] == sorted(((c, n) for a, c, _, n in whole if a == qid), key=lambda x: x[1])
    plan = vc.vector_topk_prefilter(asked, v, 9)._jdf.queryExecution().optimizedPlan()
    assert most_vectors(plan) == 1


def most_vectors(node):
    """Most vectors in one row of any step of a plan."""
    own = sum(a.dataType().simpleString() in ("array<float>", "array<double>") for a in (node.output().apply(i) for i in range(node.output().size())))
    return max([own, *(most_vectors(node.children().apply(i)) for i in range(node.children().size()))])


def test_prefilter_and_postfilter_differ(spark):
    v = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 20, [0.9, 0.1]), (3, 20, [0.0, 1.0])], "chunk_id long, document_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 20)], "query_id long, embedding array<float>, document_id long")
    before = [r.chunk_id for r in rt.vector_topk_prefilter(q, v, 1).collect()]
    after = [r.chunk_id for r in rt.vector_topk_postfilter(q.drop("document_id"), v, 1, q).collect()]
    assert before == [2] and after == []


def test_questions_without_documents_stay_with_their_owner(spark):
    vectors = spark.createDataFrame(
        [(f"c{d}", d, f"text {d}", [1.0, d / 10]) for d in range(6)], "chunk_id string, document_id long, content string, embedding array<float>")
    documents = spark.createDataFrame(
        [(d, d % 2, "processing" if d == 4 else "processed", f"d{d}") for d in range(6)], "id long, owner_id long, status string, original_name string")
    asked = spark.createDataFrame(
        [(1, "text", [1.0, 0.0], None, 0), (2, "text", [1.0, 0.0], None, 1), (3, "text", [1.0, 0.0], [1, 4], 0), (4, "text", [1.0, 0.0], None, 9)],
        "query_id long, query string, embedding array<float>, document_ids array<long>, owner_id long")
    found = {}
    for r in rt.candidates(asked, vectors, 6, documents).collect():
        found.setdefault(r.query_id, set()).add(r.document_id)
    assert found == {1: {0, 2}, 2: {1, 3, 5}, 3: {1, 4}}

    lit = spark.createDataFrame([(1, "text", [1.0, 0.0], 2, None, 0), (2, "text", [1.0, 0.0], 2, None, 1)],
                                "query_id long, query string, embedding array<float>, document_id long, page_number long, owner_id long")
    pages = vectors.selectExpr("*", "1L AS page_number", "0L AS chunk_index", "'digital' AS source_type")
    assert {r.query_id for r in rt.highlight(lit, pages, documents).collect()} == {1}


def test_every_chunk_that_shares_a_word_is_scored(spark, tmp_path):
    docs = spark.createDataFrame([(f"c{i:03d}", f"alpha w{i} w{i % 7}" if i % 3 else f"beta w{i % 5}") for i in range(120)], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "alpha w3"), (2, "beta beta"), (3, "nothing")], "query_id long, query string")
    bm.write_index(docs, f"{tmp_path}/index", block_texts=16)
    got = {(r.query_id, r.chunk_id): r.bm25_score for r in bm.index_scores(asked, f"{tmp_path}/index").collect()}
    one = lambda df: df.withColumn("corpus_id", F.lit(0))
    want = {(r.query_id, r.chunk_id): r.bm25_score for r in rt.bm25_scores(one(asked), one(docs)).collect()}
    assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    scaled = rt.normalize_scores(spark.createDataFrame([(q, c, s) for (q, c), s in got.items()], "query_id long, chunk_id string, s double"), "s", "n").collect()
    assert len(scaled) == len(got) and {r.query_id: max(x.n for x in scaled if x.query_id == r.query_id) for r in scaled} == {1: 1.0, 2: 1.0}


def test_queries_meet_a_page_in_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(6)]) for i in range(300)], "chunk_id long, embedding array<float>")
    vc.write_blocks(v, str(tmp_path), block_vectors=20)
    q = v.withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, vc.blocks_topk(q, str(tmp_path), 5, True).collect()))
    bounds = sorted(map(tuple, vc._bounds(q, str(tmp_path), 2).select("query_id", "block").collect()))
    assert sorted(map(tuple, vc._bounds(q, str(tmp_path), 2, parts=7).select("query_id", "block").collect())) == bounds
    seen = []
    bounds_of = vc._bounds
    monkeypatch.setattr(vc, "PART_QUERIES", 40)
    monkeypatch.setattr(vc, "_bounds", lambda queries, folder, first, parts=1: seen.append(parts) or bounds_of(queries, folder, first, parts))
    assert sorted(map(tuple, vc.blocks_topk(q, str(tmp_path), 5, True).collect())) == whole and seen == [8, 8]


def test_few_requests_meet_a_block_at_a_time(spark):
    blocks = spark.createDataFrame([(0, 1), (1, 2)], "cell long, member long")
    asked = spark.range(3000).select((F.col("id") % 2).alias("cell"), F.col("id").alias("query_id"))
    got = bl.meet(blocks, asked, len, lambda block, rows: pd.DataFrame({"n": [len(rows)]}), "n long").agg(F.sum("n"), F.max("n")).first()
    assert got[0] == 3000 and got[1] <= bl.REQUESTS


def test_rows_that_nobody_asks_for_stay_where_they_are(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20)) + " gold") for i in range(200)], "chunk_id long, content string")
    folder = str(tmp_path / "index")
    bm.write_index(docs, folder, block_texts=20)
    postings, wanted = spark.read.parquet(f"{folder}/postings"), spark.createDataFrame([("gold",), ("w7x3",)], "term string")
    left = bm.asked_for(postings, wanted, "term")
    assert left.columns == postings.columns and left.filter("term IN ('gold', 'w7x3')").count() == postings.filter("term IN ('gold', 'w7x3')").count()
    assert left.count() < 50 < postings.count()

    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", 2.0), (None, "d", 5.0), (2, "e", 4.0), (2, "e", 4.0)], "query_id long, chunk_id string, s double")
    want = [(None, "d", 1.0), (1, "a", 0.0), (1, "b", 1.0), (1, "c", 0.5), (2, "e", 1.0), (2, "e", 1.0)]
    for most in (4096, 1):
        monkeypatch.setattr(rt, "BROADCAST_ROWS", most)
        got = rt.normalize_scores(scores, "s", "n")
        assert [(r.query_id, r.chunk_id, r.n) for r in got.orderBy("query_id", "chunk_id").collect()] == want
        assert ("strategy=broadcast" in got._jdf.queryExecution().analyzed().toString()) == (most > 1)
