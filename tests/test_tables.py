import random

from pyspark.sql import functions as F

from pagelore.operators import activity as ac
from pagelore.operators import analytics as al
from pagelore.operators import cache as ca
from pagelore.operators import maintenance as mt
from pagelore.operators import quality as qu
from pagelore.operators.components import components
from pagelore.operators.running import number_rows


def test_registrations_follow_request_order(spark):
    rng = random.Random(2)
    rows = [(i, f"n{rng.randrange(12)}", f"m{rng.randrange(12)}", "student") for i in range(60)]
    names, mails, want = {"n0"}, {"m1"}, []
    for i, n, m, _ in rows:
        if n not in names and m not in mails:
            names.add(n), mails.add(m), want.append(i)
    asked = spark.createDataFrame(rows, "request_id long, username string, email string, role string")
    stored = spark.createDataFrame([("n0", "m1")], "username string, email string")
    assert sorted(r.request_id for r in mt.register_users(asked, stored).collect()) == want


def jobs_of(spark, run):
    """How many jobs ``run`` starts."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_chain_of_registrations(spark):
    none = spark.createDataFrame([], "username string, email string")

    def chain(n):
        rows = [(i, f"n{(i + 1) // 2}", f"m{i // 2}", "student") for i in range(n)]
        return spark.createDataFrame(rows, "request_id long, username string, email string, role string")

    found = {}
    short = jobs_of(spark, lambda: found.update(a=mt.register_users(chain(20), none).collect()))
    long = jobs_of(spark, lambda: found.update(b=mt.register_users(chain(1000), none).collect()))
    for key, n in (("a", 20), ("b", 1000)):
        assert sorted(r.request_id for r in found[key]) == list(range(0, n, 2))
    assert long <= 6 * short


def test_components_of_paths_and_cycles(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(300)] + [(f"c{i}", f"c{(i + 1) % 50}") for i in range(50)] + [("x", "x")]
    got = components(spark.createDataFrame(edges, "a string, b string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(len(g) for g in groups.values()) == [1, 50, 301] and len(got) == 352


def test_relationships_equal_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    sets = {i: sorted(rng.sample(vocabulary, rng.randrange(1, 12))) for i in range(40)}
    docs = spark.createDataFrame([(i, i % 2, f"d{i}", "processed") for i in sets], "id long, owner_id long, original_name string, status string")
    kws = spark.createDataFrame(list(sets.items()), "document_id long, keywords array<string>")
    want = set()
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and a % 2 == b % 2 and min(len(x), len(y)) >= 3 and len(x & y) >= 2:
                sim = max(len(x & y) / len(x | y), 0.7 * len(x & y) / min(len(x), len(y)))
                if sim > 0.03:
                    want.add((a, b, len(x & y), ",".join(sorted(x & y, key=lambda w: (-len(w), w))[:8])))
    edges = al.doc_relationships(docs, kws)
    assert {(r.source, r.target, r.shared_count, r.shared_topics) for r in edges.collect()} == want
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_copies_are_linked_like_all_others(spark, monkeypatch):
    monkeypatch.setattr(al, "DOCS_PER_BLOCK", 7)
    sets = {1: ["a", "b", "c", "d"], 2: ["a", "b", "x", "y"], 3: ["q", "r", "s"]}
    # the last owner's words meet less often than its documents do, so its pairs pass the prefix filter
    rows = [(100 * i + j, 0, sets[1 + j % 3]) for i in range(20) for j in range(3)] + [(5000, 1, sets[1]), (5001, 1, sets[1])]
    rows += [(7000 + i, 2, [f"{i}{w}" for w in "abc"]) for i in range(9)] + [(7100 + i, 2, [f"{i}{w}" for w in "abc"]) for i in range(2)]
    docs = spark.createDataFrame([(i, o, f"d{i}", "processed") for i, o, _ in rows], "id long, owner_id long, original_name string, status string")
    edges = al.doc_relationships(docs, spark.createDataFrame([(i, w) for i, _, w in rows], "document_id long, keywords array<string>")).collect()
    want = {(a, b): ",".join(sorted(set(x) & set(y))) for a, o, x in rows for b, q, y in rows if o == q and a < b and len(set(x) & set(y)) >= 2}
    assert {(r.source, r.target): r.shared_topics for r in edges} == want and len(edges) == len(want) == 3 * 190 + 400 - 20 + 20 + 1 + 2
    assert {r.similarity for r in edges if r.target - r.source == 100} == {1.0}


def test_common_words_bring_nobody_together(spark):
    sets = {i: [*[f"common{j:03d}" for j in range(4)], *[f"own{i}x{j:03d}" for j in range(100)]] for i in range(30)}
    sets[50] = [f"own7x{j:03d}" for j in range(90)]
    rows = [(i, 0, len(ws), [{"df": 30 if w.startswith("common") else 2, "word": w} for w in sorted(ws, key=lambda w: (w.startswith("common"), w))]) for i, ws in sets.items()]
    ranked = spark.createDataFrame(rows, "document_id long, owner_id long, n int, ordered array<struct<df:int,word:string>>")
    assert [(r.source, r.target) for r in al.alike_candidates(ranked).collect()] == [(7, 50)]


def test_cache_hits_for_ordinary_and_hot_keys(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(0, 9 * 86400)) for i in range(1500)]
    want, last = {}, {}
    for e, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        want[e] = k in last and s - last[k] <= 3600
        if not want[e]:
            last[k] = s
    df = spark.createDataFrame(rows, "event_id long, cache_key string, s long").select("event_id", "cache_key", F.timestamp_seconds("s").alias("ts"))
    for segment_ttls in (1, 5, 1000):
        assert {r.event_id: r.is_hit for r in ca.cache_hits_ttl(df, 3600, segment_ttls).collect()} == want


def test_feedback_mean_counts_unrated_rows(spark):
    df = spark.createDataFrame([(5, True), (None, False), (1, True), (4, None)], "rating int, helpful boolean")
    r = ac.feedback_stats(df).first()
    assert (r.total, r.average_rating, r.helpful_pct, r.rating_1, r.rating_5, r.rating_3) == (4, 2.5, 50.0, 1, 1, 0)
    empty = ac.feedback_stats(df.limit(0)).first()
    assert (empty.total, empty.average_rating, empty.helpful_pct) == (0, 0.0, 0.0)


def test_bleu_and_rouge_by_hand(spark):
    rows = [(1, "the cat sat", "the cat sat"), (2, "dog", "cat"), (3, "", "cat"), (4, "the the cat", "the cat")]
    df = spark.createDataFrame(rows, "answer_id int, answer string, reference string")
    bleu = {r.answer_id: r.bleu for r in qu.bleu2(df).collect()}
    assert bleu[1] == 1.0 and bleu[2] == 0.0 and bleu[3] == 0.0
    assert abs(bleu[4] - round((2 / 3 * 1 / 2) ** 0.5, 4)) < 1e-9
    lcs = {r.answer_id: r.rougeL for r in qu.rouge_l(df).collect()}
    assert lcs == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.8}


def test_numbering_over_ranges(spark):
    df = spark.range(0, 2500, 7).withColumnRenamed("id", "k")
    got = number_rows(df, "k", "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))


def test_numbering_of_sparse_and_null_ids(spark):
    ids = [None, None, *(i * (1 << 62) // 500 for i in range(500)), -5]
    got = number_rows(spark.createDataFrame([(i,) for i in ids], "k long"), "k", "n").orderBy(F.asc_nulls_first("k")).collect()
    assert [r.n for r in got] == list(range(1, len(ids) + 1))
    assert number_rows(spark.createDataFrame([], "k long"), "k", "n").count() == 0
    plan = number_rows(spark.range(9), "id", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_export_markdown(spark):
    rows = [(1, 1, "user", "Hi", None, 1), (1, 2, "assistant", "Hello", 0.5, 2)]
    df = spark.createDataFrame(rows, "session_id long, id long, role string, content string, confidence double, created_at long")
    got = mt.export_messages(df, "md", "2024-01-01 00:00", "Helper").first().content
    assert got == ("# Helper Chat Export\n_Exported: 2024-01-01 00:00_\n\n---\n\n**You:** Hi\n\n**Helper:** Hello\n\n> Confidence: 50%\n\n---\n\n")
