import random

from pagelore.operators import activity as ac
from pagelore.operators import retrieval as rt
from pagelore.operators.substring import matches


def like(text, needle):
    import re
    out, i = "", 0
    while i < len(needle):
        c = needle[i]
        out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.search(out, text, re.S) is not None


def test_matches_equal_all_pairs(spark):
    rng = random.Random(6)
    letters = "aabbcÉ %_."
    texts = [(o, i, None if i % 40 == 0 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(160) for o in [rng.randrange(3)]]
    asked = [(o, "".join(rng.choice("aabcé") for _ in range(rng.randint(0, 6)))) for o in range(4) for _ in range(25)] + [(0, None), (0, "zzz"), (1, "a.b"), (1, "."), (0, "AAB")] * 2
    q = spark.createDataFrame(asked, "owner_id long, needle string")
    t = spark.createDataFrame(texts, "owner_id long, chunk_id long, text string")
    want = {(o, n.lower(), i) for o, n in asked if n is not None for p, i, text in texts if p == o and text is not None and n.lower() in text.lower()}
    got = [tuple(r) for r in matches(q, t, "owner_id", "chunk_id").select("owner_id", "needle", "chunk_id").collect()]
    assert set(got) == want and len(got) == len(want)
    wild = [(o, n) for o in range(3) for n in ("a%b", "_a_", "%", "aab%c", "é_a", "b.%aab", "__", "bcé")]
    got = {tuple(r) for r in matches(spark.createDataFrame(wild, "owner_id long, needle string"), t, "owner_id", "chunk_id", True).select("owner_id", "needle", "chunk_id").collect()}
    assert got == {(o, n, i) for o, n in wild for p, i, text in texts if p == o and text is not None and like(text.lower(), n)}


def test_only_hits_meet_the_requests(spark):
    chunks = spark.createDataFrame([(f"c{i}", i % 4, 1, i, f"text {i} " + ("needle in Hay" if i in (3, 6, 7) else "straw")) for i in range(40)],
                                   "chunk_id string, document_id long, page_number long, chunk_index long, content string")
    documents = spark.createDataFrame([(d, d % 2, f"d{d}") for d in range(4)], "id long, owner_id long, original_name string")
    asked = spark.createDataFrame([(1, 1, "NEEDLE"), (2, 0, "needle"), (3, 1, "hay"), (4, 1, "needle"), (5, 9, "text"), (6, 0, "t"), (7, 0, None)],
                                  "request_id long, owner_id long, needle string")
    got = {}
    for r in rt.search_content(asked, chunks, documents, 2).collect():
        got.setdefault(r.request_id, []).append((r.position, r.chunk_id))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, "c3"), (2, "c7")], 2: [(1, "c6")], 3: [(1, "c3"), (2, "c7")], 4: [(1, "c3"), (2, "c7")], 6: [(1, "c0"), (2, "c4")]}
    assert rt.search_content(asked, chunks, documents, None).count() == 7 + 20


def test_history_of_the_user_only(spark):
    sessions = spark.createDataFrame([(1, 7, "Cats"), (2, 7, None), (3, 8, "cats")], "id long, user_id long, title string")
    marks = spark.createDataFrame([(1, 7, "cat?", "a CAT."), (2, 8, "x", None)], "id long, user_id long, query string, answer string")
    asked = spark.createDataFrame([(1, 7, "Cat"), (2, 7, "session 2"), (3, 8, "cat"), (4, 9, "cat")], "request_id long, user_id long, needle string")
    got = sorted(tuple(r) for r in ac.search_history(asked, sessions, marks).collect())
    assert got == [(1, "bookmark", 1), (1, "session", 1), (2, "session", 2), (3, "session", 3)]
