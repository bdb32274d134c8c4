from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators import study as st


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_material_is_cleaned_once_a_step(spark):
    chunks = spark.createDataFrame([(1, 0, "Some words of a chunk.")], "document_id long, chunk_index long, content string")
    texts = chunks.select("document_id", F.col("content").alias("text"))
    assert plan(st.faq_noise_clean(texts)).count(r"\[/?TABLE\]") == 1
    candidates = plan(st.faq_candidates(chunks))
    assert candidates.count(r"\[/?TABLE\]") == 2  # the text, then the generator's own cleaning
    assert candidates.count(tx._SPACED_LETTER_GAP) == 1


def test_capitals_take_runs_of_other_characters_at_once(spark):
    rng = random.Random(5)
    texts = ["", "ABC", "abC", "ÀÉß 12", None] + ["".join(rng.choice("abYZ É1.\n") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    column = tx.mostly_capitals(F.col("t"))
    assert plan(df.select(column.alias("x"))).count("[^a-zA-Z]+") == 1
    for r in df.select("t", column.alias("x")).collect():
        letters = re.findall("[a-zA-Z]", r.t or "")
        assert r.x == (len([x for x in letters if x < "a"]) > 0.7 * len(letters)), r.t


def test_words_part_at_every_white_space(spark):
    white = list(fv.WS_CHARS)
    text = "".join(f"w{i}é\U0001f600\x7f​{c}" for i, c in enumerate(white))
    row = spark.createDataFrame([(text,)], "t string").select(tx.words(F.col("t")).alias("w")).first()
    assert row.w == [f"w{i}é\U0001f600\x7f​" for i in range(len(white))]


def test_card_material_reads_a_chunk_once(spark):
    good, bad = "Some readable words of chunk number", "1 2 3 4 5 6 7"
    rows = [(d, i, f"{good} {d} {i} and nothing else." if (i + d) % 3 else bad) for d, n in ((1, 5), (2, 40), (3, 3000)) for i in range(n)]
    rows += [(4, i, bad) for i in range(30)] + [(None, 0, good)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index long, content string")
    material = st.flashcard_material(chunks)
    assert plan(material).count(tx._SPACED_LETTER_GAP) == 3  # all chunks, and documents of several segments for their two sums
    got = {r.document_id: r.material for r in material.collect()}
    want = {}
    for d in (1, 2, 3, 4):
        kept = [t for x, _, t in rows if x == d and t != bad] or [""] * 30  # lines of single letters are dropped
        text = " ".join(kept[::max(1, len(kept) // 12)])[:8000].strip()
        if len(text) >= 50:
            want[d] = text
    assert got == want


def odd_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    pieces = [*"abAB. !?|`-_/\n\t\r0129()[é", " ", " ", ". ", "  ", "\u00a0", "\u2028", "\x85", "\r\n", "Mr.", "etc.", "Fig.", "a b c", "A B", "12/34", "AB 123", "[TABLE]", "(1-2-3)",
              " unlike ", "Types of", "for example", "step", "E.g.x", "used in", "BECAUSE ", "Slow"]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(n)]


def test_fast_patterns_do_what_the_fixed_ones_say(spark):
    texts = spark.createDataFrame([(t,) for t in odd_texts(5, 3000)], "t string")
    c = F.col("t")
    lone = f"(?<!{fv.W})[A-Za-z]"
    gap = f"(?<={lone} [A-Za-z]) (?=[A-Za-z](?!{fv.W}))|(?<={lone}) (?=[A-Za-z] [A-Za-z](?!{fv.W}))"
    noise = c
    for pattern in fv.MATERIAL_NOISE:
        noise = F.regexp_replace(noise, pattern.replace(r"\b", r"(?U:\b)").replace("(?m)^", r"(?<![^\n])"), " ")
    clean = F.regexp_replace(F.translate(F.regexp_replace(c, fv.CONTROL_CHARS, ""), "|`", "I'"), "[ \t]+", " ")
    clean = tx.strip(F.array_join(F.transform(F.split(F.regexp_replace(clean, "\n{3,}", "\n\n"), "\n"), tx.strip), "\n"))
    pairs = [(tx.strip_material_noise(c), noise), (F.regexp_replace(c, tx._SPACED_LETTER_GAP, ""), F.regexp_replace(c, gap, "")), (tx.clean_text(c), clean),
             (F.array_join(tx.loose_sentences(c), "~"), F.array_join(F.transform(F.split(c, f"(?<=[.!?]){fv.S}+"), tx.strip), "~")),
             (F.regexp_replace(c, rf"\.(?<={fv.ABBREVIATION_DOT})", "<DOT>"), F.regexp_replace(c, fv.ABBREVIATION_DOT, "$1<DOT>")),
             (F.array_join(F.split(c, f"{tx._AFTER_MARK}(?=[A-Z])"), "~"), F.array_join(F.split(c, f"(?<=[.!?]){fv.S}+(?=[A-Z])"), "~"))]
    assert texts.select(*[F.count_if(~a.eqNullSafe(b)) for a, b in pairs]).first() == tuple([0] * len(pairs))


def test_gates_are_looked_for_by_their_beginnings(spark):
    texts = spark.createDataFrame([(t,) for t in odd_texts(6, 3000)], "t string")
    gates = [r[1] for r in (*fv.FAQ_RULES, *fv.CARD_RULES) if r[1]]
    assert sum(st._stems(g) is not None for g in gates) >= 13
    shown = [st._shown(F.col("t"), F.lower("t"), g) for g in gates]
    wrong = texts.select(*[F.count_if(x != F.col("t").rlike(g)) for x, g in zip(shown, gates, strict=True)], F.count_if(shown[1])).first()
    assert wrong[:-1] == tuple([0] * len(gates)) and wrong[-1] > 100


def test_first_of_repeated_keys_is_found_without_searching_for_each(spark):
    rng = random.Random(8)
    items = [f"{rng.choice('abcdefgh')}{i}" for i in range(400)]
    rows = spark.createDataFrame([(items,), (["a1", "b1"],), ([],), (None,), (["a1", None, "a2"],)], "x array<string>")
    got = rows.select(st.first_by_key(F.col("x"), lambda v: F.substring(v, 1, 1)).alias("y"))
    assert [r.y for r in got.collect()] == [list({v[0]: v for v in reversed(items)}[k] for k in dict.fromkeys(v[0] for v in items)), ["a1", "b1"], [], None, ["a1"]]
    assert "array_position" not in plan(got)


def test_sentences_are_read_once_for_all_questions(spark):
    text = " ".join(f"The part {i} of this long text is a thing that has many uses in step {i}." for i in range(30))
    material = spark.createDataFrame([(1, text.split(". "), text)], "document_id long, sentences array<string>, cleaned string")
    contexts = st.faq_context(st.faq_topics(material)).select("topic", "context")
    shown = plan(contexts)
    assert shown.count("AS read#") == 1 and shown.index("Generate") < shown.index("AS read#") and contexts.count() > 1
