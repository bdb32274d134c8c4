from __future__ import annotations

import math
import random

import numpy as np

from pagelore.llm import perplexity

CYRILLIC, GREEK = "абвгдежзиклмнопрсту", "αβγδεζηθικλμνξοπρστ"


def written(rng, letters, words, n=120):
    return " ".join("".join(letters[ord(c) % len(letters)] for c in rng.choice(words)) for _ in range(n))


def test_another_script_is_not_taken_for_the_language(spark):
    """The same words in other letters: the model tells them apart, and one that never saw them rejects them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [written(rng, CYRILLIC, words) for _ in range(80)]
    texts.append(texts[0].translate(str.maketrans(CYRILLIC, GREEK)))
    df = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in perplexity.judge(df).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert abs(rows[80].log_ppl - rows[0].log_ppl) > 0.01
    known = perplexity.train(df.filter("doc_id < 80"), perplexity.BYTES)
    rows = {r.doc_id: r for r in perplexity.judge(df, known).collect()}
    assert not rows[80].kept and rows[80].log_ppl > rows[80].high
    assert sum(r.kept for r in rows.values()) > 70


def test_four_grams_of_bytes_are_exact():
    text = "aé漢\U0001f600"
    data = b"\xff" * 3 + text.encode()
    assert perplexity.byte_grams(text).tolist() == [int.from_bytes(data[i : i + 4], "big") for i in range(len(data) - 3)]


def test_sum_over_distinct_grams_is_the_sum_over_all(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé漢 .") for _ in range(200)) for _ in range(20)]
    model = perplexity.train(spark.createDataFrame([(t,) for t in texts], "text string"), perplexity.BYTES)
    for text in [texts[0], "漢漢漢zé", "Ж", "a" * 50]:
        grams = perplexity.byte_grams(text)
        assert math.isclose(model.log_likelihood(grams), float(model.log_probability(grams).sum()), rel_tol=1e-5)
    after = perplexity.byte_grams("abé")[-1] << np.uint32(8)
    assert abs(np.exp(model.log_probability(np.array([after | np.uint32(b) for b in range(256)]))).sum() - 1) < 1e-3
