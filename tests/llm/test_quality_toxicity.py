from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from pagelore.llm import perplexity, toxicity

from . import samples


def plain_model(texts):
    """Modified Kneser-Ney by dictionaries, for comparison."""
    n, grams = perplexity.ORDER, Counter()
    for t in texts:
        c = [0] * (n - 1) + [int(perplexity.classes()[ord(x)]) for x in t]
        grams.update(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
    levels = {n: grams}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, totals, kinds = {}, {}, {}
    for k, counts in levels.items():
        m = Counter(counts.values())
        y = m[1] / max(m[1] + 2 * m[2], 1)
        discounts[k] = [0.0] + [min(max(j - (j + 1) * y * m[j + 1] / m[j], 0.0), j) if m[j] and y else 0.5 * j for j in (1, 2, 3)]
        totals[k], kinds[k] = Counter(), defaultdict(Counter)
        for g, c in counts.items():
            totals[k][g[:-1]] += c
            kinds[k][g[:-1]][min(c, 3)] += 1

    def p(g):
        if not g:
            return 1 / 64
        k, h = len(g), g[:-1]
        if not totals[k][h]:
            return p(g[1:])
        d, c = discounts[k], levels[k][g]
        weight = sum(d[j] * kinds[k][h][j] for j in (1, 2, 3)) / totals[k][h]
        return (c - d[min(c, 3)]) / totals[k][h] + weight * p(g[1:])

    return p


def test_model_is_modified_kneser_ney(spark):
    docs = samples.docs(spark)
    texts = [r.text for r in docs.collect() if r.text]
    model, p = perplexity.train(docs), plain_model(texts)
    for text in [texts[0], texts[-1], "zebra quilts", "ÀÉ 99%%"]:
        got = model.log_probability(perplexity.ngrams(text))
        c = [0] * 3 + [int(perplexity.classes()[ord(x)]) for x in text]
        want = [math.log(p(tuple(c[i : i + 4]))) for i in range(len(text))]
        assert np.allclose(got, want, atol=1e-4)
    assert sum(math.exp(x) for x in model.log_probability(np.array([(5 << 12 | 9 << 6 | 3) << 6 | w for w in range(64)], dtype=np.uint32))) - 1 < 1e-3


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_statistics():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "c", " ", "\n", "é", "\x0b", "\x85", " ", "#", "|x ", "a b c "]) for _ in range(rng.randint(0, 60)))
        assert perplexity.base_statistics(text) == plain_statistics(text), repr(text)
    assert perplexity.base_statistics(None) == (0, 0, 0, 0, 0)


def test_bands_reject_odd_texts_only(spark):
    rng = random.Random(4)
    data = [(i, samples.sentence(rng, 120), lang) for i, lang in enumerate(["en", "fr", None] * 20)]
    data += [(900, " ".join("".join(rng.choice("#%&*|QXZ") for _ in range(6)) for _ in range(90)), "en"), (901, "the of and " * 40, "en"), (902, None, "en"), (903, "", None), (0, data[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in data], "doc_id long, text string, lang string, log_ppl int, n_words string, kept boolean")
    rows = perplexity.judge(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(data)
    assert not got[900].base_failed and not got[900].kept
    assert all(got[i].base_failed and not got[i].kept for i in (901, 902, 903))
    assert all(got[i].kept for i in range(60))
    assert perplexity.judge(docs.limit(0)).count() == 0


def labelled_tables(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = samples.sentence(rng, 60).split()
        if toxic:
            words.insert(rng.randint(0, 50), rng.choice(["idiot", "grubbelnase", "grubbelkopf"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (99999, 1), (0, 1)]
    return spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_stems_and_holds_out(spark):
    docs, labels = labelled_tables(spark)
    sample = toxicity.training_rows(docs, labels)
    held = {r.doc_id for r in docs.filter(toxicity.held_out(toxicity.F.col("doc_id"))).collect()}
    texts = {r.text for r in sample.collect()}
    assert held and not any(r.text in texts for r in docs.collect() if r.doc_id in held)
    grammar = toxicity.learn(sample)
    assert any("grubbel".startswith(s) or s.startswith("grubbel") for s in grammar.pure_stems)
    got = {r.doc_id: r.score for r in toxicity.rate(docs, grammar).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)


def test_toxicity_grammar_by_clause():
    g = toxicity.Grammar()
    best = lambda t: next(iter(g.matches(t)), None)
    assert best("Listen, you are an idiot.") == "insult_of_target"
    assert best("What a moron.") == "insult"
    assert best("This is trash") == "insult_of_target"
    assert best("That film was not stupid.") == "negated_insult"
    assert best("The witness said the plan was stupid.") == "reported_insult"
    assert best("I will hurt you") == "threat_to_target"
    assert best("nothing here") is None and best(None) is None and best("") is None
    assert g.matches("You idiot! You loser. Fine day.")["insult_of_target"] == 2
    assert best("ＩＤＩＯＴ") == "insult" and best("kidiot") is None
    assert g.score(g.matches("You are an idiot")) > 0.5 > g.score(g.matches("he was not an idiot")) > g.score(g.matches("fine"))


def test_toxicity_awkward_rows(spark):
    docs = samples.docs(spark)
    got = toxicity.rate(docs, toxicity.Grammar()).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.learn(empty).weights == toxicity.Grammar().weights
    assert toxicity.rate(samples.none(spark), toxicity.Grammar()).count() == 0
