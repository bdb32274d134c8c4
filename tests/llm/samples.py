"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score string"
WORDS = "the of and river stone lamp garden walks under bright small old tree house north wind carries letters home again".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def rows(seed: int = 7, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 5)))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(text)))
    base = sentence(rng, 120)
    words = base.split()
    near = words.copy()
    near[30] = "changed"
    out += [(100, base, "en", "a", 1), (101, base, "en", "b", 1), (102, " ".join(near), "en", "a", 1), (102, " ".join(near), "en", "a", 1)]
    out += [(110, None, None, None, None), (111, "", "en", "a", 0), (112, " \n\t ", "en", "c", 4), (None, sentence(rng, 20), "en", "a", 3), (None, None, None, None, None)]
    out += [(120, " ".join(f"long{j}" for j in range(5000)), "en", "b", 1), (121, "short", "en", "b", 5), (122, "été 漢字 😀 ß", "fr", "é", 12)]
    return [(*r, 5, "clash", "clash") for r in out]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)
