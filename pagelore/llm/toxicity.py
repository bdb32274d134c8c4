"""Toxicity by a weighted finite-state pattern grammar.

Texts are cut into clauses.  Word transducers turn a clause into a string of symbols: insult,
threat, target, negation, reported speech, other.  The composed patterns (an insult said of a target,
a bare insult, a negated or a reported one, a threat to a target, a bare threat) run over those
symbols, and each has a weight; only matched clauses count, not isolated words elsewhere.

The seed lists are general English.  The insult transducer grows by stems and words learned from a
bounded sample of labelled rows, and the pattern weights are fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import cut, own, table

#: At most so many labelled rows of each label are learned from.
SAMPLE_ROWS = 2500
#: A held-out row is one whose crc32 of the id as text has remainder 0 by this.
FOLDS = 5
#: Lengths of the stems that may be learned, and how much likelier a toxic text must be to hold one.
STEM_LENGTHS = range(3, 9)
MIN_LOG_ODDS = 1.5
#: A stem with more clean texts to a toxic one is a stray part of clean words too: its rate counts, not one match.
PURE = 0.02
MAX_STEMS = 400

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
THREATS = ("kill", "hurt", "destroy", "murder", "attack", "beat", "shoot", "stab")
TARGETS = ("you", "your", "he", "she", "they", "him", "her", "them", "this", "these", "those", "everyone", "people")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "wasn't", "don't", "nobody")
REPORTS = ("said", "says", "wrote", "called", "calls", "claimed", "quoted", "reported", "according")

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[^.!?;:\n]+")
#: A negation or a reporting verb takes what follows it in the clause into its scope (lower-case symbols).
SCOPE = re.compile(r"[NR].{0,8}")
#: Composed patterns over clause symbols, strongest first, with the weight they have before any label is seen.
PATTERNS = (
    ("insult_of_target", re.compile(r"T[^NR]{0,6}I|I[^NR]{0,6}T"), 0.90),
    ("insult", re.compile(r"I"), 0.80),
    ("threat_to_target", re.compile(r"K[^NR]{0,4}T"), 0.70),
    ("negated_insult", re.compile(r"N[a-z]*i"), 0.30),
    ("reported_insult", re.compile(r"R[a-z]*i"), 0.30),
    ("threat", re.compile(r"K"), 0.20),
)
#: Weight of the prior, in rows.
PRIOR_ROWS = 4.0


def folded(text: str) -> str:
    """Lower case, compatibility forms unified, invisible characters gone."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).lower().replace("​", "").replace("­", "")


class Grammar:
    """The compiled transducers: seed words, learned stems and words, and the pattern weights."""

    def __init__(self, marks: dict[str, tuple[str, ...]] | None = None, weights: dict[str, float] | None = None,
                 base: float = 0.02, rate: tuple[float, float, float] = (2.0, -1.0, 0.0)):
        """``marks``: learned stems and words by kind: pure_stems, pure_words, stray_stems, stray_words."""
        marks = marks or {}
        self.pure_stems, self.stray_stems = tuple(marks.get("pure_stems", ())), tuple(marks.get("stray_stems", ()))
        pure, stray = {*INSULTS, *marks.get("pure_words", ())}, {*marks.get("stray_words", ())}
        self.weights = weights or {name: w for name, _, w in PATTERNS}
        self.base, self.rate = base, rate
        self.symbols = {**dict.fromkeys(TARGETS, "T"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R"), **dict.fromkeys(THREATS, "K"), **dict.fromkeys(stray, "J"), **dict.fromkeys(pure, "I")}
        heads = {*self.pure_stems, *self.stray_stems, *pure, *stray, *THREATS}
        self.trigger = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(heads, key=len, reverse=True))) + ")")
        #: A text without any of these has no trigger; plain search is far faster than the pattern.
        self.rough = tuple({h[:5] for h in heads})

    def symbol(self, word: str) -> str:
        return self.symbols.get(word) or ("I" if word.startswith(self.pure_stems) else "J" if word.startswith(self.stray_stems) else "o")

    def matches(self, text: str | None) -> Counter:
        """How many clauses match each pattern (each its strongest only), and the stray stems outside negation and report."""
        found: Counter = Counter()
        if not text:
            return found
        text = folded(text)
        if not any(r in text for r in self.rough):
            return found
        end = -1
        for hit in self.trigger.finditer(text):
            if hit.start() < end:
                continue
            start = max(text.rfind(c, 0, hit.start()) for c in ".!?;:\n") + 1
            clause = CLAUSE.match(text, start)
            end = clause.end()
            tape = "".join(self.symbol(w) for w in WORD.findall(clause.group()))
            tape = SCOPE.sub(lambda m: m.group()[0] + m.group()[1:].lower(), tape)
            for name, pattern, _ in PATTERNS:
                if pattern.search(tape):
                    found[name] += 1
                    break
            found["stray"] += tape.count("J")
        if found["stray"]:
            found["words"] = len(WORD.findall(text))
        return +found

    def score(self, found: Counter) -> float:
        """Matched clauses are independent reasons (up to three of a pattern); stray stems count by their rate."""
        clean = 1.0 - self.base
        for name, weight in self.weights.items():
            clean *= (1.0 - weight) ** min(found.get(name, 0), 3)
        if found.get("stray"):
            a, b, c = self.rate
            z = a * math.log(found["stray"]) + b * math.log(found["words"]) + c
            clean *= 1.0 / (1.0 + math.exp(min(z, 30.0)))
        return 1.0 - clean


def _fit_rate(k: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit of toxic on log matches and log words, by Newton steps with a weak ridge towards the prior."""
    prior = np.array([2.0, -1.0, 0.0])
    x, w = np.column_stack([np.log(k), np.log(n), np.ones(len(k))]), prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * (w - prior)), -2, 2)
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text``, ``toxic`` of a bounded sample of the labelled rows that are not held out, equal texts once.

    The sample is drawn from the labels by a hash of the id, at most ``rows`` of each label, so
    joining it may be broadcast whatever the size of the tables.
    """
    known = own(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    drawn = [known.filter(F.col("toxic") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(rows) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = own(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.col("text").isNotNull())
    return texts.groupBy(F.md5("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("same")


def learn(sample: DataFrame) -> Grammar:
    """Stems and words that mark toxic texts, then the weight of each pattern, from ``text``, ``toxic``.

    Stem counts are summed by Spark.  What reaches the driver are the candidates that pass the
    significance test, each with the hashed rows that hold it; both are bounded by the sample.
    An empty sample leaves the seed grammar.
    """
    sample = cut(sample)
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Grammar()

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Grammar()
        for frame in frames:
            found: list[tuple] = []
            for row, text, y in zip(frame.row, frame.text, frame.toxic, strict=True):
                if y and "insult" in {k.split("_")[0] for k in seeds.matches(text)}:
                    continue  # the seed lists explain it
                words = set(WORD.findall(folded(text)))
                marks = {f"={w}" for w in words if len(w) >= 4} | {f"^{w[:n]}" for w in words for n in STEM_LENGTHS if len(w) >= n}
                found += [(m, int(row), int(y)) for m in sorted(marks)]
                if len(found) >= 100_000:
                    yield pd.DataFrame(found, columns=["mark", "row", "toxic"])
                    found = []
            if found:
                yield pd.DataFrame(found, columns=["mark", "row", "toxic"])

    rows = sample.select(F.xxhash64("text").alias("row"), "text", "toxic").mapInPandas(features, "mark string, row long, toxic int")
    least = max(2, toxic // 500)
    counts = rows.groupBy("mark").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter(F.col("t") >= least)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    strong = counts.filter(odds >= MIN_LOG_ODDS).orderBy(F.desc("t"), "c", F.desc(F.length("mark")), "mark").limit(20 * MAX_STEMS)
    held = rows.filter("toxic = 1").join(F.broadcast(strong), "mark").groupBy("mark", "t", "c").agg(F.collect_set("row").alias("rows"))
    candidates = {r.mark: (set(r.rows), r.c) for r in held.collect()}

    marks: dict[str, list[str]] = {f"{kind}_{form}": [] for kind in ("pure", "stray") for form in ("stems", "words")}
    open_ = set().union(*[r for r, _ in candidates.values()]) if candidates else set()
    cost = 2 * toxic / max(clean, 1)
    gain = lambda m: len(candidates[m][0] & open_) - cost * candidates[m][1]
    for _ in range(MAX_STEMS):  # greedy cover; among equals the longer, more specific mark
        mark = max(candidates, key=lambda m: (gain(m), len(m), m), default=None)
        if mark is None or gain(mark) < least:
            break
        has, c = candidates.pop(mark)
        marks[("pure" if c <= PURE * len(has) else "stray") + ("_stems" if mark[0] == "^" else "_words")].append(mark[1:])
        open_ -= has

    marks = {k: tuple(v) for k, v in marks.items()}
    grammar = Grammar(marks)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [grammar.matches(t) for t in frame.text]
            yield pd.DataFrame({
                "pattern": [next((n for n, _, _ in PATTERNS if n in f), "none") for f in found],
                "stray": [f.get("stray", 0) for f in found], "words": [f.get("words", 0) for f in found], "toxic": list(frame.toxic)})

    seen = sample.select("text", "toxic").mapInPandas(scan, "pattern string, stray long, words long, toxic int").toPandas()
    plain = seen[seen.pattern == "none"]

    def fit(rows: pd.DataFrame, prior: float) -> float:
        return float((rows.toxic.sum() + PRIOR_ROWS * prior) / (len(rows) + PRIOR_ROWS))

    weights = {name: min(fit(seen[seen.pattern == name], w), 0.99) for name, _, w in PATTERNS}
    base = min(fit(plain[plain.stray == 0], 0.02), 0.4)
    stray = plain[plain.stray > 0]
    return Grammar(marks, weights, base, _fit_rate(stray.stray.to_numpy(float), stray.words.to_numpy(float), stray.toxic.to_numpy(float)))


def rate(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1), from the whole text alone.

    Null and empty texts, and texts without a matched clause, get the grammar's base score.  Equal
    texts get equal scores.  An empty table gives an empty result; an input column named ``score`` gives way.
    """
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(grammar.matches(t)) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.coalesce(F.col("text"), F.lit(""))))


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    return rate(docs, grammar).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity_grammar": op9_toxicity_grammar}
