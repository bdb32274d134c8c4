"""Quality rules: n-gram perplexity bands.

A modified Kneser-Ney model of order four is counted by Spark over all documents.  The query's model reads
the UTF-8 bytes of the texts, so no two characters of any script are taken for each other; a four-gram packs
into a perfect hash of 32 bits.  ``FOLDED`` is the smaller alphabet of 64 character classes.  The
model is stored as sorted hash arrays with their log probabilities.  A document is rejected if its
log perplexity leaves the band of its language, below or above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import cut, own, replace, table

ORDER = 4
BITS = 6
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Half the width of a band, in robust standard deviations, and the least deviation (nats a character).
BAND_WIDTH = 4.0
LEAST_DEVIATION = 0.02
#: Characters that the base statistics count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
#: Characters counted at a time.
CHUNK = 4_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: 0 before the text, white space 1, a-z, capitals, Latin small letters, digits, stops, rest."""
    out = np.full(0x110000, 63, dtype=np.uint8)
    out[[ord(c) for c in WHITE]] = 1
    out[ord("a") : ord("z") + 1] = np.arange(2, 28)
    out[ord("A") : ord("Z") + 1] = 28
    out[0xC0:0xDF] = 28
    out[0xDF:0x100] = np.clip(np.arange(29, 29 + 33), 29, 60)
    out[ord("0") : ord("9") + 1] = 61
    out[[ord(c) for c in ".,;:?'"]] = 62
    return out


def ngrams(text: str) -> np.ndarray:
    """The packed four-grams of a text, one per character, padded in front."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.zeros(len(points) + ORDER - 1, dtype=np.uint32)
    c[ORDER - 1 :] = classes()[points]
    n = len(points)
    return c[:n] << 18 | c[1 : n + 1] << 12 | c[2 : n + 2] << 6 | c[3 : n + 3]


def byte_grams(text: str) -> np.ndarray:
    """The packed four-grams of the UTF-8 bytes of a text, one per byte, padded in front with a byte that no text has."""
    data = text.encode("utf-8", "surrogatepass")
    c = np.full(len(data) + ORDER - 1, 0xFF, dtype=np.uint32)
    c[ORDER - 1 :] = np.frombuffer(data, dtype=np.uint8)
    n = len(data)
    return c[:n] << 24 | c[1 : n + 1] << 16 | c[2 : n + 2] << 8 | c[3 : n + 3]


class Alphabet(NamedTuple):
    """How a text becomes packed four-grams, and the bits of one symbol."""

    grams: Callable[[str], np.ndarray]
    bits: int


FOLDED = Alphabet(ngrams, BITS)
BYTES = Alphabet(byte_grams, 8)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def count_ngrams(docs: DataFrame, alphabet: Alphabet = FOLDED) -> DataFrame:
    """``ngram``, ``n`` over the whole texts of all documents, combined before the shuffle."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, held, size = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

        def fold() -> None:
            nonlocal keys, counts, held, size
            if held:
                k = np.sort(np.concatenate(held))
                at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, int)
                keys, counts = _summed(np.r_[keys, k[at]], np.r_[counts, np.diff(np.r_[at, len(k)])])
                held, size = [], 0

        for frame in frames:
            for text in frame.text:
                if text:
                    held.append(alphabet.grams(text))
                    size += len(held[-1])
                    if size >= CHUNK:
                        fold()
        fold()
        for at in range(0, len(keys), 100_000):
            yield pd.DataFrame({"ngram": keys[at : at + 100_000].astype("int64"), "n": counts[at : at + 100_000]})

    return docs.select("text").mapInPandas(count, "ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated modified Kneser-Ney of order four from (packed n-gram, count) arrays.

    For each order the sorted n-gram hashes with their log probability, and the sorted context
    hashes with the log weight of the next lower order.  A symbol has ``bits`` bits.
    """

    def __init__(self, ngrams: np.ndarray, counts: np.ndarray, bits: int = BITS):
        self.bits = bits
        keys, counts = _summed(np.asarray(ngrams, np.int64), np.asarray(counts, np.int64))
        levels = {ORDER: (keys, counts)}
        for n in range(ORDER - 1, 0, -1):  # how many different characters an n-gram follows
            above = levels[n + 1][0]
            levels[n] = _summed(above & ((1 << bits * n) - 1), np.ones(len(above), np.int64))
        self.probability: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backoff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lower = np.full(1 << bits, 1.0 / (1 << bits))
        for n in range(1, ORDER + 1):
            keys, counts = levels[n]
            seen = [np.sum(counts == k) for k in (1, 2, 3, 4)]
            y = seen[0] / max(seen[0] + 2 * seen[1], 1)
            discount = [0.0] + [min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.0), k) if seen[k - 1] and y else 0.5 * k for k in (1, 2, 3)]
            off = np.array(discount)[np.minimum(counts, 3)]
            contexts, total = _summed(keys >> bits, counts)
            freed = _summed(keys >> bits, off)[1]
            at = np.searchsorted(contexts, keys >> bits)
            weight = freed / total
            below = lower[keys & ((1 << bits * (n - 1)) - 1 if n > 1 else (1 << bits) - 1)] if n == 1 else self._known(keys & ((1 << bits * (n - 1)) - 1), n - 1)
            self.probability[n] = (keys, np.log(np.maximum((counts - off) / total[at] + weight[at] * below, 1e-12)).astype(np.float32))
            self.backoff[n] = (contexts, np.log(np.maximum(weight, 1e-12)).astype(np.float32))

    def _known(self, keys: np.ndarray, n: int) -> np.ndarray:
        stored, logs = self.probability[n]
        return np.exp(logs[np.searchsorted(stored, keys)].astype(float))

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of each packed four-gram; one that is not stored backs off to shorter ones."""
        out, open_, extra = np.zeros(len(grams)), np.arange(len(grams)), np.zeros(len(grams))
        for n in range(ORDER, 0, -1):
            keys, logs = self.probability[n]
            g = grams[open_].astype(np.int64) & ((1 << self.bits * n) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            out[open_[hit]] = extra[open_[hit]] + logs[at[hit]]
            contexts, weights = self.backoff[n]
            open_, g = open_[~hit], g[~hit] >> self.bits
            if not len(open_):
                return out
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            extra[open_] += np.where(contexts[at] == g, weights[at], 0.0)
        out[open_] = extra[open_] - self.bits * np.log(2)
        return out

    def log_likelihood(self, grams: np.ndarray) -> float:
        """Of all grams together: each distinct one is looked up once, in the order it is stored."""
        if not len(grams):
            return 0.0
        grams = np.sort(grams)
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        distinct, n = grams[first], np.diff(np.r_[first, len(grams)])
        keys, logs = self.probability[ORDER]
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        known = logs[at].astype(np.float64)
        missing = keys[at] != distinct
        if missing.any():
            known[missing] = self.log_probability(distinct[missing])
        return float((n * known).sum())


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines and words in repeated three-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white spaces only
    word_chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict = {}
        marked = bytearray(len(words))
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marked[j : j + 3] = marked[i : i + 3] = b"\x01\x01\x01"
        repeated = sum(marked)
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def train(docs: DataFrame, alphabet: Alphabet = FOLDED) -> KneserNey:
    """A row for each distinct four-gram comes to the driver: what repeats in the texts adds nothing to the model."""
    rows = count_ngrams(docs, alphabet).toPandas()
    return KneserNey(rows.ngram.to_numpy(), rows.n.to_numpy(), alphabet.bits)


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``doc_id``, ``lang``, the base statistics and ``log_ppl`` (nats a symbol; null for a text without characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams_of = next(a.grams for a in (FOLDED, BYTES) if a.bits == shared.value.bits)
        for frame in frames:
            rows = []
            for text in frame.text:
                ppl = None
                if text:
                    grams = grams_of(text)
                    ppl = -shared.value.log_likelihood(grams) / len(grams)
                rows.append((*base_statistics(text), ppl))
            stats = pd.DataFrame(rows, columns=[*STATISTICS, "log_ppl"])
            yield pd.concat([frame[["doc_id", "lang"]].reset_index(drop=True), stats.astype({"log_ppl": "float64"})], axis=1)

    fields = ", ".join(f"{n} long" for n in STATISTICS)
    return docs.select("doc_id", "text", "lang").mapInPandas(run, f"doc_id long, lang string, {fields}, log_ppl double")


def judge(docs: DataFrame, model: KneserNey | None = None, width: float = BAND_WIDTH) -> DataFrame:
    """``doc_id``, ``lang``, base statistics, ``log_ppl``, ``low``, ``high``, ``base_failed``, ``kept``.

    A band is the median of the language plus and minus ``width`` robust standard deviations (from the
    quartiles), over all documents that pass the base rules; a null language is one of its own.
    Null and empty texts have no words and fail the base rules.  Rows that repeat are judged each.  An
    empty table gives an empty result.  Only ``doc_id``, ``text`` and ``lang`` are read.
    """
    docs = own(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    if model is None:
        model = train(docs, BYTES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = cut(score(docs, model).withColumn("base_failed", failed))
    mid = lambda p: F.percentile_approx("log_ppl", F.lit(p), F.lit(10000))
    bands = scored.filter("not base_failed").groupBy("lang").agg(mid(0.25).alias("q1"), mid(0.5).alias("q2"), mid(0.75).alias("q3"))
    spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(LEAST_DEVIATION))
    bands = bands.select(F.col("lang").alias("_lang"), (F.col("q2") - width * spread).alias("low"), (F.col("q2") + width * spread).alias("high"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return scored.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang").withColumn("kept", ~F.col("base_failed") & inside)


def op2_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *STATISTICS, "base_failed", "kept", "log_ppl", "low", "high")


QUERIES = {"op2_kneser_ney_bands": op2_kneser_ney_bands}
