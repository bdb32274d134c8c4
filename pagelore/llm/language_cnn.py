"""Language identification by a convolutional network over bytes.

Filters of several widths run over the bytes of a window, the largest answer of each filter is kept, and a softmax
layer over these tells the language.  A filter is a table of weights for (offset, byte), so a convolution is a few
look-ups; its gradient reaches only the window's best place.  The network is trained in numpy on windows of a
bounded sample: ``ROWS_PER_LANG`` documents of each language, ``WINDOWS_PER_ROW`` windows each.  Prediction cuts every
whole text into windows of ``LENGTH`` bytes that overlap by the widest filter, runs them in batches over many
texts, and takes the mean probability, weighted by the bytes of a window.

Rows: a null text or one without a letter is ``und`` with score 0, as is every text if nothing can be learned.  Equal
texts get equal results (scores are rounded), repeated rows are predicted each, ties go to the language first in
order.  A very long text is many windows, of which a task holds a batch.  An empty table gives an empty result.  Input columns
``lang_pred`` and ``score`` give way to the results; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm.common import own, replace, table, unused

#: Learned from: so many documents of a language at most, so many windows of each.
ROWS_PER_LANG, WINDOWS_PER_ROW = 400, 4
#: Bytes of a window; filter widths and filters of each.
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows that are run at once.
RUN = 1024
FOLDS = 5
UNKNOWN = "und"

#: Bytes as the network sees them: capitals as small letters, digits alike.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[48:58] = 48


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def windows(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, padded with zeros, and the bytes each holds."""
    raw = FOLDED[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(raw) - (length - step)) // step))
    padded = np.zeros((n - 1) * step + length, dtype=np.uint8)
    padded[:len(raw)] = raw
    cut = np.lib.stride_tricks.sliding_window_view(padded, length)[::step]
    return cut, np.minimum(length, len(raw) - step * np.arange(n)).clip(1)


class Network:
    """Weights: for each width a table (offset, byte, filter), biases, and a softmax layer over all filters."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.base = np.zeros(len(langs), dtype=np.float32)

    def answers(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of each filter in each window (windows, filters), and where it was."""
        best, where = [], []
        for w, weights in zip(WIDTHS, self.tables):
            places_in = x.shape[1] - w + 1
            sums = np.take(weights[0], x[:, :places_in], axis=0)
            for o in range(1, w):
                sums += np.take(weights[o], x[:, o:o + places_in], axis=0)
            if places:
                at = sums.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(sums, at[:, None, :], axis=1)[:, 0, :])
            else:
                best.append(sums.max(axis=1))
        return np.concatenate(best, axis=1) + self.bias, where

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled, 0).astype(np.float64)
        z = np.tile(self.base.astype(np.float64), (len(hidden), 1))
        for f in range(hidden.shape[1]):  # the order of the sum does not hang on the batch
            z += hidden[:, f:f + 1] * self.dense[f].astype(np.float64)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.softmax(self.answers(x)[0])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Mean gradient of the cross entropy: of the tables, the biases and the softmax layer."""
        pooled, where = self.answers(x, places=True)
        error = self.softmax(pooled)
        error[np.arange(len(y)), y] -= 1
        error = (error / len(y)).astype(np.float32)
        hidden = np.maximum(pooled, 0)
        back = (error @ self.dense.T) * (pooled > 0)
        tables = []
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for i, (w, at) in enumerate(zip(WIDTHS, where)):
            grad = np.zeros((w, 256, FILTERS), dtype=np.float32)
            for o in range(w):
                np.add.at(grad[o], (x[rows, at + o], np.broadcast_to(filters, at.shape)), back[:, i * FILTERS:(i + 1) * FILTERS])
            tables.append(grad)
        return [*tables, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.base]


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Adam over shuffled batches.  A quarter of the windows is cut short, so that short texts are learned too."""
    network, rng = Network(langs, seed), np.random.default_rng(seed)
    if len(langs) < 2:
        return network
    x = x.copy()
    for i in np.flatnonzero(rng.random(len(x)) < 0.25):
        x[i, rng.integers(12, x.shape[1]):] = 0
    first = [np.zeros_like(p) for p in network.parameters()]
    second = [np.zeros_like(p) for p in network.parameters()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            step += 1
            chosen = order[at:at + BATCH]
            for p, g, m, v in zip(network.parameters(), network.gradients(x[chosen], y[chosen]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return network


def learn(docs: DataFrame, rows: int = ROWS_PER_LANG, per_row: int = WINDOWS_PER_ROW) -> Network | None:
    """A network from ``text`` and ``lang`` of the documents that are not held out; None if there are none.

    The sample is the ``rows`` least hashed ids of each language (Spark cuts it before the exchange), so what is
    broadcast, and the windows that reach the driver, are bounded by the number of languages alone.
    """
    known = own(docs, "doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("lang")), "doc_id")
    ids = known.select("lang", "doc_id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).select("lang", "doc_id").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for doc_id, lang, text in zip(frame["doc_id"], frame["lang"], frame["text"]):
                cut, held = windows(text)
                for at in np.unique(np.linspace(0, len(cut) - 1, per_row).astype(int)):
                    found.append((doc_id, lang, int(at), cut[at].tobytes()))
            yield pd.DataFrame(found, columns=["doc_id", "lang", "at", "bytes"])

    texts = known.filter(F.col("text").rlike(r"\p{L}")).join(F.broadcast(ids), ["lang", "doc_id"])
    sample = texts.select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, at int, bytes binary").toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["doc_id", "at", "lang", "bytes"], kind="stable")
    langs = sorted(sample["lang"].unique())
    x = np.frombuffer(b"".join(bytes(b) for b in sample["bytes"]), dtype=np.uint8).reshape(len(sample), LENGTH)
    return train(x, sample["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(), langs)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score``, from the whole text alone."""
    if network is None:
        return replace(docs, {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.pandas_udf("struct<lang:string, score:double>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sums = np.zeros((len(texts), len(network.langs)))
            held_x: list[np.ndarray] = []
            held_w: list[np.ndarray] = []
            held_row: list[np.ndarray] = []
            waiting = 0

            def flush() -> None:
                p = network.probabilities(np.concatenate(held_x)) * np.concatenate(held_w)[:, None]
                np.add.at(sums, np.concatenate(held_row), p)
                for kept in (held_x, held_w, held_row):
                    kept.clear()

            for row, text in enumerate(texts):
                if text is None:
                    continue
                cut, weight = windows(text)
                for at in range(0, len(cut), RUN):
                    held_x.append(cut[at:at + RUN])
                    held_w.append(weight[at:at + RUN])
                    held_row.append(np.full(len(held_x[-1]), row))
                    waiting += len(held_x[-1])
                    if waiting >= RUN:
                        flush()
                        waiting = 0
            if held_x:
                flush()
            total = sums.sum(axis=1)
            share = np.round(sums / np.maximum(total, 1e-300)[:, None], 6)
            best = share.argmax(axis=1)
            yield pd.DataFrame({"lang": [network.langs[b] if t else UNKNOWN for b, t in zip(best, total)], "score": share[np.arange(len(best)), best]})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    held = unused(docs, "_told")
    judged = docs.withColumn(held, told(F.when(letters, F.col("text"))))
    return replace(judged, {"lang_pred": F.col(held)["lang"], "score": F.col(held)["score"]}).drop(held)


def op11_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = predict(docs.select("doc_id", "text"), learn(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_byte_cnn": op11_byte_cnn}
