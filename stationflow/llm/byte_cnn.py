"""Language identification by a byte convolutional network.

A text is its UTF-8 bytes, cut into windows of WINDOW bytes that overlap by the widest filter less one, so
that no stretch a filter can see is cut apart; the last window is filled up with zeros. Bytes are
embedded, filters of several widths run over the window, each keeps its largest value (max pooling), and a
softmax layer gives the window's log probabilities by language. A document's are the sum over all its
windows, from the first byte to the last, and the shares of languages in the training rows.

The network is trained in numpy, by Adam on cross-entropy, on a sample of bounded size: of each language at
most DOCS_PER_LANGUAGE documents (those with the least hash of their id), and of each of these at
most WINDOWS_PER_DOC windows spread over the text. Some windows are cut short in training, since short
texts are. The driver gets these windows alone: 1 MB a language. Languages are whatever values the
column holds; their number is taken to be that of languages, not of documents.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if there is
no row to learn from. Empty languages are languages like others, null ones are not learnt from. A
document without doc_id is predicted, never learnt from, and not held out. Repeated rows are
predicted one by one. Ties go to the language that comes first in order. Very long texts are
read in bounded batches of windows. An empty table gives an empty result. Names of other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stationflow.llm.batches import in_small_batches

FOLDS, HELD_OUT = 4, 2  # rows with crc32(doc_id) mod 4 = 2 are never learnt from
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 2_000, 4
WINDOW, WIDTHS, FILTERS, EMBEDDED = 128, (2, 3, 4, 5), 16, 8
OVERLAP = max(WIDTHS) - 1
PASSES, BATCH, RATE = 4, 256, 5e-3
CUT_SHORT, SHORTEST = 0.3, 4  # share of training windows that are cut, and to how few bytes at least
WINDOWS_AT_A_TIME = 128
UNKNOWN = "und"


@dataclass
class Network:
    """embedding (256, EMBEDDED), filters (widest, EMBEDDED, all filters), bias, softmax layer, log shares."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    shares: np.ndarray

    @classmethod
    def start(cls, languages: list[str], shares: np.ndarray, rng: np.random.Generator) -> Network:
        n = FILTERS * len(WIDTHS)
        filters = rng.standard_normal((max(WIDTHS), EMBEDDED, n)) / np.sqrt(EMBEDDED * np.repeat(WIDTHS, FILTERS))
        return cls(
            languages, rng.standard_normal((256, EMBEDDED)).astype("f4"), (filters * cls.seen()).astype("f4"),
            np.zeros(n, "f4"), (rng.standard_normal((n, len(languages))) / np.sqrt(n)).astype("f4"),
            np.zeros(len(languages), "f4"), shares)

    @staticmethod
    def seen() -> np.ndarray:
        """1 where a filter of its width looks, 0 beyond."""
        return (np.arange(max(WIDTHS))[:, None, None] < np.repeat(WIDTHS, FILTERS)[None, None, :]).astype("f4")

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, WINDOW) of bytes: every filter at every place, (n, places, filters)."""
        n, places, wide = len(windows), WINDOW - OVERLAP, max(WIDTHS) * EMBEDDED
        table = np.where(np.arange(256)[:, None] > 0, self.embedding, np.float32(0))  # zero fills windows up
        rows = table[windows].reshape(n, -1)
        view = np.lib.stride_tricks.as_strided(
            rows, (n, places, wide), (rows.strides[0], rows.itemsize * EMBEDDED, rows.itemsize))
        return (view.reshape(-1, wide) @ self.filters.reshape(wide, -1)).reshape(n, places, -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.responses(windows).max(axis=1) + self.bias, 0)
        return log_softmax(hidden @ self.weights + self.offset)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of ``parameters``; through the largest places alone."""
        n = len(windows)
        responses = self.responses(windows)
        best = responses.argmax(axis=1)
        pooled = np.take_along_axis(responses, best[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        error = np.exp(log_softmax(hidden @ self.weights + self.offset))
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ self.weights.T) * (pooled > 0)
        looked = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]  # (n, filters, widest)
        there = (looked > 0)[..., None] * self.embedding[looked]
        of_filters = np.einsum("nf,nfje->jef", back, there, optimize=True) * self.seen()
        to_bytes = (back[:, :, None, None] * self.filters.transpose(2, 0, 1)[None]).reshape(-1, EMBEDDED)
        flat = looked.reshape(-1)
        of_embedding = np.stack([np.bincount(flat, to_bytes[:, e], minlength=256) for e in range(EMBEDDED)], axis=1)
        of_embedding[0] = 0
        return [of_embedding, of_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each whole text."""
        total = np.tile(self.shares, (len(texts), 1))
        heard = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        held, owners, waiting = [], [], 0

        def settle() -> None:
            np.add.at(total, np.concatenate(owners), self.log_probabilities(np.concatenate(held)))

        for i in np.flatnonzero(heard) if self.languages else ():
            windows = windows_of(texts[i])
            for k in range(0, len(windows), WINDOWS_AT_A_TIME):
                held.append(windows[k:k + WINDOWS_AT_A_TIME])
                owners.append(np.full(len(held[-1]), i))
                waiting += len(held[-1])
                if waiting >= WINDOWS_AT_A_TIME:
                    settle()
                    held, owners, waiting = [], [], 0
        if waiting:
            settle()
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = np.exp(log_softmax(total))[np.arange(len(texts)), best]
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, heard)], np.where(heard, score, 0.0)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, as a view of its bytes: (windows, WINDOW)."""
    data = text.encode("utf-8", "replace")
    step = WINDOW - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.frombuffer(data.ljust(n * step + OVERLAP, b"\0"), np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (step, 1), writeable=False)


def trained(windows: np.ndarray, labels: np.ndarray, languages: list[str], shares: np.ndarray, seed: int = 0) -> Network:
    """A network fitted to windows (n, WINDOW) of bytes and the numbers of their languages."""
    rng = np.random.default_rng(seed)
    net = Network.start(languages, shares, rng)
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in net.parameters]
    steps, total = 0, PASSES * max(1, -(-len(windows) // BATCH))
    for _ in range(PASSES):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            picked = order[k:k + BATCH]
            batch = windows[picked].copy()
            ends = np.where(rng.random(len(batch)) < CUT_SHORT, rng.integers(SHORTEST, WINDOW, len(batch)), WINDOW)
            batch[np.arange(WINDOW)[None, :] >= ends[:, None]] = 0
            steps += 1
            rate = RATE * (1 - (steps - 1) / total)
            for p, g, (m, v) in zip(net.parameters, net.gradients(batch, labels[picked]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)).astype("f4")
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Network:
    """Trained on the bounded sample of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").where(
        (fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    total = sum(r["count"] for r in rows)
    languages, shares = [r["lang"] for r in rows], np.log([r["count"] / total for r in rows])
    if not rows:
        return Network.start([], np.zeros(0), np.random.default_rng(0))
    counts = docs.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in rows], "lang string, n long")
    # about twice as many as wanted, picked by hash in every task; then exactly as many
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = known.join(F.broadcast(counts), "lang").where(place / float(1 << 30) * F.col("n") < 2.0 * docs_per_language)

    @pandas_udf("binary")
    def spread(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            windows = windows_of(text) if any(map(str.isalpha, text)) else np.empty((0, WINDOW), np.uint8)
            picked = np.unique(np.linspace(0, len(windows) - 1, min(len(windows), WINDOWS_PER_DOC)).astype(int))
            out.append(windows[picked].tobytes())
        return pd.Series(out, dtype=object)

    parts = in_small_batches(few).select("lang", "doc_id", spread("text").alias("windows"), F.xxhash64("text").alias("digest"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "digest")
    picked = parts.withColumn("row", F.row_number().over(order)).where(F.col("row") <= docs_per_language)
    sample = picked.orderBy("lang", "row").select("lang", "windows").collect()
    number = {lang: i for i, lang in enumerate(languages)}
    windows = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in sample]
    labels = np.repeat([number[r["lang"]] for r in sample], [len(w) for w in windows]) if sample else np.zeros(0, int)
    return trained(np.concatenate(windows) if windows else np.empty((0, WINDOW), np.uint8), labels, languages, shares)


def predicted_languages(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, docs_per_language))  # some 50 kB

    @pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        languages, scores = net.value.predict(list(texts))
        return pd.DataFrame({"lang_pred": pd.Series(languages, dtype=object), "score": scores})

    rows = in_small_batches(docs).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        predicted("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
