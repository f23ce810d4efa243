"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short row of transformed statistics (sizes on a log scale, shares under a
square root). Each class has a mean and a covariance, shrunk towards the covariance of both classes
and towards a diagonal; the score is the logistic of the difference of the two log densities, taken
as Mahalanobis distances through Cholesky factors that are computed once.

Class sums are formed over all labelled training rows, in every task first; the driver gets one row
per pair of statistics and class. Statistics are computed once and staged, then used for both the
fit and the scores.

Defined cases: a null text counts as empty; an empty text has all statistics zero and a score like
any other. Labels other than 0 and 1, null labels and labels without a document are ignored; a
document labelled twice counts twice. If a class has no training row, every score is the share of
label 1 among the training rows (0.5 without any). Repeated rows are scored one by one; a document
without doc_id is scored and never trained on. An empty table gives an empty result. Names of other
columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stationflow.lineage import staged
from stationflow.llm.batches import in_small_batches

FOLDS, HELD_OUT = 4, 2  # rows with crc32(doc_id) mod 4 = 2 are never trained on
THRESHOLD = 0.7
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.02, 1e-4  # shrinkage weights; least variance of a statistic

STATISTICS = (
    "log_words", "log_word_bytes", "upper", "digits", "symbols", "pipes", "calls", "stops", "commas", "beyond_ascii",
    "distinct_words", "repeated_next", "top_word", "log_line_words",
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
FEW = 30  # words added to what is counted by words: a handful of words says little
_SYMBOLS = list(b"#$%&*+/<=>@[\\]^_`{}~")


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of STATISTICS."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts = Counter(words)
    letters = max(1, int(seen[_UPPER].sum() + seen[_LOWER].sum()))
    size = len(data)
    share = lambda k, of: math.sqrt(min(1.0, float(k) / of))
    return [
        math.log1p(n), math.log((size - n + 5 * FEW) / (n + FEW)), share(seen[_UPPER].sum(), letters),
        share(seen[_DIGIT].sum(), size), share(seen[_SYMBOLS].sum(), size), share(seen[124], size),
        share(seen[33] + seen[63], size), share(seen[46], n + FEW), share(seen[44], n + FEW), share(seen[128:].sum(), size),
        math.log(len(counts) + FEW) / math.log(n + FEW), share(sum(map(eq, words, words[1:])), n + FEW),
        share(max(counts.values()) - 1, n + FEW), math.log(n / (1 + int(seen[10]))),
    ]


def statistics(text: Column) -> Column:
    @pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(t) for t in texts], dtype=object)

    return measured(text)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants by class, and the log odds of the classes."""

    means: tuple
    whiten: tuple
    log_dets: tuple
    log_odds: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if not self.means:
            return np.full(len(rows), 1 / (1 + math.exp(-self.log_odds)))
        density = [
            -0.5 * (((rows - mean) @ whiten.T) ** 2).sum(axis=1) - 0.5 * log_det
            for mean, whiten, log_det in zip(self.means, self.whiten, self.log_dets)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], width: int = len(STATISTICS)) -> Discriminant:
    """From count, sum and sum of outer products of each class."""
    counts = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    if not all(counts):
        odds = 0.0 if not any(counts) else (30.0 if counts[1] else -30.0)
        return Discriminant((), (), (), odds)
    means = [sums[c][1] / counts[c] for c in (0, 1)]
    own = [sums[c][2] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (counts[0] * own[0] + counts[1] * own[1]) / sum(counts)
    whiten, log_dets = [], []
    for cov, n in zip(own, counts):
        # few rows say little about a class of their own: they lean on the pooled covariance
        weight = max(TO_POOLED, width / (width + n))
        cov = (1 - weight) * cov + weight * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(width)
        lower = np.linalg.cholesky(cov)
        whiten.append(np.linalg.solve(lower, np.eye(width)))
        log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(means), tuple(whiten), tuple(log_dets), math.log(counts[1] / counts[0]))


def fit(rows: DataFrame) -> Discriminant:
    """rows (label 0 or 1, stats): sums in every task, then one row per label and pair of statistics."""
    width = len(STATISTICS)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width + 1, width + 1))  # with a leading one: counts and sums are its products
        for batch in batches:
            x = np.stack([np.asarray(s, dtype=float) for s in batch["stats"]]) if len(batch) else np.empty((0, width))
            x = np.hstack([np.ones((len(x), 1)), x])
            for label in (0, 1):
                own = x[batch["label"].to_numpy() == label]
                total[label] += own.T @ own
        label, i, j = np.indices(total.shape).reshape(3, -1)
        yield pd.DataFrame({"label": label, "i": i, "j": j, "value": total.ravel()})

    cells = rows.select("label", "stats").mapInPandas(partial, "label int, i int, j int, value double")
    summed = cells.groupBy("label", "i", "j").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, width + 1, width + 1))
    for r in summed:
        total[r["label"], r["i"], r["j"]] = r["value"]
    return discriminant({c: (total[c, 0, 0], total[c, 0, 1:], total[c, 1:, 1:]) for c in (0, 1)}, width)


def score(stats: Column, model: Discriminant) -> Column:
    @pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack([np.asarray(r, dtype=float) for r in rows])))

    return scored(stats)


def scored_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; trained on the other folds."""
    measured = staged(in_small_batches(docs).select("doc_id", statistics(F.col("text")).alias("stats")))
    model = _trained(measured, labels)
    rows = measured.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        score(F.col("stats"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _trained(measured: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")
    return fit(measured.where(fold(F.col("doc_id")) != HELD_OUT).join(known, "doc_id"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    measured = staged(in_small_batches(docs).withColumn("__stats", statistics(F.col("text"))))
    model = _trained(measured.select("doc_id", F.col("__stats").alias("stats")), labels)
    return measured.where(score(F.col("__stats"), model) >= threshold).drop("__stats")
