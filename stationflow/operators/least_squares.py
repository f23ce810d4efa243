"""Least squares with one effect per station, from sums alone.

The indicator columns of a one-hot station never exist: their normal equations are diagonal, so each
station's effect follows in closed form from the station's sums and drops out of the small system
for the numeric coefficients. One pass over the rows gives the sums, any number of stations works,
and only a fixed-size matrix (features x features) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.lineage import settle


def sum_columns(inputs: Sequence[str], target: str = "y", weight: Column | None = None) -> list[Column]:
    """Aggregates n, sy, s0, s0_0, ..., s0_y: row count (or summed weight), sums and products of inputs and target."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.col(c) for c in inputs]
    y = F.col(target)
    n = F.count(F.lit(1)) if weight is None else F.sum(w)
    sums = [F.sum(w * a).alias(f"s{i}") for i, a in enumerate(x)]
    sums += [F.sum(w * a * x[j]).alias(f"s{i}_{j}") for i, a in enumerate(x) for j in range(i, len(x))]
    return [n.alias("n"), F.sum(w * y).alias("sy"), *sums, *[F.sum(w * a * y).alias(f"s{i}_y") for i, a in enumerate(x)]]


@dataclass(frozen=True)
class StationSums:
    """Per-station row count, sums and products of inputs and target."""

    table: DataFrame
    inputs: tuple[str, ...]

    @classmethod
    def collect(cls, train: DataFrame, inputs: Sequence[str], target: str = "y", weight: Column | None = None) -> StationSums:
        return cls(settle(train.groupBy("station_id").agg(*sum_columns(inputs, target, weight))), tuple(inputs))


@dataclass(frozen=True)
class StationLinear:
    """Fitted model: intercept, coefficients, and a table of station effects."""

    inputs: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    effects: DataFrame

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """Unknown stations get no effect. The join side is left for Spark to measure."""
        fixed = _dot([F.col(c) for c in self.inputs], self.coefficients) + F.lit(self.intercept)
        return rows.join(self.effects, "station_id", "left").withColumn(
            out, fixed + F.coalesce(F.col("effect"), F.lit(0.0))
        ).drop("effect")


def _dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)], F.lit(0.0))


def pairs_of(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def reduced_sums(k: int, penalty: Column, active: Column | None = None, pull: Column | None = None) -> list[Column]:
    """Normal equations of the inputs and the intercept, the station effects eliminated.

    ``penalty`` is added to a station's n, ``active`` says which stations have an effect (all, if not given), ``pull`` is
    taken off a station's residual sum.
    """
    n, sy = F.col("n"), F.col("sy")
    s = [F.col(f"s{i}") for i in range(k)]
    share, rest = F.lit(1.0) / (n + penalty), penalty / (n + penalty)
    if active is not None:
        share, rest = F.when(active, share).otherwise(0.0), F.when(active, rest).otherwise(1.0)
    level = sy if pull is None else sy - pull
    # a station's n less n * n / (n + penalty), without the difference of two nearly equal numbers
    own = sy * rest if pull is None else sy * rest + n * pull * share
    return [
        *[F.sum(F.col(f"s{i}_{j}") - s[i] * s[j] * share) for i, j in pairs_of(k)],
        *[F.sum(F.col(f"s{i}_y") - s[i] * level * share) for i in range(k)],
        *[F.sum(s[i] * rest) for i in range(k)],
        F.sum(n * rest), F.sum(own),
    ]


def reduced_system(row: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right side for the coefficients and, last, the intercept, from the values of ``reduced_sums``."""
    gram = np.zeros((k + 1, k + 1))
    for value, (i, j) in zip(row, pairs_of(k)):
        gram[i, j] = gram[j, i] = value
    rest = row[len(pairs_of(k)):]
    gram[:k, k] = gram[k, :k] = rest[k:2 * k]
    gram[k, k] = rest[2 * k]
    return gram, np.array([*rest[:k], rest[2 * k + 1]])


def fit_station_linear(sums: StationSums, alpha: float = 0.0, penalty: Column | None = None) -> StationLinear:
    """Ordinary least squares (``alpha`` 0) or ridge; ridge also shrinks the station effects.

    ``penalty`` is a column of the sums that holds ``alpha``: with it the aggregate's code is the same for every alpha.
    """
    k = len(sums.inputs)
    n, sy = F.col("n"), F.col("sy")
    s = [F.col(f"s{i}") for i in range(k)]
    shrunk = n + F.lit(float(alpha))
    gram, right = reduced_system(sums.table.agg(*reduced_sums(k, F.lit(float(alpha)) if penalty is None else penalty)).first(), k)
    if alpha > 0:
        gram[np.arange(k), np.arange(k)] += alpha
        solved = np.linalg.solve(gram, right)
        coefficients, intercept = solved[:k], float(solved[k])
        effect = (sy - _dot(s, coefficients) - n * F.lit(intercept)) / shrunk
    else:
        # Without a penalty only intercept + effect is determined; effects are centred on zero.
        coefficients = np.linalg.lstsq(gram[:k, :k], right[:k], rcond=None)[0]
        level = (sy - _dot(s, coefficients)) / n
        intercept = float(sums.table.agg(F.avg(level)).first()[0])
        effect = level - F.lit(intercept)
    effects = sums.table.select("station_id", effect.alias("effect"))
    return StationLinear(sums.inputs, tuple(float(c) for c in coefficients), intercept, effects)


def one_feature_line(train: DataFrame, feature: str, target: str = "y") -> DataFrame:
    """Slope and intercept of a single-feature least-squares line."""
    return train.agg(
        F.regr_slope(target, feature).alias("slope"), F.regr_intercept(target, feature).alias("intercept"),
        F.regr_r2(target, feature).alias("r2"), F.regr_count(target, feature).alias("n_rows"),
    )
