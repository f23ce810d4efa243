"""Lasso and elastic net with one effect per station, from station sums alone, for any number of stations.

The objective is that of a one-hot design: half the mean squared error, plus ``l1`` times the absolute values and
half of ``l2`` times the squares of all coefficients but the intercept. Given the numeric coefficients and the
intercept, a station's effect is its residual sum, soft-thresholded and shrunk; put back, the objective of the few
numeric coefficients is piecewise quadratic, with a piece for every pattern of stations that have an effect.

One aggregate over the table of stations gives the normal equations of the piece at hand; the small problem with
its own absolute values is solved exactly on them, by a search over signs (with a slight pull to where it stands, as a
piece may leave the intercept free). A second aggregate tells the objective at many step lengths towards that
solution, and the best one is taken. A handful of rounds ends at the optimum, whatever the number of stations.
Several penalties go through the same aggregates side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.operators.least_squares import StationLinear, StationSums, reduced_sums, reduced_system

MOST_ROUNDS = 200
STILL = 1e-10
PULL = 1e-9  # of the mean diagonal
STEPS = tuple(2.0 ** -k for k in range(-2, 30))


@dataclass(frozen=True)
class Penalty:
    """Weights of absolute values and of squares, as they stand beside the mean squared error."""

    l1: float
    l2: float


def small_lasso(gram: np.ndarray, right: np.ndarray, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
    """Minimum of half a quadratic form less ``right`` times the coefficients, plus ``l1`` times the absolute
    values and half ``l2`` times the squares of all but the last one."""
    k = len(right) - 1
    h = gram + np.diag(np.r_[np.full(k, l2), 0.0])
    x = start.copy()
    signs = np.sign(x)
    signs[k] = 0.0
    size = max(1.0, np.abs(right).max())

    def value(v):
        return 0.5 * v @ h @ v - right @ v + l1 * np.abs(v[:k]).sum()

    for _ in range(100 * (k + 1)):
        on = np.flatnonzero(np.r_[signs[:k] != 0, True])
        new = np.zeros(k + 1)
        new[on] = np.linalg.lstsq(h[np.ix_(on, on)], right[on] - l1 * signs[on], rcond=None)[0]
        flips = [j for j in on if j < k and new[j] * signs[j] < 0 or j < k and new[j] == 0]
        if flips:
            # the lowest of the solution and of the places on the way where a coefficient becomes zero
            places = [1.0] + [x[j] / (x[j] - new[j]) for j in flips if x[j] != new[j]]
            tried = [x + t * (new - x) for t in places if 0 <= t <= 1]
            best = min(tried, key=value)
            stuck = np.allclose(best, x, rtol=0, atol=1e-15)
            x = best
            x[:k][np.abs(x[:k]) < 1e-14 * max(1.0, np.abs(x).max())] = 0.0
            old, signs = signs, np.sign(x)
            signs[k] = 0.0
            if stuck and (old == signs).all():
                signs[flips] = 0.0
                x[flips] = 0.0
            continue
        x = new
        slope = h @ x - right
        off = [j for j in range(k) if signs[j] == 0]
        if not off:
            break
        j = max(off, key=lambda j: abs(slope[j]))
        if abs(slope[j]) <= l1 + 1e-12 * size:
            break
        signs[j] = -np.sign(slope[j])
    return x


def _residual(k: int, theta: Column) -> Column:
    """A station's residual sum at coefficients and intercept (an array, the intercept last)."""
    out = F.col("sy") - F.col("n") * theta[k]
    for i in range(k):
        out = out - F.col(f"s{i}") * theta[i]
    return out


def _at(sums: StationSums, points: dict[int, tuple[Penalty, np.ndarray, np.ndarray]], rows: float) -> DataFrame:
    """Every station with every penalty, its residual sum there, and the change of that sum along a direction."""
    k = len(sums.inputs)

    def numbers(v: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in v])

    entries = [F.struct(F.lit(i).alias("number"), F.lit(rows * p.l1).alias("a"), F.lit(rows * p.l2).alias("b"),
                        numbers(theta).alias("theta"), numbers(step).alias("step")) for i, (p, theta, step) in points.items()]
    tried = sums.table.withColumn("p", F.explode(F.array(*entries)))
    still, moved = _residual(k, F.col("p.theta")), _residual(k, F.col("p.step"))
    return tried.withColumns({"number": F.col("p.number"), "a": F.col("p.a"), "b": F.col("p.b"), "residual": still,
                              "change": moved - F.col("sy")})


def _gain(residual: Column) -> Column:
    """What a station's effect takes off the objective."""
    over = F.greatest(F.abs(residual) - F.col("a"), F.lit(0.0))
    return over * over / (F.col("n") + F.col("b")) / 2


def fit_penalised(sums: StationSums, penalties: Sequence[Penalty]) -> list[StationLinear]:
    """One model per penalty."""
    k = len(sums.inputs)
    plain = sums.table.agg(*reduced_sums(k, F.lit(0.0), F.lit(False)), F.sum("n")).first()
    gram, right = reduced_system(plain[:-1], k)
    rows = float(plain[-1] or 0)
    if not rows:
        raise ValueError("no train rows")
    pull = PULL * float(np.trace(gram)) / (k + 1)

    def base(p: Penalty, theta: np.ndarray) -> float:
        return 0.5 * theta @ gram @ theta - right @ theta + rows * (
            p.l1 * np.abs(theta[:k]).sum() + 0.5 * p.l2 * (theta[:k] ** 2).sum())

    nowhere = np.zeros(k + 1)
    here = {i: np.r_[np.zeros(k), right[k] / rows] for i in range(len(penalties))}
    going = set(here)
    for _ in range(MOST_ROUNDS):
        # the piece at each point; the driver gets a row per penalty
        tried = _at(sums, {i: (penalties[i], here[i], nowhere) for i in sorted(going)}, rows)
        active = F.abs("residual") > F.col("a")
        pieces = tried.groupBy("number").agg(
            *reduced_sums(k, F.col("b"), active, F.signum("residual") * F.col("a")), F.sum(_gain(F.col("residual")))).collect()
        steps, objective = {}, {}
        for r in pieces:
            i, p = r[0], penalties[r[0]]
            own, own_right = reduced_system(r[1:-1], k)
            new = small_lasso(own + pull * np.eye(k + 1), own_right + pull * here[i], rows * p.l1, rows * p.l2, here[i])
            steps[i], objective[i] = new - here[i], base(p, here[i]) - r[-1]
        going = {i for i in going if np.abs(steps[i]).max() > STILL * max(1.0, np.abs(here[i]).max())}
        if not going:
            break
        tried = _at(sums, {i: (penalties[i], here[i], steps[i]) for i in sorted(going)}, rows)
        gains = tried.groupBy("number").agg(*[F.sum(_gain(F.col("residual") + F.lit(t) * F.col("change"))) for t in STEPS]).collect()
        for r in gains:
            i = r[0]
            reached = [base(penalties[i], here[i] + t * steps[i]) - g for t, g in zip(STEPS, r[1:])]
            best = int(np.argmin(reached))
            if reached[best] >= objective[i]:  # no step is better, to the last digit
                going.discard(i)
            else:
                here[i] = here[i] + STEPS[best] * steps[i]
        if not going:
            break
    return [_model(sums, penalties[i], here[i], rows) for i in range(len(penalties))]


def _model(sums: StationSums, p: Penalty, theta: np.ndarray, rows: float) -> StationLinear:
    k = len(sums.inputs)
    residual = _residual(k, F.array(*[F.lit(float(v)) for v in theta]))
    threshold = rows * p.l1
    effect = F.signum(residual) * F.greatest(F.abs(residual) - threshold, F.lit(0.0)) / (F.col("n") + rows * p.l2)
    effects: DataFrame = sums.table.select("station_id", effect.alias("effect"))
    return StationLinear(sums.inputs, tuple(float(c) for c in theta[:k]), float(theta[k]), effects)
