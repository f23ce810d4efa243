"""Huber regression with one effect per station and its scale estimated jointly, by reweighted station sums.

The objective, over coefficients, effects, intercept and scale, is the sum over rows of scale + scale * H(r / scale), H
being the square within ``epsilon`` and linear beyond, plus ``alpha`` times the squares of all coefficients and effects.
Every step weighs a row by 1, or by epsilon * scale / |r| beyond, solves the weighted ridge from the sums of one pass,
and takes the scale at which the objective's slope in it is zero. Each of the two lowers the objective.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.lineage import settle
from stationflow.operators.least_squares import StationLinear, StationSums, fit_station_linear, sum_columns

STEPS, STILL = 100, 1e-10
LEAST_SCALE = 1e-12


@dataclass(frozen=True)
class HuberFit:
    model: StationLinear
    scale: float
    steps: int


def _state(model: StationLinear, scale: float) -> DataFrame:
    """The model as rows, one per station. As columns, not constants, its numbers leave the code of a step the same."""
    return settle(model.effects.select(
        "station_id", "effect", F.lit(model.intercept).alias("w0"), F.lit(float(scale)).alias("scale"),
        F.array(*[F.lit(float(c)) for c in model.coefficients]).alias("w")))


def _residuals(train: DataFrame, state: DataFrame, inputs: Sequence[str], target: str) -> DataFrame:
    fitted = F.col("effect") + F.col("w0")
    for i, c in enumerate(inputs):
        fitted = fitted + F.col(c) * F.col("w")[i]
    return train.select("station_id", target, *inputs).join(state, "station_id").withColumn("r", F.col(target) - fitted)


def fit_huber(train: DataFrame, inputs: Sequence[str], target: str = "y", epsilon: float = 1.35, alpha: float = 1e-4,
              steps: int = STEPS, still: float = STILL) -> HuberFit:
    """Starts from the ridge solution and its root mean square; ends after ``steps``, or when the loss falls by no more than ``still`` of itself."""
    if epsilon <= 1 or alpha <= 0:
        raise ValueError("epsilon must be above 1 and alpha positive")
    model = fit_station_linear(StationSums.collect(train, inputs, target), alpha)
    first = _residuals(train, _state(model, 1.0), inputs, target)
    scale, before = max(float(first.agg(F.sqrt(F.avg(F.col("r") * F.col("r")))).first()[0]), LEAST_SCALE), math.inf
    for step in range(1, steps + 1):
        rows = _residuals(train, _state(model, scale), inputs, target)
        size, limit, square = F.abs("r"), epsilon * F.col("scale"), F.col("r") * F.col("r")
        inside = size <= limit
        # one pass: the sums of the next fit, and what the next scale needs
        loss = F.col("scale") + F.when(inside, square / F.col("scale")).otherwise(2 * epsilon * size - epsilon * limit)
        weighed = rows.withColumns({
            "weight": F.when(inside, 1.0).otherwise(limit / size), "inner": F.when(inside, square).otherwise(0.0),
            "beyond": (~inside).cast("long"), "loss": loss})
        table = settle(weighed.groupBy("station_id").agg(
            *sum_columns(inputs, target, F.col("weight")), F.count(F.lit(1)).alias("rows"), F.sum("inner").alias("inner"),
            F.sum("beyond").alias("beyond"), F.sum("loss").alias("loss"), (F.max("scale") * alpha).alias("penalty")))
        n, inner, beyond, loss_now = table.agg(*[F.sum(c) for c in ("rows", "inner", "beyond", "loss")]).first()
        if before - loss_now <= still * loss_now and before < math.inf and still > 0:
            break
        before = loss_now
        model = fit_station_linear(StationSums(table, tuple(inputs)), alpha * scale, F.col("penalty"))
        free = n - beyond * epsilon * epsilon
        scale = max(math.sqrt(inner / free), LEAST_SCALE) if free > 0 and inner > 0 else LEAST_SCALE
    return HuberFit(model, scale, step)
