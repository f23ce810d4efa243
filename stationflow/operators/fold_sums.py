"""Linear models of all folds of an expanding backtest, from one pass over the rows.

Folds are nested: a row trains every fold that starts after its date. Rows are summed by station and by the first
fold they train; a fold's sums are those of its own step and of all steps before it, so sixteen folds cost one pass over
the rows and sixteen rows per station, not sixteen passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.config import BacktestConfig
from stationflow.lineage import settle
from stationflow.operators.folds import fold_bounds
from stationflow.operators.least_squares import reduced_sums, reduced_system, sum_columns


def first_fold_trained(rows: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """``rows`` with ``since`` and ``until``: the first and last fold (from 1) that a row trains; rows that train none are left out."""
    bounds = fold_bounds(rows, cfg).select(F.struct("*").alias("b")).scalar()
    away = F.datediff("date", F.col("b.first"))
    return rows.withColumn("b", bounds).withColumns({
        "since": F.greatest(F.lit(1), F.floor(away / cfg.step_days) + 2).cast("int"),
        "until": (F.floor(F.datediff(F.col("b.last"), F.col("b.first")) / cfg.step_days) + 1).cast("int"),
    }).where("since <= until").drop("b")


def fold_sums(rows: DataFrame, cfg: BacktestConfig, inputs: Sequence[str]) -> DataFrame:
    """fold, station_id and the sums of ``sum_columns`` over the rows that train the fold."""
    steps = first_fold_trained(rows, cfg).groupBy("station_id", "since", "until").agg(*sum_columns(inputs, cfg.target))
    names = [c for c in steps.columns if c not in ("station_id", "since", "until")]
    later = steps.withColumn("fold", F.explode(F.sequence("since", "until")))
    return settle(later.groupBy("fold", "station_id").agg(*[F.sum(c).alias(c) for c in names]))


def fit_folds(table: DataFrame, inputs: Sequence[str], alpha: float) -> tuple[DataFrame, DataFrame]:
    """Ridge (or, with ``alpha`` 0, least squares) of every fold: its coefficients, a row per fold, and its station effects.

    ``level`` is what a station adds to the products with the coefficients; ``unknown`` what a station that
    the fold has not seen gets.
    """
    k, spark = len(inputs), table.sparkSession
    shrunk = F.col("n") + F.lit(float(alpha))
    found = table.groupBy("fold").agg(*reduced_sums(k, F.lit(float(alpha)))).collect()  # a row per fold: the calendar bounds them
    rows = []
    for r in found:
        gram, right = reduced_system(r[1:], k)
        if alpha > 0:
            gram[np.arange(k), np.arange(k)] += alpha
            solved = np.linalg.solve(gram, right)
        else:
            solved = np.r_[np.linalg.lstsq(gram[:k, :k], right[:k], rcond=None)[0], 0.0]
        rows.append((r[0], [float(v) for v in solved[:k]], float(solved[k])))
    solved = F.broadcast(spark.createDataFrame(rows, "fold int, w array<double>, w0 double"))
    rest = F.col("sy") - F.col("n") * F.col("w0")
    for i in range(k):
        rest = rest - F.col(f"s{i}") * F.col("w")[i]
    effects = settle(table.join(solved, "fold").select("fold", "station_id", (F.col("w0") + rest / shrunk).alias("level")))
    if alpha > 0:
        return solved.withColumnRenamed("w0", "unknown"), effects
    mean = effects.groupBy("fold").agg(F.avg("level").alias("unknown"))
    return solved.drop("w0").join(F.broadcast(mean), "fold"), effects


def predict_folds(tested: DataFrame, solved: DataFrame, effects: DataFrame, inputs: Sequence[str], out: str) -> DataFrame:
    """``tested`` (with fold) with the prediction of the fold's model."""
    rows = tested.join(F.broadcast(solved), "fold").join(effects, ["fold", "station_id"], "left")
    value = F.coalesce("level", "unknown")
    for i, c in enumerate(inputs):
        value = value + F.col(c) * F.col("w")[i]
    return rows.withColumn(out, value).drop("w", "unknown", "level")
