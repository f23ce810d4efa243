"""Scores of long-form predictions: model, split, station_id, y, yhat (log scale)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import metrics as M

TERMS = {
    "RMSE": M.squared_error,
    "MAE": M.absolute_error,
    "MAPE_%": M.percentage_error,
    "sMAPE_%": M.symmetric_percentage_error,
}
SPLITS = ("val", "test")


def column_predictions(rows: DataFrame, sources: Mapping[str, str], target: str = "y") -> DataFrame:
    """Long form from prediction columns that stand side by side; the rows are read once."""
    if not sources:
        return rows.limit(0).select(
            F.lit("").alias("model"), "split", "station_id", F.col(target).alias("y"), F.lit(0.0).alias("yhat"))
    pairs = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"`{c}`").cast("double").alias("yhat"))
        for name, c in sources.items()
    ])
    return rows.select("split", "station_id", F.col(target).alias("y"), F.explode(pairs).alias("p")).select(
        "p.model", "split", "station_id", "y", "p.yhat"
    )


def score_long(predictions: DataFrame) -> DataFrame:
    """All metrics per model and split: row-weighted and station-weighted, log and volume scale.

    Both weightings come from one pass: sums per station first, then over stations.
    """
    y, p = F.col("y"), F.col("yhat")
    scales = {"": (y, p), "VOL_": (M.to_volume(y), M.to_volume(p))}
    sums = [
        F.sum(term(a, b)).alias(f"sum_{scale}{name}")
        for scale, (a, b) in scales.items() for name, term in TERMS.items()
    ]
    per_station = (
        predictions.na.drop(subset=["station_id", "y", "yhat"])
        .groupBy("model", "split", "station_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    )

    def finish(name: str, mean: Column) -> Column:
        return F.sqrt(mean) if name == "RMSE" else mean

    out = []
    for scale in scales:
        for name in TERMS:
            total = F.col(f"`sum_{scale}{name}`")
            out.append(finish(name, F.sum(total) / F.sum("n_rows")).alias(f"{scale}{name}"))
            out.append(F.avg(finish(name, total / F.col("n_rows"))).alias(f"STW_{scale}{name}"))
    return per_station.groupBy("model", "split").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("STW_n_stations"), *out
    )


def score_columns(prefixes: Sequence[str]) -> list[str]:
    return [f"{prefix}{name}" for prefix in prefixes for name in TERMS]


def comparison_columns() -> list[str]:
    """Metric columns of the comparison table, in its order: 17 for each split."""
    blocks = [score_columns([""]), score_columns(["VOL_"]), score_columns(["STW_"]) + ["STW_n_stations"],
              score_columns(["STW_VOL_"])]
    return [f"{split}_{c}" for block in blocks for split in SPLITS for c in block]


def comparison_wide(scores: DataFrame) -> DataFrame:
    """One row per model with val and test metrics side by side."""
    def pick(column: str) -> Column:
        split, metric = column.split("_", 1)
        return F.max(F.when(F.col("split") == split, F.col(f"`{metric}`"))).alias(column)

    rows = [f"{split}_n_rows" for split in SPLITS]  # tells models apart that were scored on different rows
    return scores.groupBy("model").agg(*[pick(c) for c in [*comparison_columns(), *rows]])
