"""Expanding-window folds: schedule, membership and per-fold scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.config import FEATURES, BacktestConfig
from stationflow.functions import metrics as M
from stationflow.functions.cleaning import drop_incomplete, require_columns


def backtest_rows(panel: DataFrame, cfg: BacktestConfig, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Panel rows that a fold can use; the fold dates are taken from these rows."""
    needed = ["station_id", "date", cfg.target, cfg.baseline_col, "station_volume"]
    for c in needed:
        require_columns(panel, [c], "panel")
    return drop_incomplete(panel, list(dict.fromkeys([*features, *needed])))


def fold_bounds(rows: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """One row: first day of data, first and last possible test start."""
    return rows.agg(F.min("date").alias("d0"), F.max("date").alias("d1")).select(
        "d0",
        F.date_add("d0", cfg.min_train_days).alias("first"),
        F.date_sub("d1", cfg.horizon_days - 1).alias("last"),
    )


def fold_schedule(rows: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Every fold with its dates. Numbers are positions, so an empty fold leaves a gap later on."""
    step = F.expr(f"interval {cfg.step_days} days")
    starts = F.when(F.col("first") <= F.col("last"), F.sequence("first", "last", step))
    return fold_bounds(rows, cfg).select("d0", F.posexplode(starts).alias("at", "test_start")).select(
        (F.col("at") + 1).alias("fold"),
        F.date_sub("test_start", 1).alias("train_end"),
        "test_start",
        F.date_add("test_start", cfg.horizon_days - 1).alias("test_end"),
    )


def test_rows(rows: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Rows with the fold they test and its dates.

    Folds are evenly spaced, so a row's folds follow from its distance to the first start: no range
    join. Where folds overlap, a row comes once per fold it belongs to. A fold without a row before
    its start has nothing to train on and is left out.
    """
    bounds = fold_bounds(rows, cfg).select(F.struct("*").alias("b")).scalar()
    away = F.datediff("date", F.col("b.first"))
    last_fold = F.floor(F.datediff(F.col("b.last"), F.col("b.first")) / cfg.step_days)
    low = F.greatest(F.lit(0), F.ceil((away - cfg.horizon_days + 1) / cfg.step_days))
    high = F.least(F.floor(away / cfg.step_days), last_fold)
    member = F.when((away >= 0) & (low <= high), F.sequence(low, high))
    start = F.date_add(F.col("b.first"), (F.col("at") * cfg.step_days).cast("int"))
    return (
        rows.withColumn("b", bounds)
        .withColumn("at", F.explode(member))
        .withColumns({"fold": (F.col("at") + 1).cast("int"), "test_start": start})
        .where(F.col("test_start") > F.col("b.d0"))
        .drop("b", "at")
    )


def _error_columns(y: Column, model: Column, base: Column) -> list[Column]:
    vy, vm, vb = M.to_volume(y), M.to_volume(model), M.to_volume(base)
    return [
        M.smape(y, base).alias("y_smape_base"), M.smape(y, model).alias("y_smape_et"),
        M.smape(vy, vb).alias("vol_smape_base"), M.smape(vy, vm).alias("vol_smape_et"),
        M.rmse(vy, vb).alias("vol_rmse_base"), M.rmse(vy, vm).alias("vol_rmse_et"),
    ]


def score_folds(predicted: DataFrame, cfg: BacktestConfig, model_col: str = "y_pred") -> DataFrame:
    """Fold table: size, errors of baseline and model, and the improvement."""
    scored = predicted.groupBy("fold", "test_start").agg(
        F.count(F.lit(1)).alias("rows_test"),
        F.count_distinct("station_id").alias("stations_test"),
        *_error_columns(F.col(cfg.target), F.col(model_col), F.col(cfg.baseline_col)),
    )
    return scored.select(
        "fold",
        F.date_sub("test_start", 1).alias("train_end"),
        "test_start",
        F.date_add("test_start", cfg.horizon_days - 1).alias("test_end"),
        "rows_test", "stations_test",
        "y_smape_base", "y_smape_et",
        (F.col("y_smape_base") - F.col("y_smape_et")).alias("y_smape_improve_pp"),
        "vol_smape_base", "vol_smape_et",
        (F.col("vol_smape_base") - F.col("vol_smape_et")).alias("vol_smape_improve_pp"),
        "vol_rmse_base", "vol_rmse_et",
        M.improvement_percent(F.col("vol_rmse_base"), F.col("vol_rmse_et")).alias("vol_rmse_improve_pct"),
    )
