from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.config import BacktestConfig
from stationflow.operators import folds as FO
from stationflow.operators.predictions import tidy_predictions
from stationflow.operators.scoring import column_predictions, comparison_columns, comparison_wide, score_long

CFG = BacktestConfig(horizon_days=5, step_days=10, min_train_days=20)


def errors(y, p):
    y, p = np.asarray(y), np.asarray(p)
    e = np.abs(y - p)
    return {"RMSE": np.sqrt(np.mean(e**2)), "MAE": np.mean(e),
            "MAPE_%": np.mean(e / np.maximum(np.abs(y), 1e-9)) * 100,
            "sMAPE_%": np.mean(2 * e / np.maximum(np.abs(y) + np.abs(p), 1e-9)) * 100}


def to_volume(z):
    return np.maximum(np.expm1(np.asarray(z)), 0)


# Two stations of unequal length, zeros on both sides, a negative prediction, a missing one.
SCORED = [("test", 1, 0.0, 0.0), ("test", 1, 2.0, 1.0), ("test", 1, 3.0, -1.0), ("test", 2, 5.0, 5.5),
          ("test", 2, 1.0, None), ("val", 1, 4.0, 4.0)]


def test_scores_row_weighted_and_station_weighted(spark):
    df = spark.createDataFrame(SCORED, "split string, station_id long, y double, p double")
    got = {r["split"]: r for r in score_long(column_predictions(df, {"m": "p"})).collect()}["test"]
    rows = [(s, y, p) for split, s, y, p in SCORED if split == "test" and p is not None]
    assert got["n_rows"] == 4 and got["STW_n_stations"] == 2
    for scale, f in (("", np.asarray), ("VOL_", to_volume)):
        for name, value in errors(f([r[1] for r in rows]), f([r[2] for r in rows])).items():
            assert got[f"{scale}{name}"] == pytest.approx(value)
        per = [errors(f([r[1] for r in rows if r[0] == s]), f([r[2] for r in rows if r[0] == s])) for s in (1, 2)]
        for name in per[0]:
            assert got[f"STW_{scale}{name}"] == pytest.approx(np.mean([e[name] for e in per]))
    assert 0 <= got["sMAPE_%"] <= 200


def test_weightings_agree_for_equal_stations(spark):
    df = spark.createDataFrame([("val", s, float(s + i), float(i)) for s in (1, 2) for i in range(4)],
                               "split string, station_id long, y double, p double")
    got = score_long(column_predictions(df, {"m": "p"})).first()
    assert got["MAE"] == pytest.approx(got["STW_MAE"])


def test_comparison_has_17_metrics_per_split(spark):
    df = spark.createDataFrame(SCORED, "split string, station_id long, y double, p double")
    wide = comparison_wide(score_long(column_predictions(df, {"m": "p"})))
    assert len(comparison_columns()) == 34 and wide.columns == ["model", *comparison_columns(), "val_n_rows", "test_n_rows"]
    assert wide.first()["val_RMSE"] == 0.0 and wide.first()["test_STW_n_stations"] == 2


def panel(spark, days):
    """Panel rows at the given day numbers."""
    rows = [(s, date(2022, 1, 1) + timedelta(days=i), 3.0 + i % 5 + s, 4.0, 20.0) for s in (1, 2) for i in days]
    return spark.createDataFrame(rows, "station_id long, date date, y double, y_lag_7 double, station_volume double")


def test_schedule(spark):
    got = FO.fold_schedule(panel(spark, range(50)), CFG).orderBy("fold").collect()
    starts = [date(2022, 1, 21), date(2022, 1, 31), date(2022, 2, 10)]
    assert [(r["fold"], r["test_start"]) for r in got] == list(enumerate(starts, 1))
    assert got[0]["train_end"] == date(2022, 1, 20) and got[0]["test_end"] == date(2022, 1, 25)
    assert FO.fold_schedule(panel(spark, range(10)), CFG).isEmpty()


def test_empty_fold_leaves_a_gap(spark):
    rows = panel(spark, [i for i in range(50) if not 30 <= i < 36])
    got = FO.score_folds(FO.test_rows(rows, CFG).withColumn("y_pred", F.lit(4.0)), CFG).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [1, 3] and got[0]["rows_test"] == 10 and got[0]["stations_test"] == 2
    assert all(r["train_end"] < r["test_start"] for r in got)
    assert got[0]["y_smape_improve_pp"] == 0.0


@pytest.mark.parametrize("step, horizon, min_train", [(10, 5, 20), (3, 7, 20), (1, 4, 0), (7, 7, 5)])
def test_fold_arithmetic_equals_range_join(spark, step, horizon, min_train):
    cfg = replace(CFG, step_days=step, horizon_days=horizon, min_train_days=min_train)
    rows = panel(spark, [i for i in range(60) if i % 9])
    schedule = FO.fold_schedule(rows, cfg).where(F.col("test_start") > F.lit(date(2022, 1, 2)))
    joined = rows.join(schedule, (rows.date >= schedule.test_start) & (rows.date <= schedule.test_end))
    names = ["station_id", "date", "fold", "test_start"]
    direct = FO.test_rows(rows, cfg).select(*names)
    assert direct.exceptAll(joined.select(*names)).isEmpty() and joined.select(*names).exceptAll(direct).isEmpty()
    assert direct.count() == joined.count() > 0


def test_fold_dates_come_from_complete_rows(spark):
    rows = panel(spark, range(50)).withColumn("dow", F.when(F.col("date") > F.lit(date(2022, 1, 5)), 1))
    kept = FO.backtest_rows(rows, CFG, ("dow",))
    assert FO.fold_bounds(kept, CFG).first()["d0"] == date(2022, 1, 6)
    with pytest.raises(ValueError, match="station_volume"):
        FO.backtest_rows(rows.drop("station_volume"), CFG, ("dow",))


def test_tidy_predictions(spark):
    rows = [("train", 1.0, 1.0), ("val", 2.0, -3.0), ("test", 1.0, None)]
    df = spark.createDataFrame(rows, "split string, y double, p double").withColumns({
        "date": F.lit(date(2022, 1, 1)), "station_id": F.lit(1), "y_lag_7": F.lit(1.0), "station_volume": F.lit(9)})
    got = tidy_predictions(df, "p").collect()
    assert len(got) == 1 and got[0]["vol_pred"] == 0.0 and got[0]["vol_true"] == 9.0
    assert got[0]["vol_base"] == pytest.approx(np.expm1(1.0))
