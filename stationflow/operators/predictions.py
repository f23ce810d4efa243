"""Tidy predictions of the val and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions.cleaning import as_date, drop_incomplete, pick_date_column
from stationflow.functions.metrics import to_volume


def tidy_predictions(rows: DataFrame, pred_col: str, base_col: str = "y_lag_7", target: str = "y") -> DataFrame:
    tidy = rows.where(F.col("split").isin("val", "test")).select(
        "split", "date", "station_id",
        F.col(target).alias("y_true"),
        F.col(pred_col).alias("y_pred"),
        F.col(base_col).alias("y_base"),
        F.col("station_volume").cast("double").alias("vol_true"),
    )
    complete = drop_incomplete(tidy, ["date", "station_id", "y_true", "y_pred", "y_base", "vol_true"])
    return complete.withColumns({
        "vol_pred": to_volume(F.col("y_pred")),
        "vol_base": to_volume(F.col("y_base")),
    })


def test_predictions(predictions: DataFrame) -> DataFrame:
    """Test rows of a predictions table, with its date column called ``date``."""
    name = pick_date_column(predictions)
    day = as_date(predictions, name)
    out = predictions.withColumn("date", day)
    if "split" in out.columns:
        out = out.where(F.col("split") == "test")
    return out
