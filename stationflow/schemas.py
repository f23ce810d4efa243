"""Declared schemas of the tables that jobs hand over to each other."""

from __future__ import annotations

from pyspark.sql import types as T

HOUR_COLUMNS = [str(h) for h in range(1, 25)]
YEAR_FOLDER = "date_year"  # partition column of the written station-day table
HOURLY_KEYS = ["station_id", "dir_of_travel", "lane_of_travel", "date"]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_L, _I, _D, _S, _DT, _B = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType(), T.BooleanType(),
)

# Outside files may hold anything, so every hourly column is read as text and coerced later.
HOURLY_TEXT = _struct(*[(c, _S) for c in HOURLY_KEYS + HOUR_COLUMNS])

STATION_DAY = _struct(
    ("station_id", _L), ("date", _DT), ("station_volume", _D),
    ("dir_a", _L), ("dir_b", _L), ("vol_a", _D), ("vol_b", _D),
    ("share_a", _D), ("share_b", _D), ("n_dirs", _L), ("valid_day", _B),
)

PREDICTIONS = _struct(
    ("split", _S), ("date", _DT), ("station_id", _L),
    ("y_true", _D), ("y_pred", _D), ("y_base", _D),
    ("vol_true", _D), ("vol_pred", _D), ("vol_base", _D),
)

BACKTEST = _struct(
    ("fold", _I), ("train_end", _DT), ("test_start", _DT), ("test_end", _DT),
    ("rows_test", _L), ("stations_test", _L),
    ("y_smape_base", _D), ("y_smape_et", _D), ("y_smape_improve_pp", _D),
    ("vol_smape_base", _D), ("vol_smape_et", _D), ("vol_smape_improve_pp", _D),
    ("vol_rmse_base", _D), ("vol_rmse_et", _D), ("vol_rmse_improve_pct", _D),
)
