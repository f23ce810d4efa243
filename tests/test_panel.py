from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.config import PanelConfig
from stationflow.operators.eligibility import eligibility_stats, eligible_stations, only_eligible
from stationflow.operators.panel import build_panel, build_panel_on_grid

START = date(2022, 1, 1)
CFG = PanelConfig(window_start=START, window_end=date(2022, 2, 9), train_end=date(2022, 1, 20),
                  val_end=date(2022, 1, 31), coverage_threshold=0.0, min_valid_days=0)


def table(spark, rows):
    return spark.createDataFrame(rows, "station_id long, date date, station_volume double, valid_day boolean")


def gap_series():
    missing = {3, 4, 11, 20, 33}
    return [(1, START + timedelta(days=i), float(100 + i * i % 37), True) for i in range(40) if i not in missing]


def test_calendar_lags_and_rolling_windows_over_gaps(spark):
    rows = gap_series()
    y = {r[1]: np.log1p(r[2]) for r in rows}
    got = {r["date"]: r for r in build_panel(table(spark, rows), CFG).collect()}
    assert set(got) == {d for d in y if d - timedelta(days=7) in y}
    for day, row in got.items():
        for k in CFG.lag_days:
            assert row[f"y_lag_{k}"] == y.get(day - timedelta(days=k))
            assert row[f"has_y_lag_{k}"] == int(day - timedelta(days=k) in y)
        for w in CFG.roll_windows:
            past = [y[day - timedelta(days=i)] for i in range(1, w + 1) if day - timedelta(days=i) in y]
            if len(past) < max(2, w // 3):
                assert row[f"y_roll_mean_{w}"] is None and row[f"has_y_roll_{w}"] == 0
            else:
                assert row[f"y_roll_mean_{w}"] == pytest.approx(np.mean(past), abs=1e-12)
                assert row[f"y_roll_std_{w}"] == pytest.approx(np.std(past, ddof=1), abs=1e-9)


def test_window_edges_and_splits(spark):
    days = [START - timedelta(days=7), START, date(2022, 1, 8), date(2022, 1, 13), date(2022, 1, 20), date(2022, 1, 24),
            date(2022, 1, 31), date(2022, 2, 2), date(2022, 2, 9), date(2022, 2, 3), date(2022, 2, 10)]
    got = {r["date"]: r for r in build_panel(table(spark, [(1, d, 5.0, True) for d in days]), CFG).collect()}
    # The day before the window lends no lag to the first day; the day after it is left out.
    assert {d: r["split"] for d, r in got.items()} == {
        date(2022, 1, 8): "train", date(2022, 1, 20): "train", date(2022, 1, 31): "val", date(2022, 2, 9): "test"}


def test_invalid_days_feed_no_lag(spark):
    rows = [(1, START + timedelta(days=i), 5.0, i != 3) for i in range(12)]
    assert START + timedelta(days=10) not in {r["date"] for r in build_panel(table(spark, rows), CFG).collect()}


def test_panel_equals_grid_twin(synthetic_days, synthetic_cfg):
    stations = eligible_stations(synthetic_days, synthetic_cfg)
    grid = build_panel_on_grid(synthetic_days, synthetic_cfg, stations)
    for direct in (build_panel(synthetic_days, synthetic_cfg), build_panel(synthetic_days, synthetic_cfg, stations)):
        assert direct.columns == grid.columns and direct.count() == grid.count() > 1000
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in direct.dtypes]
        assert direct.select(*rounded).exceptAll(grid.select(*rounded)).isEmpty()


def test_features_ignore_today_and_later(spark):
    rows = gap_series()
    cut = START + timedelta(days=25)
    changed = [(s, d, v * 3 if d >= cut else v, ok) for s, d, v, ok in rows]
    features = [f"y_lag_{k}" for k in CFG.lag_days] + [f"y_roll_{f}_{w}" for w in CFG.roll_windows for f in ("mean", "std")]
    a, b = (build_panel(table(spark, r), CFG).where(F.col("date") <= F.lit(cut)).select("date", *features).orderBy("date").collect()
            for r in (rows, changed))
    assert a == b and len(a) > 10


def test_eligibility_table_and_window_form_agree(spark):
    rows = [(s, START + timedelta(days=i), 10.0 * s, i % (s + 1) != 0) for s in range(1, 6) for i in range(40)]
    rows += [(9, START + timedelta(days=i // 2), 1.0, True) for i in range(40)]  # each date twice
    days = table(spark, rows)
    cfg = replace(CFG, coverage_threshold=0.7, min_valid_days=25)
    stats = {r["station_id"]: r for r in eligibility_stats(days, cfg).collect()}
    assert stats[9]["valid_days"] == 20 and not stats[9]["eligible"]
    assert stats[2]["valid_days"] == 26 and stats[2]["coverage"] == 26 / 40 and stats[2]["eligible_days"]
    assert not stats[2]["eligible_cov"] and not stats[2]["eligible"]
    by_table = {r[0] for r in eligible_stations(days, cfg).collect()}
    assert by_table == {r[0] for r in only_eligible(days, cfg).select("station_id").distinct().collect()} == {3, 4, 5}


def test_panel_adds_one_shuffle(spark):
    plan = build_panel(table(spark, gap_series()), CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_config_is_checked():
    with pytest.raises(ValueError):
        PanelConfig(lag_days=(1, 2))
    with pytest.raises(ValueError):
        PanelConfig(train_end=date(2025, 1, 1))
