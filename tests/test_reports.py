from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationflow.config import MartConfig
from stationflow.lineage import settle
from stationflow.plans import forecast_reports as FR
from stationflow.plans import station_reports as SR
from stationflow.plans.jobs import report_tables

SCORES = "station_id long, smape_base double, smape_et double, mean_volume double, delta_smape_pp double"


def improvement(spark, volumes):
    return spark.createDataFrame(
        [(i, 10.0 + i, 10.0, float(v), float(i)) for i, v in enumerate(volumes)], SCORES)


def test_tiers_and_bins_are_right_closed(spark):
    got = FR.improvement_tiers(improvement(spark, range(7))).orderBy("station_id").collect()
    # Edges are exactly 2 and 4; a value on an edge belongs to the lower tier.
    assert [r["tier"] for r in got] == ["low"] * 3 + ["mid"] * 2 + ["high"] * 2


def test_bins_match_pandas_with_repeated_values(spark):
    volumes = [1, 1, 1, 1, 5, 8, 13, 40, 41, 300, 301, 2000]
    got = FR.improvement_tiers(improvement(spark, volumes)).orderBy("station_id").toPandas()
    expected = pd.qcut(np.log10(np.array(volumes)), 8, labels=False, duplicates="drop") + 1
    assert got["qbin"].tolist() == expected.tolist()
    assert FR.improvement_tiers(improvement(spark, [3, 3, 3])).select("qbin").distinct().collect()[0][0] is None


def test_trend_and_boxes(spark):
    tiers = settle(FR.improvement_tiers(improvement(spark, [2**i for i in range(16)])))
    rows = tiers.toPandas()
    trend = FR.improvement_trend(tiers).toPandas().set_index("qbin")
    for b, part in rows.groupby("qbin"):
        assert trend.loc[b, "n"] == len(part)
        assert trend.loc[b, "med"] == pytest.approx(part["delta_smape_pp"].median())
        assert trend.loc[b, "q75"] == pytest.approx(part["delta_smape_pp"].quantile(0.75))
        assert trend.loc[b, "x"] == pytest.approx(10 ** part["log_mean_vol"].median())
    box = FR.tier_summary(tiers).toPandas().set_index("tier")
    assert box.loc["low", "low"] == 0.0 and box.loc["high", "high"] == 15.0 and box["n"].sum() == 16


def test_histogram_share_and_axis(spark):
    scores = improvement(spark, range(31))
    bins = FR.improvement_histogram(scores).toPandas()
    assert bins["n_stations"].sum() == 31 and bins["bin"].min() == 1 and bins["bin"].max() == 30
    assert bins.set_index("bin").loc[30, "n_stations"] == 2  # the top edge is folded into the last bin
    assert FR.improvement_share(scores).first()["improved_pct"] == pytest.approx(100 * 30 / 31)
    assert tuple(FR.improvement_axis(scores).first()) == (-0.5, 30.5)
    same = scores.withColumn("delta_smape_pp", F.lit(2.0))
    assert [tuple(r)[0] for r in FR.improvement_histogram(same).collect()] == [1]


def predictions(spark, stations, days=100):
    rows = [("test", date(2022, 1, 1) + timedelta(days=i), s, 10.0 * s, 10.0 * s + i % 3, 9.0 * s)
            for s in range(1, stations + 1) for i in range(days)]
    return spark.createDataFrame(rows, "split string, date date, station_id long, vol_true double, vol_pred double, vol_base double")


@pytest.mark.parametrize("n, expected", [
    (9, {"low_1": 1, "low_2": 2, "mid_1": 4, "mid_2": 5, "high_1": 8, "high_2": 9}),
    (3, {"low_1": 1, "low_2": 2, "mid_1": 1, "mid_2": 2, "high_1": 2, "high_2": 3}),
    (1, {"low_1": 1, "mid_2": 1, "high_2": 1}),
])
def test_example_slots(spark, n, expected):
    got = FR.example_stations(predictions(spark, n, 3)).collect()
    assert {r["slot"]: r["station_id"] for r in got} == expected


def test_examples_cover_91_days_and_win_rate(spark):
    preds = predictions(spark, 6)
    examples = FR.example_forecasts(preds, FR.example_stations(preds))
    assert examples.count() == 6 * 91
    row = FR.win_rate(examples).where("slot = 'low_1'").first()
    days = range(9, 100)
    model = [200 * abs(i % 3) / (20 + i % 3) for i in days]
    base = 200 * 1 / 19
    assert row["n_days"] == 91 and row["smape_et"] == pytest.approx(np.mean(model))
    assert row["win_rate"] == pytest.approx(np.mean([m < base for m in model]))


def test_weeks_need_six_days(spark):
    monday = date(2022, 1, 3)
    days = [monday + timedelta(days=i) for i in (0, 1, 2, 3, 4)] + [monday + timedelta(days=7 + i) for i in range(6)]
    days += [monday + timedelta(days=14 + i) for i in range(7)]
    rows = [("test", d, s, 2.0, 3.0) for d in days for s in (1, 2)]
    preds = spark.createDataFrame(rows, "split string, day date, station_id long, vol_true double, vol_pred double")
    weekly = FR.system_total_forecast_weekly(preds).orderBy("week_ending").collect()
    assert [(r["week_ending"], r["n_days"], r["true_total"]) for r in weekly] == [
        (date(2022, 1, 16), 6, 24.0), (date(2022, 1, 23), 7, 28.0)]
    assert weekly[1]["pred_ma8"] == pytest.approx((36 + 42) / 2) and "base_total" not in weekly[0].asDict()


def test_station_tables_match_pandas(synthetic_days, synthetic_cfg):
    pdf = synthetic_days.toPandas()
    pdf["date"] = pd.to_datetime(pdf["date"])
    cfg = replace(synthetic_cfg, window_start=date(2023, 1, 1), min_valid_days=50)
    report = MartConfig(baseline_year=2022, shade_from=date(2022, 3, 1))
    # Ratio to the median of the baseline year, by week.
    base = pdf[pdf["date"].dt.year == 2022].groupby("station_id")["station_volume"].median()
    pdf["ratio"] = pdf["station_volume"] / pdf["station_id"].map(base)
    weekly = pdf.set_index("date").groupby(pd.Grouper(freq="W"))["ratio"].agg(
        ["median", lambda s: s.quantile(0.25), lambda s: s.quantile(0.75)])
    spread = weekly["median"].rolling(13, min_periods=8).std()
    got_df = settle(SR.ratio_to_baseline_weekly(synthetic_days, cfg, report))
    got = got_df.toPandas().sort_values("week_ending")
    np.testing.assert_allclose(got[["median", "q25", "q75"]].to_numpy(), weekly.to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got["median_roll_std_13w"].to_numpy(float), spread.to_numpy(), rtol=1e-7)
    pre, post = spread[spread.index < "2023-01-01"].median(), spread[spread.index >= "2023-01-01"].median()
    assert SR.volatility_change(got_df, cfg).first()["reduction_pct"] == pytest.approx(100 * (1 - post / pre))
    # Winsorized day-of-week profile.
    win = pdf[(pdf["date"] >= "2023-01-01") & (pdf["date"] <= "2023-09-12")].copy()
    win["r"] = win["station_volume"] / win.groupby("station_id")["station_volume"].transform("median")
    win["r"] = win["r"].clip(*win["r"].quantile([0.01, 0.99]))
    win["dow"] = win["date"].dt.dayofweek
    means = win.groupby(["station_id", "dow"])["r"].mean().reset_index()
    profile = SR.dow_profile(synthetic_days, cfg).toPandas().sort_values("dow")
    np.testing.assert_allclose(profile["med"], means.groupby("dow")["r"].median(), rtol=1e-9)
    np.testing.assert_allclose(profile["p25"], means.groupby("dow")["r"].quantile(0.25), rtol=1e-9)
    parts = SR.weekpart_by_station(synthetic_days, cfg).toPandas().sort_values("station_id")
    np.testing.assert_allclose(parts["weekday_mean"], win[win["dow"] < 5].groupby("station_id")["r"].mean(), rtol=1e-9)


def test_period_flags(spark, synthetic_cfg):
    weeks = spark.createDataFrame([(date(2021, 12, 5),), (date(2022, 3, 6),)], "week_ending date")
    got = SR.period_flags(weeks, synthetic_cfg, MartConfig(shade_from=date(2020, 3, 1))).first()
    assert got["show_marker"] and got["do_shade"]
    assert (got["shade_start"], got["shade_end"]) == (date(2021, 12, 5), date(2022, 1, 1))


def test_backtest_summary(spark):
    start = date(2022, 1, 1)
    rows = [(i, start + timedelta(days=56 * i), start + timedelta(days=56 * i + 27), b, g)
            for i, b, g in [(1, 9.0, 1.0), (2, 12.0, 3.0), (3, 12.0, 2.5)]]
    folds = spark.createDataFrame(rows, "fold int, test_start date, test_end date, vol_smape_base double, vol_smape_improve_pp double")
    got = FR.backtest_summary(folds).first()
    assert got["n_folds"] == 3 and got["all_improved"] and got["volatile_fold"] == 2
    assert got["horizon_days"] == 28 and got["step_days"] == 56
    assert got["median_improve_pp"] == 2.5 and got["y_upper"] == 3.75
    assert FR.backtest_summary(folds.where("fold = 1")).first()["step_days"] is None


def test_reports_without_input_are_left_out(spark):
    assert report_tables() == {}
    tables = report_tables(predictions=predictions(spark, 7))
    assert "win_rate" in tables and "system_weekly" not in tables and "backtest_summary" not in tables
