"""Entry points: the flagship query, all registered queries, and their SQL twins.

Every query starts from the given tables and reads them whole. Outputs are rounded to six decimals,
so that sums taken in another order compare equal.
"""

from __future__ import annotations

import os
import sys
import uuid
import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from stationflow.config import BASELINES, FEATURES, BacktestConfig  # noqa: E402
from stationflow.functions.cleaning import drop_incomplete, finite_or_null, with_valid_day  # noqa: E402
from stationflow.lineage import settle, shared_folder  # noqa: E402
from stationflow.operators import folds as FO  # noqa: E402
from stationflow.operators import hourly as H  # noqa: E402
from stationflow.operators import panel as P  # noqa: E402
from stationflow.operators import scoring as S  # noqa: E402
from stationflow.operators import station_day as SD  # noqa: E402
from stationflow.operators.least_squares import one_feature_line  # noqa: E402
from stationflow.operators.neighbours import nearest, neighbour_means  # noqa: E402
from stationflow.operators.eligibility import eligibility_stats, eligible_stations  # noqa: E402
from stationflow.operators.order_statistics import grouped_quantiles  # noqa: E402
from stationflow.operators.predictions import tidy_predictions  # noqa: E402
from stationflow.plans import forecast_reports as FR  # noqa: E402
from stationflow.plans import station_reports as SR  # noqa: E402
from stationflow.plans.backtest import rolling_backtest  # noqa: E402
from stationflow.plans.bakeoff import Workbench, evaluate_models, fit_and_predict, model_rows, sorted_comparison  # noqa: E402
from stationflow.plans.models import (  # noqa: E402
    NEIGHBOURS, TRIAL_COUNTS, ModelSpec, extra_trees_like, model_zoo, pick_model,
)
from stationflow.shipping import ship_package  # noqa: E402
from stationflow.sources import driver_tables as D  # noqa: E402
from stationflow.sources.readers import load_station_day  # noqa: E402

try:  # the corpus operators stand apart: without them everything else still works
    import corpus_pipeline
    from stationflow.llm import queries as corpus
except ImportError as missing:
    corpus_pipeline = corpus = None
    if os.path.isdir(os.path.join(os.path.dirname(os.path.abspath(__file__)), "stationflow", "llm")):
        warnings.warn(f"the corpus operators are left out: {missing}", stacklevel=1)

Query = Callable[[SparkSession, str], DataFrame]
WINDOW, REPORT, BACKTEST = D.WINDOW, D.REPORT, BacktestConfig()
# The comparison of all ensembles takes the small ones of the trial zoo, under names that state their own counts;
# predict_extra_trees and backtest_model run the trees at full count. The rows they read are all there are.
MODELS, FULL = model_zoo(counts=TRIAL_COUNTS), model_zoo()
# Trees, depth and leaves that a SQL twin can spell out.
TEN_TREES = ModelSpec("ExtraTrees_10_depth40", "extra_trees", dict(trees=10, deepest=40, seed=7))
SIX_LEVELS = ModelSpec("ExtraTrees_3_depth6", "extra_trees", dict(trees=3, deepest=6, seed=7, local_rows=0))
FOREST = ModelSpec("RandomForest_5_depth20", "extra_trees", dict(trees=5, deepest=20, min_leaf=2, seed=7, best=True, bootstrap=True))
FOREST_LEVELS = ModelSpec("RandomForest_2_depth5", "extra_trees", dict(
    trees=2, deepest=5, min_leaf=2, seed=7, best=True, bootstrap=True, local_rows=0))
FOLD_TREES = ModelSpec("ExtraTrees_2_depth10", "extra_trees", dict(trees=2, deepest=10, seed=7))
TWO_ROUNDS = dict(rounds=2, rate=0.05, leaves=12, min_leaf=20, l2=1e-3)
HISTOGRAM = ModelSpec("HGB_2_leaves12", "boosting", TWO_ROUNDS)
HISTOGRAM_PASSES = ModelSpec("HGB_2_leaves12_passes", "boosting", TWO_ROUNDS | {"local_rows": 0})
GRADIENT = ModelSpec("GradientBoosting_2_depth3_sub0.8", "boosting", dict(
    rounds=2, rate=0.05, deepest=3, leaves=8, min_leaf=1, subsample=0.8, seed=7))
ONE_FEATURE = ("y_roll_mean_28",)
# Texts of a flag column.
FLAG_TEXTS = ("true", "False", "1", "0", "", "yes", "n/a", "0.0")
ANY_STATION = replace(WINDOW, coverage_threshold=0.0, min_valid_days=0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --- shared inputs ------------------------------------------------------------------------------

def _dir_day(spark, sf, **options) -> DataFrame:
    return H.direction_day(H.lane_totals(D.hourly_lane(spark, sf, **options)))


def _days(spark, sf, **options) -> DataFrame:
    return SD.station_day(_dir_day(spark, sf, **options))


def _text_dir_day(spark, sf) -> DataFrame:
    return H.direction_day(H.lane_totals(D.hourly_text(spark, sf)))


def _three(spark, sf) -> DataFrame:
    return _dir_day(spark, sf, direction=D.three_directions())


def _panel(spark, sf) -> DataFrame:
    return P.build_panel(_days(spark, sf), WINDOW)


def _complete(spark, sf) -> DataFrame:
    return drop_incomplete(_panel(spark, sf), FEATURES)


def _history(spark, sf) -> DataFrame:
    return P.with_history(P.log_series(_days(spark, sf), WINDOW), WINDOW).where(F.col("y").isNotNull())


def _predictions(spark, sf) -> DataFrame:
    return tidy_predictions(_complete(spark, sf), "y_roll_mean_7")


def _predictions_20(spark, sf) -> DataFrame:
    days = _days(spark, sf, station=F.col("l_suppkey") % 20)
    return tidy_predictions(P.build_panel(days, ANY_STATION), "y_roll_mean_7")


def _baseline_scores(spark, sf, *columns) -> DataFrame:
    rows = _complete(spark, sf).where(F.col("split").isin(*S.SPLITS))
    scores = S.score_long(S.column_predictions(rows, BASELINES))
    return scores.select("model", "split", *[F.col(f"`{c}`") for c in columns])


def _fold_rows(spark, sf) -> DataFrame:
    return settle(FO.backtest_rows(_panel(spark, sf), BACKTEST))


def _backtest(spark, sf, cfg: BacktestConfig = BACKTEST) -> DataFrame:
    return FO.score_folds(FO.test_rows(_fold_rows(spark, sf), cfg), cfg, "y_roll_mean_7")


def _improvement(spark, sf) -> DataFrame:
    return FR.station_improvement(_predictions_20(spark, sf))


def _tiers(spark, sf) -> DataFrame:
    return FR.improvement_tiers(settle(_improvement(spark, sf)))


def _examples(spark, sf) -> DataFrame:
    predictions = settle(_predictions_20(spark, sf))
    return FR.example_forecasts(predictions, FR.example_stations(predictions))


# --- queries that need more than one line -------------------------------------------------------

def panel_grid(spark, sf) -> DataFrame:
    days = settle(_days(spark, sf))
    grid = P.calendar_grid(eligible_stations(days, WINDOW), WINDOW)
    observed = P.days_in_window(days, WINDOW).select("station_id", "date", "station_volume")
    return grid.join(observed, ["station_id", "date"], "left").withColumn("y", F.log1p("station_volume"))


def panel_split_counts(spark, sf) -> DataFrame:
    has_all = F.lit(1)
    for c in FEATURES:
        has_all = F.when(F.col(c).isNotNull(), has_all)
    return _panel(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(has_all).alias("n_complete")
    )


def winsorized_ratio_bounds(spark, sf) -> DataFrame:
    return SR.winsorized_ratio(_days(spark, sf), WINDOW).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))


def _bench(spark, sf, features=FEATURES) -> Workbench:
    return Workbench(model_rows(_panel(spark, sf)), features)


def _model_scores(spark, sf, spec: ModelSpec, features=FEATURES) -> DataFrame:
    bench = _bench(spark, sf, features)
    predicted = bench.predict(bench.holdout, spec, "p")
    return S.score_long(S.column_predictions(predicted, {spec.name: "p"})).select(
        "model", "split", *[F.col(f"`{c}`") for c in S.score_columns([""])])


def dummy_mean_scores(spark, sf) -> DataFrame:
    bench = _bench(spark, sf)
    predicted = bench.predict(bench.holdout, MODELS["DummyMean"], "p")
    return S.score_long(S.column_predictions(predicted, {"DummyMean": "p"})).select(
        "model", "split", *[F.col(f"`{c}`") for c in S.score_columns([""])])


def station_effects_scores(spark, sf) -> DataFrame:
    """Least squares on one feature with an effect per station."""
    bench = _bench(spark, sf, ONE_FEATURE)
    predicted = bench.predict(bench.holdout, MODELS["LinearRegression"], "p")
    return S.score_long(S.column_predictions(predicted, {"station_effects": "p"})).select(
        "model", "split", *[F.col(f"`{c}`") for c in S.score_columns([""])])


def knn_exact(spark, sf) -> DataFrame:
    """Predictions of all neighbour models, from one search for the hundred nearest train rows."""
    bench = _bench(spark, sf)
    means = neighbour_means(nearest(bench.train, bench.holdout, bench.inputs, max(NEIGHBOURS)), NEIGHBOURS)
    return bench.holdout.select("qid", "station_id", "date", "split", "y").join(means, "qid").drop("qid")


def knn_exact_scores(spark, sf) -> DataFrame:
    predicted = settle(knn_exact(spark, sf))
    names = [f"KNN_k{k}_{w}" for k in NEIGHBOURS for w in ("dist", "uniform")]
    return S.score_long(S.column_predictions(predicted, {n: n for n in names})).select(
        "model", "split", *[F.col(f"`{c}`") for c in S.score_columns([""])])


def ridge_scores(spark, sf) -> DataFrame:
    """Ridge on one feature with a shrunk effect per station."""
    bench = _bench(spark, sf, ONE_FEATURE)
    predicted = bench.predict(bench.holdout, MODELS["Ridge_a1"], "p")
    return S.score_long(S.column_predictions(predicted, {"ridge": "p"})).select(
        "model", "split", *[F.col(f"`{c}`") for c in S.score_columns([""])])


def _many_days(spark, sf) -> DataFrame:
    """Station days of as many stations as there are suppliers: the fixture grows with the tables."""
    return settle(_days(spark, sf, station=F.col("l_suppkey"), many=True))


def station_day_loaded(spark, sf) -> DataFrame:
    """Station days written as a hand-over table and loaded from it."""
    path = f"{shared_folder(spark).rstrip('/')}/station-days-{uuid.uuid4().hex}"
    _days(spark, sf).write.parquet(path)
    return load_station_day(spark, path).select(
        "station_id", "date", "dir_a", "dir_b", "n_dirs", "valid_day", "station_volume", "vol_a", "vol_b", "share_a", "share_b")


def valid_day_flags(spark, sf) -> DataFrame:
    """Flags as outside tables write them, read as booleans, with the rows of each."""
    flag = F.element_at(F.array(*[F.lit(t) for t in FLAG_TEXTS]), (F.col("l_orderkey") % len(FLAG_TEXTS) + 1).cast("int"))
    items = D.read_table(spark, sf, "lineitem").select(flag.alias("valid_day"), flag.alias("written"))
    return with_valid_day(items).groupBy("written", "valid_day").agg(F.count(F.lit(1)).alias("n_rows"))


def finite_values(spark, sf) -> DataFrame:
    """Ratios, some of them infinite or undefined, with what is not finite as NULL."""
    free = F.col("l_discount") == 0
    ratio = F.when(free & (F.col("l_tax") == 0), F.lit(float("nan"))).when(free, F.lit(float("inf"))).otherwise(
        F.col("l_quantity").cast("double") / F.col("l_discount").cast("double"))
    items = D.read_table(spark, sf, "lineitem").select("l_suppkey", finite_or_null(ratio).alias("ratio"))
    return items.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("ratio").alias("n_finite"), F.max("ratio").alias("largest"))


def comparison_ranked(spark, sf) -> DataFrame:
    """The baselines in the order in which the comparison table lists them."""
    best_first = Window.orderBy(F.asc_nulls_last("test_VOL_RMSE"))
    return sorted_comparison(_compare(spark, sf, set())).select(
        "model", F.row_number().over(best_first).alias("place"), "test_VOL_RMSE")


def week_quantiles_banded(spark, sf) -> DataFrame:
    """Weekly quartiles over as many stations as there are suppliers, by the steps that large weeks take."""
    ratios = settle(SR.ratio_to_baseline(_many_days(spark, sf), ANY_STATION, REPORT).select("week_ending", "ratio"))
    return grouped_quantiles(ratios, ["week_ending"], "ratio", {"median": 0.5, "q25": 0.25, "q75": 0.75}, whole_below=40, accuracy=100)


def backtest_gap_fold(spark, sf) -> DataFrame:
    """A panel without any row in the third test period: the fold is left out, the others keep their numbers."""
    rows = _fold_rows(spark, sf)
    first = rows.select(F.min("date")).scalar()
    since = F.datediff(F.col("date"), first) - BACKTEST.min_train_days - 2 * BACKTEST.step_days
    gapped = rows.where(~since.between(0, BACKTEST.horizon_days - 1))
    return FO.score_folds(FO.test_rows(settle(gapped), BACKTEST), BACKTEST, "y_roll_mean_7")


def _compare(spark, sf, kinds: set[str], baselines=BASELINES) -> DataFrame:
    zoo = {name: spec for name, spec in MODELS.items() if spec.kind in kinds}
    return evaluate_models(_panel(spark, sf), zoo=zoo, baselines=baselines).drop("fit_seconds")


REGISTRY: dict[str, Query] = {
    "lane_totals": lambda s, d: H.lane_totals(D.hourly_lane(s, d)),
    "lane_totals_text": lambda s, d: H.lane_totals(D.hourly_text(s, d)).na.drop(subset=H.DIR_DAY_KEYS),
    "direction_day": _dir_day,
    "direction_day_text": _text_dir_day,
    "top_two_dirs": lambda s, d: SD.top_two_directions(_three(s, d)),
    "station_day": _days,
    "station_day_text": lambda s, d: SD.station_day(_text_dir_day(s, d)),
    "station_day_three_dirs": lambda s, d: SD.station_day(_three(s, d)),
    "year_span": lambda s, d: H.year_span(D.hourly_text(s, d)),
    "station_year_coverage": lambda s, d: SD.station_year_coverage(
        _days(s, d), REPORT.coverage_year_start, REPORT.coverage_year_end),
    "station_coverage": lambda s, d: SD.station_coverage(
        _days(s, d), REPORT.coverage_year_start, REPORT.coverage_year_end),
    "eligibility_stats": lambda s, d: eligibility_stats(_days(s, d), WINDOW),
    "eligibility_stats_by_region": lambda s, d: eligibility_stats(
        _days(s, d, by_region=True), replace(WINDOW, coverage_threshold=0.90)),
    "panel_grid": panel_grid,
    "panel_lags": lambda s, d: _history(s, d).select("station_id", "date", "y", *[
        f"y_lag_{k}" for k in WINDOW.lag_days]),
    "panel_rolling": lambda s, d: _history(s, d).select("station_id", "date", "y", *[
        f"y_roll_{f}_{w}" for w in WINDOW.roll_windows for f in ("mean", "std")]),
    "panel_calendar": lambda s, d: _panel(s, d).select(
        "station_id", "date", "dow", "month", "year", "dayofyear", "sin_doy", "cos_doy"),
    "panel_flags": lambda s, d: _panel(s, d).select("station_id", "date", *[
        f"has_y_lag_{k}" for k in WINDOW.lag_days], *[f"has_y_roll_{w}" for w in WINDOW.roll_windows]),
    "panel_features": _panel,
    "panel_split_counts": panel_split_counts,
    "baseline_scores": lambda s, d: _baseline_scores(s, d, *S.score_columns([""])),
    "baseline_scores_volume": lambda s, d: _baseline_scores(s, d, *S.score_columns(["VOL_"])),
    "station_weighted_scores": lambda s, d: _baseline_scores(
        s, d, "STW_n_stations", *S.score_columns(["STW_"])),
    "station_weighted_scores_volume": lambda s, d: _baseline_scores(
        s, d, "STW_n_stations", *S.score_columns(["STW_VOL_"])),
    "baseline_comparison": lambda s, d: _compare(s, d, set()),
    "dummy_mean_scores": dummy_mean_scores,
    "ols_one_feature": lambda s, d: one_feature_line(
        _complete(s, d).where(F.col("split") == "train"), "y_lag_7"),
    "station_effects_scores": station_effects_scores,
    "knn_exact": knn_exact,
    "knn_exact_scores": knn_exact_scores,
    "predictions_tidy": _predictions,
    "fold_schedule": lambda s, d: FO.fold_schedule(FO.backtest_rows(_panel(s, d), BACKTEST), BACKTEST),
    "backtest_baseline": _backtest,
    "backtest_overlapping_folds": lambda s, d: _backtest(s, d, replace(BACKTEST, step_days=14)),
    "backtest_summary": lambda s, d: FR.backtest_summary(_backtest(s, d)),
    "ratio_to_baseline_weekly": lambda s, d: SR.ratio_to_baseline_weekly(_days(s, d), WINDOW, REPORT),
    "week_quantiles_banded": week_quantiles_banded,
    "ratio_weekly_sketched": lambda s, d: SR.ratio_weekly_sketched(
        settle(SR.daily_ratio_sketches(_days(s, d), WINDOW, REPORT))),
    "volatility_change": lambda s, d: SR.volatility_change(
        SR.ratio_to_baseline_weekly(_days(s, d), WINDOW, REPORT), WINDOW),
    "system_weekly": lambda s, d: SR.system_weekly(_days(s, d), WINDOW),
    "period_flags": lambda s, d: SR.period_flags(SR.system_weekly(_days(s, d), WINDOW), WINDOW, REPORT),
    "winsorized_ratio_bounds": winsorized_ratio_bounds,
    "dow_profile": lambda s, d: SR.dow_profile(_days(s, d), WINDOW),
    "weekpart_by_station": lambda s, d: SR.weekpart_by_station(_days(s, d), WINDOW),
    "weekpart_summary": lambda s, d: SR.weekpart_summary(SR.weekpart_by_station(_days(s, d), WINDOW)),
    "station_improvement": _improvement,
    "improvement_share": lambda s, d: FR.improvement_share(_improvement(s, d)),
    "improvement_histogram": lambda s, d: FR.improvement_histogram(settle(_improvement(s, d))),
    "improvement_tiers": _tiers,
    "improvement_trend": lambda s, d: FR.improvement_trend(settle(_tiers(s, d))),
    "tier_summary": lambda s, d: FR.tier_summary(settle(_tiers(s, d))),
    "improvement_axis": lambda s, d: FR.improvement_axis(_improvement(s, d)),
    "example_stations": lambda s, d: FR.example_stations(_predictions_20(s, d)),
    "example_forecasts": _examples,
    "win_rate": lambda s, d: FR.win_rate(_examples(s, d)),
    "system_total_forecast_weekly": lambda s, d: FR.system_total_forecast_weekly(_predictions(s, d)),
    "bakeoff_linear": lambda s, d: _compare(s, d, {"mean", "station_linear", "penalized", "huber"}),
    "bakeoff_trees": lambda s, d: _compare(s, d, {"forest", "boosting", "extra_trees"}),
    "predict_extra_trees_like": lambda s, d: fit_and_predict(
        _panel(s, d), ModelSpec("extra_trees_like_6", "forest", extra_trees_like(6, 1, 7))).withColumn(
        "model", F.lit("extra_trees_like_6")),
    "predict_extra_trees": lambda s, d: fit_and_predict(
        _panel(s, d), pick_model(FULL, "ExtraTrees_600_leaf1")).withColumn("model", F.lit("ExtraTrees_600_leaf1")),
    "backtest_model": lambda s, d: rolling_backtest(_panel(s, d), BACKTEST).withColumn(
        "n_estimators", F.lit(BACKTEST.n_estimators)),
    "extra_trees_scores": lambda s, d: _model_scores(s, d, TEN_TREES),
    "extra_trees_levels_scores": lambda s, d: _model_scores(s, d, SIX_LEVELS),
    "random_forest_scores": lambda s, d: _model_scores(s, d, FOREST),
    "random_forest_levels_scores": lambda s, d: _model_scores(s, d, FOREST_LEVELS),
    "backtest_extra_trees": lambda s, d: rolling_backtest(_complete(s, d), BACKTEST, spec=FOLD_TREES),
    "hist_boosting_scores": lambda s, d: _model_scores(s, d, HISTOGRAM),
    "hist_boosting_passes_scores": lambda s, d: _model_scores(s, d, HISTOGRAM_PASSES),
    "gradient_boosting_scores": lambda s, d: _model_scores(s, d, GRADIENT),
    "lasso_scores": lambda s, d: _model_scores(s, d, FULL["Lasso_a0.01"], ONE_FEATURE),
    "elastic_net_scores": lambda s, d: _model_scores(s, d, FULL["ElasticNet_a0.01_l1r0.5"], ONE_FEATURE),
    "huber_scores": lambda s, d: _model_scores(s, d, ModelSpec("Huber_8_steps", "huber", {"steps": 8, "still": 0.0}), ONE_FEATURE),
    "backtest_ridge": lambda s, d: rolling_backtest(_complete(s, d), BACKTEST, ONE_FEATURE, FULL["Ridge_a1"]),
    "direction_day_dates": lambda s, d: H.direction_day(H.lane_totals(D.hourly_dates(s, d))),
    "station_day_loaded": station_day_loaded,
    "valid_day_flags": valid_day_flags,
    "finite_values": finite_values,
    "ridge_scores": ridge_scores,
    "comparison_ranked": comparison_ranked,
    "backtest_gap_fold": backtest_gap_fold,
    "backtest_summary_stated": lambda s, d: FR.backtest_summary(
        _backtest(s, d).withColumns({"horizon_days": F.lit(21), "step_days": F.lit(63)})),
    "ratio_to_baseline_weekly_many": lambda s, d: SR.ratio_to_baseline_weekly(_many_days(s, d), ANY_STATION, REPORT),
    "system_weekly_many": lambda s, d: SR.system_weekly(_many_days(s, d), ANY_STATION),
    "dow_profile_many": lambda s, d: SR.dow_profile(_many_days(s, d), ANY_STATION),
    "weekpart_summary_many": lambda s, d: SR.weekpart_summary(SR.weekpart_by_station(_many_days(s, d), ANY_STATION)),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: raw hourly rows to the feature panel."""
    sf = "/root/testdata/sf0.001"
    cfg = replace(WINDOW, coverage_threshold=0.15, min_valid_days=150)
    return rounded(P.build_panel(_days(spark, sf, station=F.col("l_suppkey") % 2), cfg))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def _registered(query: Query) -> Query:
    return _shipped(lambda spark, sf_dir: rounded(query(spark, sf_dir)))


def queries() -> dict[str, Query]:
    found = {name: _registered(query) for name, query in REGISTRY.items()}
    if corpus:
        own = corpus.queries() | {"pipeline": corpus_pipeline.run}
        found |= {name: _shipped(query) for name, query in own.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, sql in oracle_queries.oracle_sql().items() if name in REGISTRY}
    if corpus:
        found |= corpus.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
