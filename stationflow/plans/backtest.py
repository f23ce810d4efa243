"""Expanding-window backtest of a model against the baseline column."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.config import FEATURES, BacktestConfig
from stationflow.lineage import settle
from stationflow.operators.encoding import numeric, station_columns
from stationflow.operators.extra_trees import TreeSettings, predict_forests, tree_rows
from stationflow.operators.fold_sums import first_fold_trained, fit_folds, fold_sums, predict_folds
from stationflow.operators.folds import backtest_rows, score_folds, test_rows
from stationflow.operators.least_squares import StationSums
from stationflow.operators.penalised import Penalty, fit_penalised
from stationflow.operators.robust import fit_huber
from stationflow.plans.bakeoff import place_of_row, predict_boosted_rows
from stationflow.plans.models import ModelSpec, vector_estimator


def backtest_model(cfg: BacktestConfig) -> ModelSpec:
    return ModelSpec("ExtraTrees", "extra_trees", dict(trees=cfg.n_estimators, min_leaf=cfg.min_samples_leaf, seed=cfg.seed))


def rolling_backtest(panel: DataFrame, cfg: BacktestConfig = BacktestConfig(),
                     features: Sequence[str] = FEATURES, spec: ModelSpec | None = None) -> DataFrame:
    """Fold table of a model refitted before every test period.

    Numeric features stay as they are. Extremely randomized trees take the fold as one more key of the grower; linear
    models take every fold's sums from one pass. For other models the driver walks the folds (a count fixed by the
    calendar), a few at a time, and each fold is fitted on its own rows, stations it has not seen among them nowhere. All
    folds are scored in one job.
    """
    spec = spec or backtest_model(cfg)
    features = tuple(features)
    rows = backtest_rows(panel, cfg, features)
    rows = settle(rows.withColumns({f: numeric(f) for f in features}).select(
        "station_id", "date", cfg.target, cfg.baseline_col, *[f for f in features if f != cfg.baseline_col]))
    tested = settle(test_rows(rows, cfg).withColumn("row", F.monotonically_increasing_id()))
    if tested.isEmpty():
        raise ValueError("no fold has both train and test rows")
    if spec.kind == "extra_trees":
        predicted = _extra_trees(rows, tested, cfg, features, spec)
    elif spec.kind == "station_linear":
        solved, effects = fit_folds(fold_sums(rows, cfg, features), features, spec.params["alpha"])
        predicted = predict_folds(tested, solved, effects, features, "y_pred")
    else:
        predicted = _fold_by_fold(rows, tested, cfg, features, spec)
    return score_folds(predicted, cfg)


def _extra_trees(rows: DataFrame, tested: DataFrame, cfg: BacktestConfig, features, spec: ModelSpec) -> DataFrame:
    trained = first_fold_trained(rows, cfg).withColumn("fold", F.explode(F.sequence("since", "until")))
    both = tree_rows(trained, features, cfg.target, F.col("fold"), place_of_row(), F.lit(1)).unionByName(
        tree_rows(tested, features, cfg.target, F.col("fold"), F.col("row"), F.lit(0)))
    # folds without a test row are not grown
    wanted = tested.select(F.col("fold").cast("long").alias("forest")).distinct()
    found = predict_forests(both.join(F.broadcast(wanted), "forest", "left_semi"), len(features), TreeSettings(**spec.params))
    return tested.join(found.select("row", F.col("yhat").alias("y_pred")), "row")


def _fold_by_fold(rows: DataFrame, tested: DataFrame, cfg: BacktestConfig, features, spec: ModelSpec) -> DataFrame:
    folds = [(r["fold"], r["test_start"]) for r in tested.select("fold", "test_start").distinct().collect()]

    def predict(fold: int, start) -> DataFrame:
        train, asked = rows.where(F.col("date") < F.lit(start)), tested.where(F.col("fold") == fold)
        if spec.kind == "penalized":
            sums = StationSums.collect(train, features, cfg.target)
            alpha, ratio = spec.params["alpha"], spec.params["l1_ratio"]
            model = fit_penalised(sums, [Penalty(alpha * ratio, alpha * (1 - ratio))])[0]
            return model.predict(asked, "y_pred")
        if spec.kind == "huber":
            return fit_huber(train, features, cfg.target, **spec.params).model.predict(asked, "y_pred")
        if spec.kind == "boosting":
            return predict_boosted_rows(train, asked, features, cfg.target, spec, "y_pred", "row")
        encoder = station_columns(train, list(features))
        model = vector_estimator(spec, cfg.target, "y_pred").fit(encoder.transform(train))
        return model.transform(encoder.transform(asked))

    with ThreadPoolExecutor(max_workers=cfg.parallel_fits) as pool:
        fit = inheritable_thread_target(rows.sparkSession)(predict)
        made = list(pool.map(lambda f: fit(*f), sorted(folds)))
    kept = ["fold", "test_start", "station_id", cfg.target, cfg.baseline_col, "y_pred"]
    return reduce(DataFrame.unionByName, [m.select(*kept) for m in made])
