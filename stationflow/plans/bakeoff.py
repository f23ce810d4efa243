"""Model comparison and predictions: fit on train, predict val and test, score in one job."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.config import BASELINES, FEATURES
from stationflow.functions.cleaning import drop_incomplete
from stationflow.lineage import settle, staged
from stationflow.operators.encoding import Scaling, is_hashed, numeric, station_columns
from stationflow.operators.extra_trees import TreeSettings, predict_forests, tree_rows
from stationflow.operators.hist_boosting import BoostSettings, boosted, predict_boosted
from stationflow.operators.least_squares import StationLinear, StationSums, fit_station_linear
from stationflow.operators.neighbours import nearest, neighbour_means
from stationflow.operators.penalised import Penalty, fit_penalised
from stationflow.operators.predictions import tidy_predictions
from stationflow.operators.robust import fit_huber
from stationflow.operators.scoring import (
    SPLITS, column_predictions, comparison_columns, comparison_wide, score_long,
)
from stationflow.plans.models import EARLY_STOP_ROWS, ModelSpec, model_zoo, vector_estimator

VECTOR_KINDS = {"forest", "xgboost"}


def model_rows(panel: DataFrame, features: Sequence[str] = FEATURES, target: str = "y",
               baselines: Mapping[str, str] = BASELINES) -> DataFrame:
    """Panel rows with everything a model or baseline reads; absent columns are not asked for."""
    return drop_incomplete(panel, list(dict.fromkeys(
        [*features, "station_id", target, "split", "station_volume", *baselines.values()]
    )))


def _tree_inputs(rows: DataFrame, features: Sequence[str], target: str, row: Column, weight: int) -> DataFrame:
    raw = rows.withColumns({f: numeric(f) for f in features})
    return tree_rows(raw, features, target, F.lit(0), row, F.lit(weight))


def place_of_row() -> Column:
    """A number for a train row that does not depend on how rows were dealt out: draws are made by it."""
    return F.col("station_id") * 100_000 + F.unix_date("date")


def predict_boosted_rows(train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, spec: ModelSpec, out: str,
                         key: str) -> DataFrame:
    """``rows`` with the prediction of a boosted model fitted on ``train``; ``key`` tells rows apart.

    Train rows are drawn and held out by station and day, so that it does not matter how they were dealt out.
    """
    place = place_of_row()
    raw = train.withColumns({f: numeric(f) for f in features})
    fitted = staged(raw.select(
        place.alias("row"), F.col("station_id").alias("station"), F.col(target).alias("y"),
        *[F.col(f).cast("float").cast("double").alias(f"x{i}") for i, f in enumerate(features)]))
    settings = dict(spec.params)
    if settings.get("patience") and fitted.count() <= EARLY_STOP_ROWS:
        settings["patience"] = 0
    model = boosted(fitted, len(features), BoostSettings(**settings))
    found = predict_boosted(_tree_inputs(rows, features, target, F.col(key), 0), len(features), model)
    return rows.join(found.select(F.col("row").alias(key), F.col("yhat").alias(out)), key, "left")


class Workbench:
    """Scaled rows shared by all models of one comparison: scaled once, written once.

    Models that need vectors (MLlib's) get them in ``vectors``, fitted on the train rows when first asked for.
    ``penalties`` are fitted side by side when the first of them is asked for.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str] = FEATURES, target: str = "y",
                 penalties: Sequence[tuple[float, float]] = ()) -> None:
        self.target, self.features = target, tuple(features)
        rows = settle(rows)
        train = rows.where(F.col("split") == "train")
        self.scaling = Scaling.fit(train, features)
        self.inputs = self.scaling.columns
        encoded = settle(self.scaling.apply(rows).withColumn("qid", F.monotonically_increasing_id()))
        self.train = encoded.where(F.col("split") == "train")
        self.holdout = encoded.where(F.col("split").isin(*SPLITS))
        self.penalties = list(dict.fromkeys(penalties))
        self.hashed = False
        self._encoder = None
        self._vectors: DataFrame | None = None
        self._sums: StationSums | None = None
        self._penalised: dict[tuple[float, float], StationLinear] = {}
        self._near: tuple[int, DataFrame] | None = None

    def sums(self) -> StationSums:
        if self._sums is None:
            self._sums = StationSums.collect(self.train, self.inputs, self.target)
        return self._sums

    def penalised(self, alpha: float, l1_ratio: float) -> StationLinear:
        wanted = (alpha, l1_ratio)
        if wanted not in self._penalised:
            several = self.penalties if wanted in self.penalties else [wanted]
            models = fit_penalised(self.sums(), [Penalty(a * ratio, a * (1 - ratio)) for a, ratio in several])
            self._penalised |= dict(zip(several, models))
        return self._penalised[wanted]

    def vectors(self) -> DataFrame:
        """The train rows with ``features`` as one vector."""
        if self._vectors is None:
            self._encoder = station_columns(self.train, self.inputs)
            self.hashed = is_hashed(self._encoder)
            self._vectors = settle(self._encoder.transform(self.train).drop("station_idx", "station_vec"))
        return self._vectors

    def predict(self, rows: DataFrame, spec: ModelSpec, out: str, most_neighbours: int = 0) -> DataFrame:
        """Fits ``spec`` on the train rows and adds its prediction of ``rows`` as column ``out``."""
        if spec.kind == "mean":
            return rows.withColumn(out, F.lit(float(self.train.agg(F.avg(self.target)).first()[0])))
        if spec.kind == "station_linear":
            return fit_station_linear(self.sums(), spec.params["alpha"]).predict(rows, out)
        if spec.kind == "penalized":
            return self.penalised(spec.params["alpha"], spec.params["l1_ratio"]).predict(rows, out)
        if spec.kind == "huber":
            return fit_huber(self.train, self.inputs, self.target, **spec.params).model.predict(rows, out)
        if spec.kind == "neighbours":
            k = spec.params["k"]
            if self._near is None or self._near[0] < k:
                widest = max(k, most_neighbours)
                self._near = (widest, settle(
                    nearest(self.train, self.holdout, self.inputs, widest, self.target)))
            means = neighbour_means(self._near[1], [k]).select("qid", F.col(spec.name).alias(out))
            return rows.join(means, "qid", "left")
        if spec.kind == "extra_trees":
            both = _tree_inputs(self.train, self.features, self.target, place_of_row(), 1).unionByName(
                _tree_inputs(rows, self.features, self.target, F.col("qid"), 0))
            found = predict_forests(both, len(self.features), TreeSettings(**spec.params))
            return rows.join(found.select(F.col("row").alias("qid"), F.col("yhat").alias(out)), "qid", "left")
        if spec.kind == "boosting":
            return predict_boosted_rows(self.train, rows, self.features, self.target, spec, out, "qid")
        model = vector_estimator(spec, self.target, out).fit(self.vectors())
        return model.transform(self._encoder.transform(rows))

    def notes(self, spec: ModelSpec) -> str:
        hashed = "stations hashed" if self.hashed and spec.kind in VECTOR_KINDS else ""
        return "; ".join(n for n in (spec.notes, hashed) if n)


# The texts that stand in the comparison table.
BASELINE_LABEL, USES, MISSING, FAILED = "BASELINE::{}", "uses {}", "missing column: {}", "FAILED: {}: {}"


def _failure(error: Exception) -> str:
    return FAILED.format(type(error).__name__, (str(error).splitlines() or [""])[0])


def evaluate_models(panel: DataFrame, features: Sequence[str] = FEATURES, target: str = "y",
                    baselines: Mapping[str, str] = BASELINES, zoo: Mapping[str, ModelSpec] | None = None,
                    seed: int = 7) -> DataFrame:
    """Comparison table: one row per baseline and model, with 17 metrics on val and on test.

    A model that fails, in its fit or in its predictions, gives a row with the reason and no metrics;
    the others go on. Each model's predictions (row number and value) are written as soon as it is
    fitted, so that its failure is its own; all are scored in one job, with the rows they cover.
    """
    zoo = model_zoo(seed) if zoo is None else dict(zoo)
    rows = model_rows(panel, features, target, baselines)
    bench = Workbench(rows, features, target, [
        (s.params["alpha"], s.params["l1_ratio"]) for s in zoo.values() if s.kind == "penalized"])
    most = max((s.params["k"] for s in zoo.values() if s.kind == "neighbours"), default=0)
    about: list[tuple[str, float | None, str]] = []
    sources: dict[str, str] = {}
    for name, column in baselines.items():
        label = BASELINE_LABEL.format(name)
        if column in panel.columns:
            sources[label] = column
            about.append((label, 0.0, USES.format(column)))
        else:
            about.append((label, None, MISSING.format(column)))
    predictions = column_predictions(bench.holdout, sources, target)
    for name, spec in zoo.items():
        started = time.perf_counter()
        try:
            made = settle(bench.predict(bench.holdout, spec, "yhat", most).select(
                F.lit(name).alias("model"), "split", "station_id", F.col(target).alias("y"), "yhat"))
            predictions = predictions.unionByName(made)
            about.append((name, time.perf_counter() - started, bench.notes(spec)))
        except Exception as error:  # one bad model must not end the comparison
            about.append((name, None, _failure(error)))
    scores = comparison_wide(score_long(predictions))
    # One row per model of the zoo.
    facts = panel.sparkSession.createDataFrame(about, "model string, fit_seconds double, notes string")
    return F.broadcast(facts).join(scores, "model", "left").select(
        "model", "fit_seconds", *[F.col(f"`{c}`") for c in comparison_columns()], *[f"{s}_n_rows" for s in SPLITS], "notes"
    )


def sorted_comparison(comparison: DataFrame, by: str = "test_VOL_RMSE") -> DataFrame:
    """Best first, models without a value last; an unknown column leaves the order alone."""
    return comparison.orderBy(F.asc_nulls_last(f"`{by}`")) if by in comparison.columns else comparison


def fit_and_predict(panel: DataFrame, spec: ModelSpec, features: Sequence[str] = FEATURES,
                    target: str = "y", base_col: str = "y_lag_7") -> DataFrame:
    """Tidy val and test predictions of one model."""
    rows = drop_incomplete(panel, list(dict.fromkeys(
        [*features, "station_id", target, base_col, "station_volume", "split"]
    )))
    bench = Workbench(rows, features, target)
    return tidy_predictions(bench.predict(bench.holdout, spec, "prediction"), "prediction", base_col, target)
