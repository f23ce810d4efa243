from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.config import BASELINES, FEATURES, BacktestConfig
from stationflow.lineage import settle
from stationflow.operators import encoding
from stationflow.operators.encoding import Scaling, station_columns
from stationflow.operators.least_squares import StationSums, fit_station_linear
from stationflow.operators.neighbours import nearest, neighbour_means
from stationflow.plans.backtest import rolling_backtest
from stationflow.plans.bakeoff import Workbench, evaluate_models, fit_and_predict, model_rows, sorted_comparison
from stationflow.plans.models import TRIAL_COUNTS, ModelSpec, extra_trees_like, model_zoo, pick_model, vector_estimator


@pytest.fixture(scope="module")
def bench(synthetic_panel):
    return Workbench(model_rows(synthetic_panel))


@pytest.fixture(scope="module")
def arrays(bench):
    train, test = (df.orderBy("station_id", "date").toPandas() for df in (bench.train, bench.holdout))

    def design(rows):
        hot = (rows["station_id"].to_numpy()[:, None] == np.array([1, 2, 3])[None, :]).astype(float)
        return np.hstack([hot, rows[bench.inputs].to_numpy()])

    return design(train), train["y"].to_numpy(), design(test), test


def predicted(bench, spec):
    rows = bench.predict(bench.holdout, spec, "p").orderBy("station_id", "date")
    return np.array([r[0] for r in rows.select("p").collect()])


def test_scaling_is_population_scaling(bench, synthetic_panel):
    z = bench.train.select(*bench.inputs).toPandas().to_numpy()
    np.testing.assert_allclose(z.mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(z.std(0), 1, atol=1e-9)


def test_scaling_of_missing_infinite_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (float("inf"), 5.0), (None, 5.0), (3.0, 5.0)], "a double, b double")
    scaling = Scaling.fit(df, ["a", "b"])
    assert scaling.means == (1.0, 5.0) and scaling.deviations[1] == 1.0
    assert scaling.deviations[0] == pytest.approx(np.std([1, 0, 0, 3]))


def test_unknown_station_is_all_zero_and_many_stations_are_hashed(spark):
    train = spark.createDataFrame([(s, 1.0) for s in (1, 2, 3)], "station_id long, a double")
    other = spark.createDataFrame([(99, 1.0), (2, 1.0)], "station_id long, a double")
    vectors = [r[0].toArray().tolist() for r in station_columns(train, ["a"]).transform(other).select("features").collect()]
    assert vectors[0] == [1.0, 0.0, 0.0, 0.0] and sum(vectors[1]) == 2.0 and len(vectors[1]) == 4
    hashed = station_columns(train, ["a"], max_stations=2)
    assert encoding.is_hashed(hashed) and hashed.transform(other).first()["features"].size == 3


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_station_linear_equals_one_hot_solution(bench, arrays, alpha):
    x, y, x_test, _ = arrays
    xm, ym = x.mean(0), y.mean()
    gram = (x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1])
    beta = np.linalg.lstsq(gram, (x - xm).T @ (y - ym), rcond=None)[0]
    got = predicted(bench, ModelSpec("m", "station_linear", {"alpha": alpha}))
    np.testing.assert_allclose(got, ym + (x_test - xm) @ beta, rtol=1e-7)


def test_station_linear_for_an_unknown_station(bench, arrays):
    x, y, _, _ = arrays
    model = fit_station_linear(StationSums.collect(bench.train, bench.inputs), 0.0)
    row = bench.holdout.limit(1).withColumn("station_id", F.lit(99).cast("long"))
    got = model.predict(row, "p").first()
    xm, ym = x.mean(0), y.mean()
    beta = np.linalg.lstsq(x - xm, y - ym, rcond=None)[0]
    unseen = np.concatenate([np.zeros(3), [got[c] for c in bench.inputs]])
    assert got["p"] == pytest.approx(ym + (unseen - xm) @ beta, rel=1e-6)


@pytest.mark.parametrize("l1_ratio", [1.0, 0.5])
def test_penalized_models_match_coordinate_descent(bench, arrays, l1_ratio):
    x, y, x_test, _ = arrays
    alpha, n = 0.01, len(y)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(5_000):
        for j in range(len(beta)):
            rho = xc[:, j] @ (yc - xc @ beta + xc[:, j] * beta[j]) / n
            beta[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - l1_ratio))
    got = predicted(bench, ModelSpec("m", "penalized", {"alpha": alpha, "l1_ratio": l1_ratio}))
    np.testing.assert_allclose(got, y.mean() + (x_test - x.mean(0)) @ beta, rtol=2e-4)


def brute_force(x, y, s, qx, qs, k):
    known = set(s.tolist())
    out = []
    for point, station in zip(qx, qs):
        d2 = ((x - point) ** 2).sum(1) + np.where(s == station, 0.0, 2.0 if station in known else 1.0)
        order = np.lexsort((y, d2))[:k]
        d, t = np.sqrt(d2[order]), y[order]
        w = (d == 0).astype(float) if (d == 0).any() else 1 / d
        out.append((t.mean(), (w * t).sum() / w.sum()))
    return np.array(out)


@pytest.mark.parametrize("pivots, train_block, query_block", [(64, 20_000, 5_000), (5, 40, 7), (1, 10_000, 10_000)])
def test_neighbours_equal_brute_force(spark, pivots, train_block, query_block):
    rng = np.random.default_rng(3)
    x, s = rng.normal(size=(600, 3)), rng.integers(1, 5, 600)
    x[:200] = x[0]  # a third of the rows are copies of one point
    s[:200] = 1
    x[200:400] += 40  # far clusters, so that cells can be skipped
    y = rng.normal(size=600).round(3)
    qx, qs = np.vstack([x[::29], rng.normal(size=(10, 3)) * 3]), np.append(s[::29], [1, 2, 3, 4, 9, 9, 1, 2, 3, 4])
    columns = "station_id long, a double, b double, c double, "
    train = spark.createDataFrame([(int(i), *map(float, p), float(t)) for i, p, t in zip(s, x, y)], columns + "y double")
    queries = spark.createDataFrame([(int(i), *map(float, p), q) for q, (i, p) in enumerate(zip(qs, qx))], columns + "qid long")
    near = nearest(train, queries, ["a", "b", "c"], 10, pivots=pivots, train_block=train_block, query_block=query_block)
    got = neighbour_means(near, [3, 10]).orderBy("qid").toPandas()
    assert got["qid"].tolist() == list(range(len(qs)))
    for k in (3, 10):
        expected = brute_force(x, y, s, qx, qs, k)
        np.testing.assert_allclose(got[[f"KNN_k{k}_uniform", f"KNN_k{k}_dist"]].to_numpy(), expected, rtol=1e-9)


def test_a_query_looks_at_few_of_many_clustered_rows(spark):
    rng = np.random.default_rng(7)
    n, clusters = 100_000, 400
    centres = rng.normal(size=(clusters, 3)) * 20
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 3))
    y = rng.normal(size=n).round(3)
    import pandas as pd

    train = spark.createDataFrame(pd.DataFrame({"station_id": 1, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    queries = spark.createDataFrame(pd.DataFrame({"station_id": 1, "a": x[::500, 0], "b": x[::500, 1], "c": x[::500, 2], "qid": range(len(x[::500]))}))
    report: dict = {}
    near = nearest(train, queries, ["a", "b", "c"], 10, report=report)
    got = neighbour_means(near, [10]).orderBy("qid").toPandas()
    expected = brute_force(x, y, np.ones(n, int), x[::500], np.ones(len(x[::500]), int), 10)
    np.testing.assert_allclose(got[["KNN_k10_uniform", "KNN_k10_dist"]].to_numpy(), expected, rtol=1e-9)
    print("share of the rows looked at:", report["share"])
    assert report["share"] < 0.2


def test_neighbour_plan_has_no_cross_join(bench):
    near = nearest(bench.train, bench.holdout, bench.inputs, 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_zoo_names():
    zoo = model_zoo()
    assert len(zoo) == 28 and {"Lasso_a0.0001", "ElasticNet_a0.003_l1r0.5", "KNN_k25_dist"} <= set(zoo)
    assert zoo["ExtraTrees_600_leaf1"].params["trees"] == 600
    with pytest.raises(ValueError, match="Unknown model 'x'. Available"):
        pick_model(zoo, "x")


def test_comparison_isolates_failures_and_missing_baselines(synthetic_panel):
    zoo = {"DummyMean": ModelSpec("DummyMean", "mean"), "Broken": ModelSpec("Broken", "nonsense")}
    table = settle(evaluate_models(synthetic_panel, zoo=zoo, baselines={**BASELINES, "absent": "y_lag_99"}))
    rows = {r["model"]: r for r in table.collect()}
    assert len(rows) == 6 and len(table.columns) == 39
    assert rows["Broken"]["notes"].startswith("FAILED: ValueError:") and rows["Broken"]["test_RMSE"] is None
    assert rows["BASELINE::absent"]["notes"] == "missing column: y_lag_99"
    assert rows["BASELINE::naive_lag1"]["notes"] == "uses y_lag_1" and rows["BASELINE::naive_lag1"]["fit_seconds"] == 0.0
    order = [r["test_VOL_RMSE"] for r in sorted_comparison(table).collect()]
    assert order[:4] == sorted(order[:4]) and order[4:] == [None, None]


class _FailsLate:
    """Fits, and fails when it predicts, without a message."""

    def fit(self, train):
        return self

    def transform(self, rows):
        from pyspark.sql import functions as F

        return rows.withColumn("yhat", F.raise_error(F.lit("late")).cast("double"))


def test_a_model_that_fails_without_message_or_while_predicting_stays_alone(synthetic_panel, monkeypatch):
    import stationflow.plans.bakeoff as bakeoff

    def estimator(spec, target, out):
        if spec.name == "Silent":
            raise AssertionError
        return _FailsLate()

    monkeypatch.setattr(bakeoff, "vector_estimator", estimator)
    zoo = {n: ModelSpec(n, "forest") for n in ("Silent", "Late")} | {"DummyMean": ModelSpec("DummyMean", "mean")}
    rows = {r["model"]: r for r in evaluate_models(synthetic_panel, zoo=zoo, baselines={}).collect()}
    assert rows["Silent"]["notes"] == "FAILED: AssertionError: " and rows["Late"]["notes"].startswith("FAILED: ")
    assert rows["DummyMean"]["test_RMSE"] > 0 and rows["DummyMean"]["test_n_rows"] > 0 and rows["Late"]["test_RMSE"] is None


def test_trees_beat_the_mean_and_repeat(synthetic_panel):
    zoo = model_zoo(counts=TRIAL_COUNTS)
    spec = zoo["ExtraTrees_6_leaf1"]
    first, again = (fit_and_predict(synthetic_panel, spec).orderBy("station_id", "date").toPandas() for _ in range(2))
    assert (first["y_pred"] == again["y_pred"]).all() and first["split"].isin(["val", "test"]).all()
    error = ((first["y_true"] - first["y_pred"]) ** 2).mean()
    assert error < 0.2 * ((first["y_true"] - first["y_true"].mean()) ** 2).mean()


def test_trees_of_the_forest_differ(bench):
    spec = ModelSpec("like", "forest", extra_trees_like(6, 1, 7))
    model = vector_estimator(spec, "y", "p").fit(bench.vectors())
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == len(model.trees) == 6


def test_backtest_with_model(synthetic_panel):
    cfg = BacktestConfig(n_estimators=2, min_train_days=400, step_days=84, parallel_fits=2)
    got = rolling_backtest(synthetic_panel, cfg).orderBy("fold").collect()
    assert [r["fold"] for r in got] == list(range(1, len(got) + 1)) and len(got) >= 2
    for r in got:
        assert r["test_start"] - r["train_end"] == timedelta(days=1)
        assert r["test_end"] - r["test_start"] == timedelta(days=27)
        assert r["vol_smape_improve_pp"] == pytest.approx(r["vol_smape_base"] - r["vol_smape_et"])
    assert len(FEATURES) == 12 and date(2022, 1, 1) < got[0]["train_end"]
