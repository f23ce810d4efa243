"""Trees grown over tables, boosting in passes, and models from station sums, against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stationflow.config import BacktestConfig
from stationflow.operators import extra_trees as ET
from stationflow.operators import hist_boosting as HB
from stationflow.operators.encoding import station_columns
from stationflow.operators.fold_sums import first_fold_trained, fold_sums
from stationflow.operators.folds import fold_schedule
from stationflow.operators.least_squares import StationSums, fit_station_linear
from stationflow.operators.penalised import Penalty, fit_penalised, small_lasso
from stationflow.operators.robust import fit_huber
from stationflow.plans.backtest import rolling_backtest
from stationflow.plans.models import ModelSpec


def made(n=400, stations=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).astype("float32").astype(float)
    x[:, 2] = rng.integers(0, 4, n)  # ties
    station = rng.integers(1, stations + 1, n)
    y = np.round(x[:, 0] + 0.5 * station + np.sin(3 * x[:, 1]) + 0.2 * rng.normal(size=n), 6)
    return station, x, y


def tree_table(spark, station, x, y, held, forest=0):
    rows = [(forest, i, int(s), 0 if h else 1, *map(float, v), float(t)) for i, (s, v, t, h) in enumerate(zip(station, x, y, held))]
    df = spark.createDataFrame(rows, "forest long, row long, station_id long, w long, a double, b double, c double, y double")
    return ET.tree_rows(df, ["a", "b", "c"], "y", F.col("forest"), F.col("row"), F.col("w"))


def plain_tree(tree, node, rows, station, x, yq, asked, settings, depth=0):
    """{asked row: value}, one node at a time."""
    here = [i for i in rows if i not in asked]
    n, s = len(here), sum(int(yq[i]) for i in here)
    best = None
    if len({int(yq[i]) for i in here}) > 1 and depth < settings.deepest:
        tries = []
        for f in range(x.shape[1]):
            low, high = min(x[i, f] for i in here), max(x[i, f] for i in here)
            if low < high:
                cut = low + ET.mixed(tree, node, f, settings.seed) / float(ET.PRIME) * (high - low)
                tries.append((f, 0, lambda i, f=f, cut=cut: x[i, f] <= cut))
        tries += [(1000, st, lambda i, st=st: station[i] == st) for st in sorted({int(station[i]) for i in here})]
        for f, st, left in tries:
            nl, sl = sum(left(i) for i in here), sum(int(yq[i]) for i in here if left(i))
            if min(nl, n - nl) < settings.min_leaf:
                continue
            gain = float(sl) * float(sl) / nl + float(s - sl) * float(s - sl) / (n - nl)
            if best is None or gain > best[0]:
                best = (gain, left)
    if best is None:
        return {i: s / n / ET.SCALE for i in rows if i in asked}
    sides = [i for i in rows if best[1](i)], [i for i in rows if not best[1](i)]
    return plain_tree(tree, 2 * node, sides[0], station, x, yq, asked, settings, depth + 1) | plain_tree(
        tree, 2 * node + 1, sides[1], station, x, yq, asked, settings, depth + 1)


@pytest.mark.parametrize("local_rows, min_leaf, deepest", [(10_000, 1, 62), (60, 1, 62), (0, 3, 5), (60, 3, 62)])
def test_extra_trees_equal_plain_trees_wherever_nodes_are_finished(spark, local_rows, min_leaf, deepest):
    station, x, y = made()
    held = np.arange(len(y)) % 4 == 0
    station[held & (np.arange(len(y)) % 16 == 0)] = 99  # unknown to the train rows
    settings = ET.TreeSettings(trees=3, min_leaf=min_leaf, seed=5, deepest=deepest, local_rows=local_rows)
    got = {r["row"]: r["yhat"] for r in ET.predict_forests(tree_table(spark, station, x, y, held), 3, settings).collect()}
    yq = np.round(y * ET.SCALE).astype(np.int64)
    asked = set(np.flatnonzero(held).tolist())
    trees = [plain_tree(t, 1, range(len(y)), station, x, yq, asked, settings) for t in range(3)]
    assert set(got) == asked
    for i in asked:
        assert got[i] == pytest.approx(np.mean([t[i] for t in trees]), rel=1e-12)


def test_forests_are_grown_apart_and_an_untrained_one_predicts_null(spark):
    station, x, y = made(80)
    held = np.arange(80) % 5 == 0
    settings = ET.TreeSettings(trees=60, seed=1)  # two chunks of trees
    one = tree_table(spark, station, x, y, held)
    other = tree_table(spark, station, x, y + 5, held, forest=3)
    nobody = tree_table(spark, station, x, y, np.ones(80, bool), forest=9)
    got = ET.predict_forests(one.unionByName(other).unionByName(nobody), 3, settings)
    rows = {(r["forest"], r["row"]): r["yhat"] for r in got.collect()}
    assert len(rows) == 16 * 2 + 80 and all(rows[9, i] is None for i in range(80))
    for i in np.flatnonzero(held).tolist():
        assert rows[3, i] == pytest.approx(rows[0, i] + 5, abs=1e-5)
    again = ET.predict_forests(nobody.unionByName(one), 3, ET.TreeSettings(trees=2, seed=1, local_rows=0)).collect()
    assert sum(r["yhat"] is None for r in again) == 80 and len(again) == 96
    assert ET.predict_forests(one.limit(0), 3, settings).count() == 0


def test_draws_are_even_and_differ_between_nodes_features_and_trees():
    u = np.concatenate([ET.mixed(t, np.arange(1, 3_000), f, 7) / ET.PRIME for t in range(3) for f in range(3)])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12 ** -0.5) < 0.01 and len(set(u.tolist())) > 0.99 * len(u)


def test_extra_trees_repeat_whatever_the_partitions(spark):
    station, x, y = made(300)
    rows = tree_table(spark, station, x, y, np.arange(300) % 3 == 0)
    settings = ET.TreeSettings(trees=2, local_rows=40)
    first, again = ({r["row"]: r["yhat"] for r in ET.predict_forests(df, 3, settings).collect()}
                    for df in (rows, rows.repartition(7, "station").orderBy(F.desc("row"))))
    assert first == again


# --- boosting ------------------------------------------------------------------------------------

def boost_table(spark, station, x, y):
    rows = [(i, int(s), float(t), *map(float, v)) for i, (s, v, t) in enumerate(zip(station, x, y))]
    return spark.createDataFrame(rows, "row long, station long, y double, x0 double, x1 double, x2 double")


def leaves_of(tree):
    out, waiting = [], [0]
    while waiting:
        node = waiting.pop()
        if tree.feature[node] == -2:
            out.append(node)
        else:
            waiting += [tree.left[node], tree.left[node] + 1]
    return out


@pytest.mark.parametrize("settings", [
    dict(rounds=5, leaves=9, min_leaf=12, l2=0.5), dict(rounds=4, leaves=8, deepest=3, min_leaf=1, subsample=0.7),
    dict(rounds=20, leaves=5, min_leaf=5, patience=3, rate=0.5)])
def test_boosting_in_passes_equals_boosting_in_one_task(spark, monkeypatch, settings):
    monkeypatch.setattr(HB, "KEPT", 2)
    monkeypatch.setattr(HB, "ROWS_AT_A_TIME", 50)
    station, x, y = made(350)
    table = boost_table(spark, station, x, y).repartition(3)
    here, there = (HB.boosted(table, 3, HB.BoostSettings(**settings, local_rows=k)) for k in (10_000, 0))
    assert len(here.trees) == len(there.trees)
    np.testing.assert_allclose(here.predict(x, station), there.predict(x, station), rtol=1e-12)
    predictions = {r["row"]: r["yhat"] for r in HB.predict_boosted(table, 3, here).collect()}
    np.testing.assert_allclose([predictions[i] for i in range(len(y))], here.predict(x, station), rtol=1e-12)


def test_boosted_trees_keep_to_leaf_cap_leaf_size_and_depth(spark):
    station, x, y = made(500)
    settings = HB.BoostSettings(rounds=6, leaves=7, min_leaf=30, deepest=4, l2=1.0, rate=0.3)
    model = HB.boosted(boost_table(spark, station, x, y), 3, settings)
    predicted = np.full(len(y), y.mean())
    errors = [((y - predicted) ** 2).sum()]
    for tree in model.trees:
        leaves, at = leaves_of(tree), tree.nodes_of(x, station)
        assert 2 <= len(leaves) <= 7 and max(tree.depth[n] for n in leaves) <= 4
        assert set(at) == set(leaves) and min(Counter(at.tolist()).values()) >= 30
        for leaf in leaves:  # the value is rate * sum / (count + l2)
            own = at == leaf
            assert tree.value[leaf] == pytest.approx(0.3 * (y - predicted)[own].sum() / (own.sum() + 1.0), abs=1e-5)
        predicted = predicted + np.array(tree.value)[at]
        errors.append(((y - predicted) ** 2).sum())
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.4 * errors[0]


def test_leaves_are_split_best_first(spark):
    """Of all trees with one leaf more, each step takes the one with the largest gain."""
    station, x, y = made(200)
    grown = [HB.boosted(boost_table(spark, station, x, y), 3, HB.BoostSettings(rounds=1, rate=1.0, leaves=k, min_leaf=5)) for k in (2, 3, 4, 5)]
    errors = [((y - m.predict(x, station)) ** 2).sum() for m in grown]
    drops = -np.diff([((y - y.mean()) ** 2).sum(), *errors])
    assert (drops > 0).all()
    for small, large in zip(grown, grown[1:]):  # the larger tree splits one leaf of the smaller one
        pairs = set(zip(small.trees[0].nodes_of(x, station).tolist(), large.trees[0].nodes_of(x, station).tolist()))
        assert len(pairs) == len(leaves_of(large.trees[0])) == len(leaves_of(small.trees[0])) + 1


def test_boosting_of_odd_tables(spark):
    station, x, y = made(30)
    flat = HB.boosted(boost_table(spark, station, x, np.full(30, 2.5)), 3, HB.BoostSettings(rounds=3, min_leaf=2))
    assert flat.predict(x, station) == pytest.approx(np.full(30, 2.5))
    few = HB.boosted(boost_table(spark, station, x, y), 3, HB.BoostSettings(rounds=3, min_leaf=20))
    assert few.predict(x, station) == pytest.approx(np.full(30, y.mean()), abs=1e-5)  # no split leaves twenty rows on both sides
    for local_rows in (0, 100):
        empty = HB.boosted(boost_table(spark, station, x, y).limit(0), 3, HB.BoostSettings(rounds=2, local_rows=local_rows))
        assert empty.predict(x, station).tolist() == [0.0] * 30


# --- station sums --------------------------------------------------------------------------------

def station_table(spark, stations, each, seed=3):
    rng = np.random.default_rng(seed)
    level = rng.normal(size=stations) * (rng.random(stations) < 0.5)
    station = np.repeat(np.arange(stations), each)
    x = rng.normal(size=(len(station), 2))
    y = 3 + 0.8 * x[:, 0] + level[station] + 0.3 * rng.standard_t(2, size=len(station))
    rows = spark.createDataFrame([(int(s), float(a), float(b), float(t)) for s, (a, b), t in zip(station, x, y)],
                                 "station_id long, a double, b double, y double")
    return rows.repartition(4), station, x, y


def fitted_parts(model, stations):
    effects = {r["station_id"]: r["effect"] for r in model.effects.collect()}
    return np.array(model.coefficients), model.intercept, np.array([effects[s] for s in range(stations)])


def test_penalised_models_of_more_than_4000_stations_meet_the_optimality_conditions(spark):
    stations = 4_500
    rows, station, x, y = station_table(spark, stations, 4)
    penalties = [Penalty(a * ratio, a * (1 - ratio)) for a in (1e-5, 1e-4, 3e-4) for ratio in (1.0, 0.5)] + [Penalty(10.0, 0.0)]
    n = len(y)
    for p, model in zip(penalties, fit_penalised(StationSums.collect(rows, ["a", "b"]), penalties)):
        w, w0, e = fitted_parts(model, stations)
        r = y - w0 - x @ w - e[station]
        assert abs(r.sum()) < 1e-6 * n
        slope = np.r_[x.T @ r, np.bincount(station, r, minlength=stations)] / n - p.l2 * np.r_[w, e]
        coef = np.r_[w, e]
        np.testing.assert_allclose(slope[coef != 0], p.l1 * np.sign(coef[coef != 0]), atol=1e-9)
        assert (np.abs(slope[coef == 0]) <= p.l1 + 1e-9).all()
    assert w.tolist() == [0, 0] and not e.any() and w0 == pytest.approx(y.mean())  # the last penalty leaves nothing


def test_small_lasso_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(40):
        k = int(rng.integers(1, 9))
        a = rng.normal(size=(30, k + 1)) @ rng.normal(size=(k + 1, k + 1)) * 0.3
        gram, right = a.T @ a, rng.normal(size=k + 1) * 5
        l1, l2 = rng.choice([0.0, 0.5, 5.0]), rng.choice([0.0, 1.0])
        v = small_lasso(gram, right, l1, l2, rng.normal(size=k + 1) * rng.choice([0.0, 1.0]))
        slope = right - gram @ v - l2 * np.r_[v[:k], 0]
        assert abs(slope[k]) < 1e-7
        assert (np.abs(slope[:k]) <= l1 + 1e-7).all()
        np.testing.assert_allclose(slope[:k][v[:k] != 0], l1 * np.sign(v[:k][v[:k] != 0]), atol=1e-7)


def huber_objective(x, y, station, w, w0, e, scale, epsilon=1.35, alpha=1e-4):
    z = np.abs(y - w0 - x @ w - e[station]) / scale
    h = np.where(z <= epsilon, z * z, 2 * epsilon * z - epsilon * epsilon)
    return (scale + h * scale).sum() + alpha * ((w ** 2).sum() + (e ** 2).sum())


def test_huber_objective_is_not_above_mllibs(spark):
    stations = 12
    rows, station, x, y = station_table(spark, stations, 40)
    fit = fit_huber(rows, ["a", "b"])
    w, w0, e = fitted_parts(fit.model, stations)
    own = huber_objective(x, y, station, w, w0, e, fit.scale)
    vectors = station_columns(rows, ["a", "b"]).transform(rows)
    theirs = LinearRegression(loss="huber", epsilon=1.35, regParam=1e-4 / len(y), standardization=False, maxIter=1000, tol=1e-10,
                              labelCol="y").fit(vectors)
    known = {tuple(r["features"].toArray()[2:]): r["station_id"] for r in vectors.select("features", "station_id").distinct().collect()}
    other = np.zeros(stations)
    for hot, s in known.items():
        other[s] = float(np.dot(hot, theirs.coefficients.toArray()[2:]))
    assert own <= huber_objective(x, y, station, theirs.coefficients.toArray()[:2], theirs.intercept, other, theirs.scale) + 1e-6 * own
    assert fit.steps < 100


def test_huber_of_exact_rows_and_bad_settings(spark):
    rows = spark.createDataFrame([(s, float(i), 2.0 * i + s) for s in (1, 2) for i in range(6)], "station_id long, a double, y double")
    fit = fit_huber(rows, ["a"], alpha=1e-9)
    assert fit.model.coefficients[0] == pytest.approx(2, abs=1e-4)
    with pytest.raises(ValueError):
        fit_huber(rows, ["a"], epsilon=0.5)


def test_fold_sums_are_those_of_each_folds_rows(synthetic_panel):
    cfg = BacktestConfig(min_train_days=400, step_days=40)
    rows = synthetic_panel.na.drop(subset=["y_lag_7", "y_roll_mean_28"]).select("station_id", "date", "y", "y_lag_7")
    got = {(r["fold"], r["station_id"]): r for r in fold_sums(rows, cfg, ["y_lag_7"]).collect()}
    folds = fold_schedule(rows, cfg).collect()
    pdf = rows.toPandas()
    assert len(folds) >= 3 and {f for f, _ in got} == {f["fold"] for f in folds}
    for fold in folds:
        before = pdf[pdf["date"] < fold["test_start"]]
        for station, own in before.groupby("station_id"):
            r = got[fold["fold"], station]
            assert r["n"] == len(own) and r["sy"] == pytest.approx(own["y"].sum())
            assert r["s0_0"] == pytest.approx((own["y_lag_7"] ** 2).sum()) and r["s0_y"] == pytest.approx((own["y"] * own["y_lag_7"]).sum())
    trained = first_fold_trained(rows, cfg)
    assert trained.agg(F.min("since")).first()[0] == 1


@pytest.mark.parametrize("spec", [
    ModelSpec("ridge", "station_linear", {"alpha": 1.0}), ModelSpec("ols", "station_linear", {"alpha": 0.0})])
def test_backtest_of_a_linear_model_equals_one_fit_per_fold(synthetic_panel, spec):
    from stationflow.operators.folds import backtest_rows, score_folds, test_rows

    cfg, features = BacktestConfig(min_train_days=450, step_days=60), ("y_lag_7", "y_roll_mean_28")
    got = {r["fold"]: r for r in rolling_backtest(synthetic_panel, cfg, features, spec).collect()}
    rows = backtest_rows(synthetic_panel, cfg, features)
    parts = []
    tested = test_rows(rows, cfg)
    for r in tested.select("fold", "test_start").distinct().collect():
        train = rows.where(F.col("date") < F.lit(r["test_start"]))
        model = fit_station_linear(StationSums.collect(train, features), spec.params["alpha"])
        parts.append(model.predict(tested.where(F.col("fold") == r["fold"]), "y_pred"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    expected = {r["fold"]: r for r in score_folds(union, cfg).collect()}
    assert set(got) == set(expected) and len(got) >= 2
    for fold, r in expected.items():
        assert got[fold]["vol_rmse_et"] == pytest.approx(r["vol_rmse_et"], rel=1e-7)


@pytest.mark.parametrize("spec", [
    ModelSpec("lasso", "penalized", {"alpha": 1e-3, "l1_ratio": 1.0}), ModelSpec("huber", "huber", {"steps": 3}),
    ModelSpec("boost", "boosting", {"rounds": 3, "min_leaf": 5})])
def test_backtest_of_other_models(synthetic_panel, spec):
    cfg = BacktestConfig(min_train_days=450, step_days=84, parallel_fits=2)
    got = rolling_backtest(synthetic_panel, cfg, ("y_lag_7", "y_roll_mean_28"), spec).collect()
    assert len(got) >= 1 and all(r["vol_rmse_et"] > 0 for r in got)


# --- random forests ------------------------------------------------------------------------------

def plain_forest_tree(tree, rows, station, bins, yq, times, asked, settings, depth=0):
    """As ``plain_tree``, with the best edge of every feature and rows that count ``times``."""
    here = [i for i in rows if i not in asked]
    n, s = sum(times[i] for i in here), sum(times[i] * int(yq[i]) for i in here)
    best = None
    if len({int(yq[i]) for i in here}) > 1 and depth < settings.deepest:
        tries = [(lambda i, f=f, e=e: bins[i, f] <= e) for f in range(bins.shape[1]) for e in sorted({bins[i, f] for i in here})]
        tries += [(lambda i, st=st: station[i] == st) for st in sorted({int(station[i]) for i in here})]
        for left in tries:
            nl, sl = sum(times[i] for i in here if left(i)), sum(times[i] * int(yq[i]) for i in here if left(i))
            if min(nl, n - nl) < settings.min_leaf:
                continue
            gain = float(sl) * float(sl) / nl + float(s - sl) * float(s - sl) / (n - nl)
            if best is None or gain > best[0]:
                best = (gain, left)
    if best is None:
        return {i: s / n / ET.SCALE for i in rows if i in asked}
    sides = [i for i in rows if best[1](i)], [i for i in rows if not best[1](i)]
    return plain_forest_tree(tree, sides[0], station, bins, yq, times, asked, settings, depth + 1) | plain_forest_tree(
        tree, sides[1], station, bins, yq, times, asked, settings, depth + 1)


@pytest.mark.parametrize("local_rows, deepest", [(10_000, 62), (40, 62), (0, 4)])
def test_random_forest_equals_plain_trees_wherever_nodes_are_finished(spark, local_rows, deepest):
    station, x, y = made(160, stations=4)
    held = np.arange(len(y)) % 4 == 0
    settings = ET.TreeSettings(trees=2, min_leaf=2, seed=5, deepest=deepest, local_rows=local_rows, best=True, bootstrap=True)
    got = {r["row"]: r["yhat"] for r in ET.predict_forests(tree_table(spark, station, x, y, held), 3, settings).collect()}
    marks = [k / ET.BINS for k in range(1, ET.BINS)]
    edges = [np.unique([np.sort(x[~held, f])[max(1, int(np.ceil(m * (~held).sum()))) - 1] for m in marks]) for f in range(3)]
    bins = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    yq, asked = np.round(y * ET.SCALE).astype(np.int64), set(np.flatnonzero(held).tolist())
    values = []
    for t in range(2):
        times = np.where(held, 0, ET.times_drawn(t, np.arange(len(y)), 5)).tolist()
        rows = [i for i in range(len(y)) if i in asked or times[i]]
        values.append(plain_forest_tree(t, rows, station, bins, yq, times, asked, settings))
    assert set(got) == asked
    for i in asked:
        assert got[i] == pytest.approx(np.mean([v[i] for v in values]), rel=1e-12)


def test_rows_are_drawn_as_by_a_poisson_law():
    times = np.concatenate([ET.times_drawn(t, np.arange(-2_000, 20_000), 7) for t in range(5)])
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.01
