import numpy as np
import pytest

from stationflow.operators.order_statistics import grouped_quantiles, with_position

PROBS = {"q0": 0.0, "q1": 0.01, "q25": 0.25, "q50": 0.5, "third": 1 / 3, "q99": 0.99, "q100": 1.0}


def data():
    rng = np.random.default_rng(5)
    heavy = np.exp(rng.normal(0, 3, 30_000))
    hot = np.where(rng.random(30_000) < 0.4, 2.5, rng.normal(0, 1, 30_000))  # one value holds 40 %
    return {"a": heavy, "b": hot, "c": np.array([4.0]), "d": np.array([1.0, 2.0, 2.0]), "e": np.full(9_000, 7.0)}


@pytest.mark.parametrize("whole_below, broadcast_keys", [(40_000, 10_000), (20_000, 10_000), (2_500, 10_000), (2_500, 2)])
def test_exact_per_group(spark, whole_below, broadcast_keys):
    groups = data()
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), (None, 1.0)],
                               "k string, x double").repartition(6)
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "x", PROBS, whole_below=whole_below,
                                                     broadcast_keys=broadcast_keys).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_exact_over_all_rows(spark):
    values = np.concatenate(list(data().values()))
    df = spark.createDataFrame([(float(x),) for x in values], "x double").repartition(5)
    got = grouped_quantiles(df, [], "x", PROBS, whole_below=2_500).collect()
    assert len(got) == 1 and got[0]["n"] == len(values)
    for name, p in PROBS.items():
        assert got[0][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_rows_of_a_key_are_not_gathered(spark):
    df = spark.range(60_000).selectExpr("cast(id % 2 AS int) AS k", "sqrt(id) AS x")
    plan = grouped_quantiles(df, ["k"], "x", {"m": 0.5}, whole_below=2_500)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    text = text[:text.index("== Initial Plan ==")]
    # Rows meet their edges by broadcast and are counted by value before any shuffle on the key.
    assert "SortMergeJoin" not in text and "BuildLeft" not in text and "ReusedExchange" in text


def test_no_rows_give_no_quantiles(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert grouped_quantiles(df, ["k"], "x", {"m": 0.5}).isEmpty()


def test_global_position(spark):
    df = spark.range(5_000).selectExpr("(id * 7919) % 50 AS v", "id").repartition(7)
    rows = with_position(df, ["v", "id"]).collect()
    expected = {r["id"]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r["v"], r["id"])))}
    assert {r["id"]: r["position"] for r in rows} == expected
    assert {r["n_total"] for r in rows} == {5_000}


def test_sketches_merge_and_keep_their_rank_error(spark):

    from stationflow.operators.sketches import merged_sketches, quantile_sketches, sketch_quantiles

    groups = data()
    rows = [(k, i % 13, float(x)) for k, v in groups.items() for i, x in enumerate(v)] + [("a", 1, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, day int, x double").repartition(6)
    for size, error in ((200, 0.03), (4096, 0.002)):
        daily = quantile_sketches(df, ["k", "day"], "x", size)
        assert daily.count() == sum(min(13, len(v)) for v in groups.values())
        got = {r["k"]: r for r in sketch_quantiles(merged_sketches(daily, ["k"], size), ["k"], PROBS).collect()}
        assert set(got) == set(groups)
        for k, values in groups.items():
            assert got[k]["n"] == len(values)
            for name, p in PROBS.items():
                low, high = (values < got[k][name]).mean(), (values <= got[k][name]).mean()
                slack = error if len(values) >= size else 1 / len(values)
                assert low - slack <= p <= high + slack and got[k][name] in values
