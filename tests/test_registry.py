import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.01"
TABLES = "nation supplier lineitem".split()
NO_SQL = {"bakeoff_linear", "bakeoff_trees", "predict_extra_trees_like", "predict_extra_trees", "backtest_model"}


def test_every_query_but_fitted_models_has_a_twin():
    assert set(entry_points.REGISTRY) - set(entry_points.oracle_sql()) == NO_SQL
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.count() == 98 and df.columns[0] == "station_id" and df.columns[-1] == "split"


def comparable(pdf: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return None
        if isinstance(v, (bool, str)):
            return str(v)
        return str(v)[:10] if hasattr(v, "year") else f"{float(v):.6f}"

    return sorted((tuple(cell(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [
    "station_day_text", "eligibility_stats_by_region", "panel_features", "baseline_comparison", "backtest_summary",
    "knn_exact", "dow_profile", "improvement_trend", "win_rate", "direction_day_dates", "station_day_loaded",
    "valid_day_flags", "finite_values", "ridge_scores", "comparison_ranked", "backtest_gap_fold",
    "backtest_summary_stated", "ratio_to_baseline_weekly_many", "dow_profile_many", "extra_trees_scores", "extra_trees_levels_scores", "random_forest_scores",
    "random_forest_levels_scores",
    "backtest_extra_trees", "hist_boosting_scores", "hist_boosting_passes_scores", "gradient_boosting_scores", "lasso_scores",
    "ratio_weekly_sketched", "week_quantiles_banded", "elastic_net_scores", "huber_scores", "backtest_ridge",
])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(entry_points.oracle_sql()[name]).df()
    got = entry_points.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns) and len(got) == len(expected) > 0
    assert comparable(got) == comparable(expected)
