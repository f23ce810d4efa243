"""Report tables that need predictions or a backtest table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions import metrics as M
from stationflow.functions.cleaning import as_date, drop_incomplete
from stationflow.lineage import settle
from stationflow.operators.order_statistics import grouped_quantiles, with_position
from stationflow.operators.predictions import test_predictions
from stationflow.plans.station_reports import _trailing, daily_totals, weekly_totals

# Tier names from small to large, histogram and trend bin counts.
TIERS = ("low", "mid", "high")
HISTOGRAM_BINS = 30
TREND_BINS = 8


def station_improvement(predictions: DataFrame) -> DataFrame:
    """Test error of baseline and model per station, on the volume scale."""
    true = F.col("vol_true")
    scored = test_predictions(predictions).where(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        M.smape(true, F.col("vol_base")).alias("smape_base"),
        M.smape(true, F.col("vol_pred")).alias("smape_et"),
        F.avg(true).alias("mean_volume"),
    )
    return scored.withColumn("delta_smape_pp", F.col("smape_base") - F.col("smape_et"))


def improvement_share(improvement: DataFrame) -> DataFrame:
    better = F.when(F.col("delta_smape_pp") > 0, 1.0).otherwise(0.0)
    return improvement.agg(
        (100.0 * F.avg(better)).alias("improved_pct"), F.count(F.lit(1)).alias("n_stations")
    )


def improvement_histogram(improvement: DataFrame) -> DataFrame:
    """Equal-width bins over the range of the improvement; the top edge belongs to the last bin."""
    deltas = improvement.where(F.col("delta_smape_pp").isNotNull())
    span = deltas.agg(F.min("delta_smape_pp").alias("lo"), F.max("delta_smape_pp").alias("hi"))
    span = span.select(F.struct("lo", "hi").alias("s")).scalar()
    width = (F.col("s.hi") - F.col("s.lo")) / HISTOGRAM_BINS
    at = F.floor(F.try_divide(F.col("delta_smape_pp") - F.col("s.lo"), width))
    # With a single value there is no width and no bin edge: all stations share the first bin.
    bin_no = F.least(F.coalesce(at, F.lit(0)), F.lit(HISTOGRAM_BINS - 1)).cast("int") + 1
    counts = deltas.withColumn("s", span).groupBy(bin_no.alias("bin"), "s").agg(F.count(F.lit(1)).alias("n_stations"))
    return counts.select(
        "bin",
        (F.col("s.lo") + width * (F.col("bin") - 1)).alias("bin_from"),
        (F.col("s.lo") + width * F.col("bin")).alias("bin_to"),
        "n_stations",
    )


def improvement_tiers(improvement: DataFrame) -> DataFrame:
    """Stations with their volume tier, log volume and right-closed volume bin.

    ``improvement`` should be settled: its quantile edges are read from it several times.
    """
    base = drop_incomplete(improvement, ["mean_volume", "delta_smape_pp"]).withColumn(
        "log_mean_vol", F.log10(F.greatest(F.col("mean_volume"), F.lit(1.0)))
    )
    thirds = grouped_quantiles(base, [], "mean_volume", {"t1": 1 / 3, "t2": 2 / 3})
    thirds = thirds.select(F.struct("t1", "t2").alias("t")).scalar()
    cuts = {f"e{i}": i / TREND_BINS for i in range(TREND_BINS + 1)}
    edges = grouped_quantiles(base, [], "log_mean_vol", cuts)
    edges = edges.select(F.array_distinct(F.array(*cuts)).alias("e")).scalar()
    # Right-closed bins with the lowest value included; repeated edges count once.
    below = F.size(F.filter("e", lambda x: x < F.col("log_mean_vol")))
    return (
        base.withColumn("t", thirds).withColumn("e", edges)
        .withColumn("tier", _tier(F.col("mean_volume"), F.col("t.t1"), F.col("t.t2")))
        .withColumn("qbin", F.when(F.size("e") > 1, F.greatest(below, F.lit(1))))
        .drop("t", "e")
    )


def _tier(volume: Column, first: Column, second: Column) -> Column:
    low, mid, high = TIERS
    return F.when(volume <= first, low).when(volume <= second, mid).otherwise(high)


def improvement_trend(tiers: DataFrame) -> DataFrame:
    """Median volume and quartiles of the improvement per volume bin."""
    quartiles = {"q25": 0.25, "med": 0.5, "q75": 0.75}
    level = grouped_quantiles(tiers, ["qbin"], "log_mean_vol", {"logx": 0.5}).drop("n")
    gain = grouped_quantiles(tiers, ["qbin"], "delta_smape_pp", quartiles)
    return level.join(gain, "qbin").withColumn("x", F.pow(F.lit(10.0), F.col("logx")))


def tier_summary(tiers: DataFrame) -> DataFrame:
    """Box statistics of the improvement per tier."""
    boxes = grouped_quantiles(tiers, ["tier"], "delta_smape_pp", {"q25": 0.25, "med": 0.5, "q75": 0.75})
    ends = tiers.groupBy("tier").agg(
        F.min("delta_smape_pp").alias("low"), F.max("delta_smape_pp").alias("high")
    )
    return boxes.join(ends, "tier")


def improvement_axis(improvement: DataFrame) -> DataFrame:
    """Axis range: half a point beyond the improvements, and always across zero."""
    return improvement.agg(
        (F.least(F.min("delta_smape_pp"), F.lit(0.0)) - 0.5).alias("y_min"),
        (F.greatest(F.max("delta_smape_pp"), F.lit(0.0)) + 0.5).alias("y_max"),
    )


def example_stations(predictions: DataFrame) -> DataFrame:
    """Six slots: the two smallest, two middle and two largest stations by mean test volume.

    With fewer than six stations one station may fill several slots.
    """
    means = test_predictions(predictions).where(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        F.avg("vol_true").alias("mean_vol")
    )
    ranked = with_position(means, ["mean_vol", "station_id"])
    at, n = F.col("position"), F.col("n_total")
    half = F.floor(n / 2)
    names = {"low_1": at == 1, "low_2": at == 2, "mid_1": at == half, "mid_2": at == half + 1,
             "high_1": at == n - 1, "high_2": at == n}
    slots = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in names.items()]))
    return ranked.select("station_id", "mean_vol", F.explode(slots).alias("slot"))


def example_forecasts(predictions: DataFrame, slots: DataFrame) -> DataFrame:
    """Last 91 calendar days of the chosen stations: actual, model and baseline volume."""
    test = test_predictions(predictions)
    last = test.select(F.max("date")).scalar()
    recent = test.where(F.col("date") >= F.date_sub(last, 90))
    # Six rows at most.
    return recent.join(F.broadcast(slots.select("station_id", "slot")), "station_id").select(
        "slot", "station_id", "date", "vol_true", "vol_pred", "vol_base"
    )


def win_rate(examples: DataFrame) -> DataFrame:
    """Errors, improvement and share of days won by the model, per example slot."""
    true, pred, base = F.col("vol_true"), F.col("vol_pred"), F.col("vol_base")
    wins = M.symmetric_percentage_error(true, pred) < M.symmetric_percentage_error(true, base)
    scored = examples.groupBy("slot", "station_id").agg(
        M.smape(true, base).alias("smape_base"),
        M.smape(true, pred).alias("smape_et"),
        F.avg(F.when(wins, 1.0).otherwise(0.0)).alias("win_rate"),
        F.count(F.lit(1)).alias("n_days"),
    )
    return scored.withColumn("delta_smape_pp", F.col("smape_base") - F.col("smape_et"))


def system_total_forecast_weekly(predictions: DataFrame) -> DataFrame:
    """Weekly totals of actual, model and, where present, baseline volume, with 8-week means."""
    test = drop_incomplete(test_predictions(predictions), ["date", "station_id", "vol_true", "vol_pred"])
    sums = {"true_total": "vol_true", "pred_total": "vol_pred"}
    if "vol_base" in predictions.columns:
        sums["base_total"] = "vol_base"
    weekly = weekly_totals(daily_totals(test, sums), list(sums))
    frame = _trailing("week_ending", 8)
    return weekly.withColumns({
        name.replace("_total", "_ma8"): F.avg(name).over(frame) for name in sums
    })


def backtest_deltas(backtest: DataFrame) -> DataFrame:
    """Fold table with a readable start date."""
    return backtest.withColumn("test_start", as_date(backtest, "test_start")).where(
        F.col("test_start").isNotNull()
    )


def backtest_summary(backtest: DataFrame) -> DataFrame:
    """One row: spread of the improvement, most volatile fold, horizon and step of the schedule.

    A fold table has one row per fold, so its first rows and exact median are small aggregates.
    Where two folds share the highest baseline error the earlier one counts. ``horizon_days`` and
    ``step_days`` of the table's first fold win over what the dates say; a table without
    ``vol_smape_base`` has no most volatile fold.
    """
    folds = backtest_deltas(backtest)
    if "vol_smape_base" not in folds.columns:
        folds = folds.withColumn("vol_smape_base", F.lit(None).cast("double"))
    stated = {
        c: F.col(c).cast("int") if c in folds.columns else F.lit(None).cast("int") for c in ("horizon_days", "step_days")}
    gain = F.col("vol_smape_improve_pp").cast("double")
    start, end = F.col("test_start"), as_date(folds, "test_end")
    starts = F.slice(F.array_sort(F.collect_list(start)), 1, 2)
    known = F.col("vol_smape_base").isNotNull()
    worst = F.max_by(
        F.when(known, F.struct("fold", start.alias("start"), end.alias("end"))),
        F.when(known, F.struct("vol_smape_base", (-F.unix_date(start)).alias("earlier"))),
    )
    return folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(gain).alias("mean_improve_pp"),
        F.median(gain).alias("median_improve_pp"),
        F.min(gain).alias("min_improve_pp"),
        F.max(gain).alias("max_improve_pp"),
        F.every(gain > 0).alias("all_improved"),
        worst.alias("worst"),
        F.min_by(F.coalesce(stated["horizon_days"], F.datediff(end, start) + 1), start).alias("horizon_days"),
        F.min_by(stated["step_days"], start).alias("stated_step"),
        starts.alias("starts"),
    ).select(
        "n_folds", "mean_improve_pp", "median_improve_pp", "min_improve_pp", "max_improve_pp", "all_improved",
        F.col("worst.fold").alias("volatile_fold"), F.col("worst.start").alias("volatile_start"),
        F.col("worst.end").alias("volatile_end"),
        "horizon_days",
        F.coalesce(
            "stated_step", F.datediff(F.get("starts", F.lit(1)), F.get("starts", F.lit(0)))).alias("step_days"),
        (F.col("max_improve_pp") + 0.75).alias("y_upper"),
    )
