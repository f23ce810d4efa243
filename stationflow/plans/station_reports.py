"""Report tables that need only the station-day table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.config import MartConfig, PanelConfig
from stationflow.functions.calendar import between_dates, week_ending_sunday, weekday_name
from stationflow.functions.cleaning import drop_incomplete, with_valid_day
from stationflow.lineage import settle
from stationflow.operators.eligibility import days_in_window, only_eligible
from stationflow.operators.order_statistics import grouped_quantiles
from stationflow.operators.sketches import K, merged_sketches, quantile_sketches, sketch_quantiles


def _trailing(order: str, rows: int) -> Window:
    """Last ``rows`` rows of a table with one row per week; it needs no partition key."""
    return Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-(rows - 1), 0)


def ratio_to_baseline(days: DataFrame, cfg: PanelConfig, report: MartConfig) -> DataFrame:
    """Valid days from the baseline year on, as a ratio to the station's median in that year.

    Eligibility and the baseline median are both windows over the station: one shuffle. The median
    is over at most 366 rows.
    """
    in_baseline = F.year("date") == report.baseline_year
    baseline = F.median(F.when(in_baseline, F.col("station_volume"))).over(Window.partitionBy("station_id"))
    return (
        only_eligible(with_valid_day(days), cfg)
        .where(F.col("valid_day") & (F.col("date") >= F.make_date(F.lit(report.baseline_year), F.lit(1), F.lit(1))))
        .withColumn("baseline", baseline)
        .where(F.col("baseline").isNotNull())
        .select(
            "station_id", "date", week_ending_sunday(F.col("date")).alias("week_ending"),
            F.try_divide(F.col("station_volume"), F.col("baseline")).alias("ratio"),
        )
    )


def ratio_to_baseline_weekly(days: DataFrame, cfg: PanelConfig, report: MartConfig) -> DataFrame:
    """Weekly median and quartiles of the ratio, and the 13-week deviation of the median.

    A week holds seven rows per station, so its quantiles are spread over tasks.
    """
    ratios = settle(ratio_to_baseline(days, cfg, report).select("week_ending", "ratio"))
    weekly = grouped_quantiles(ratios, ["week_ending"], "ratio", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    frame = _trailing("week_ending", 13)
    deviation = F.when(F.count("median").over(frame) >= 8, F.stddev_samp("median").over(frame))
    return weekly.withColumn("median_roll_std_13w", deviation).drop("n")


def daily_ratio_sketches(days: DataFrame, cfg: PanelConfig, report: MartConfig, k: int = K) -> DataFrame:
    """date, week_ending, sketch, n: the ratios of a day as a sketch, to be kept and merged by whatever period is asked for."""
    return quantile_sketches(ratio_to_baseline(days, cfg, report), ["date", "week_ending"], "ratio", k)


def ratio_weekly_sketched(daily: DataFrame, k: int = K) -> DataFrame:
    """As ``ratio_to_baseline_weekly``, from daily sketches: ranks are off by a small share of the rows (see ``sketches``)."""
    weekly = sketch_quantiles(merged_sketches(daily, ["week_ending"], k), ["week_ending"], {"median": 0.5, "q25": 0.25, "q75": 0.75})
    frame = _trailing("week_ending", 13)
    deviation = F.when(F.count("median").over(frame) >= 8, F.stddev_samp("median").over(frame))
    return weekly.withColumn("median_roll_std_13w", deviation)


def volatility_change(weekly: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Median 13-week deviation before and after the window start, and its reduction in percent."""
    before = F.col("week_ending") < F.lit(cfg.window_start)
    moved = weekly.agg(
        F.median(F.when(before, F.col("median_roll_std_13w"))).alias("pre_median"),
        F.median(F.when(~before, F.col("median_roll_std_13w"))).alias("post_median"),
    )
    ratio = F.try_divide(F.col("post_median"), F.col("pre_median"))
    return moved.withColumn("reduction_pct", 100.0 * (1.0 - ratio))


def eligible_days(days: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Valid days of eligible stations inside the window."""
    return only_eligible(days_in_window(with_valid_day(days), cfg), cfg)


def daily_totals(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """System totals per date with the number of reporting stations; ``sums`` maps name to column."""
    return rows.groupBy("date").agg(
        *[F.sum(c).alias(name) for name, c in sums.items()],
        F.count_distinct("station_id").alias("active_stations"),
    )


def weekly_totals(daily: DataFrame, sums: list[str]) -> DataFrame:
    """Weeks ending on Sunday with at least six days; the table has one row per date before."""
    return (
        daily.groupBy(week_ending_sunday(F.col("date")).alias("week_ending"))
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.median("active_stations").alias("active_stations"),
            F.count(sums[0]).alias("n_days"),
        )
        .where(F.col("n_days") >= 6)
    )


def system_weekly(days: DataFrame, cfg: PanelConfig) -> DataFrame:
    daily = daily_totals(eligible_days(days, cfg), {"total_volume": "station_volume"})
    weekly = weekly_totals(daily, ["total_volume"]).withColumn(
        "vol_per_station", F.try_divide(F.col("total_volume"), F.col("active_stations"))
    )
    frame = _trailing("week_ending", 8)
    return weekly.withColumns({
        "vps_ma8": F.avg("vol_per_station").over(frame),
        "stations_ma8": F.avg("active_stations").over(frame),
    })


def period_flags(weekly: DataFrame, cfg: PanelConfig, report: MartConfig) -> DataFrame:
    """Whether the window start lies inside the plotted weeks, and the period to shade before it."""
    marker = F.lit(cfg.window_start)
    return (
        weekly.agg(F.min("week_ending").alias("first_week"), F.max("week_ending").alias("last_week"))
        .select(
            "first_week", "last_week",
            ((F.col("first_week") < marker) & (marker < F.col("last_week"))).alias("show_marker"),
            F.greatest(F.lit(report.shade_from), F.col("first_week")).alias("shade_start"),
            F.least(marker, F.col("last_week")).alias("shade_end"),
        )
        .withColumn("do_shade", F.col("shade_start") < F.col("shade_end"))
    )


def winsorized_ratio(days: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Volume over the station's median, clipped at the 1 % and 99 % quantiles of all rows."""
    station_median = F.median("station_volume").over(Window.partitionBy("station_id"))
    kept = eligible_days(days, cfg).where(F.col("station_volume").isNotNull())
    ratios = settle(
        kept.withColumn("station_median", station_median).select(
            "station_id", F.weekday("date").alias("dow"),
            F.try_divide(F.col("station_volume"), F.col("station_median")).alias("ratio"),
        )
    )
    bounds = grouped_quantiles(ratios, [], "ratio", {"lo": 0.01, "hi": 0.99})
    bounds = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
    return ratios.withColumn("b", bounds).select(
        "station_id", "dow", "ratio", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"),
        F.least(F.greatest("ratio", F.col("b.lo")), F.col("b.hi")).alias("ratio_w"),
    )


def station_by_weekday(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("station_id", "dow").agg(F.avg("ratio_w").alias("mean_ratio"))


def dow_profile(days: DataFrame, cfg: PanelConfig, ratios: DataFrame | None = None) -> DataFrame:
    """Quartiles over stations of the mean winsorized ratio, per day of week; ``ratios`` if they are at hand."""
    means = settle(station_by_weekday(winsorized_ratio(days, cfg) if ratios is None else ratios))
    profile = grouped_quantiles(means, ["dow"], "mean_ratio", {"p25": 0.25, "med": 0.5, "p75": 0.75})
    return profile.select("dow", weekday_name(F.col("dow")).alias("dow_name"), "p25", "med", "p75")


def weekpart_by_station(days: DataFrame, cfg: PanelConfig, ratios: DataFrame | None = None) -> DataFrame:
    """Mean winsorized ratio on weekdays and on weekends, for stations that have both; ``ratios`` if they are at hand."""
    weekend = F.col("dow") >= 5
    means = (winsorized_ratio(days, cfg) if ratios is None else ratios).groupBy("station_id").agg(
        F.avg(F.when(~weekend, F.col("ratio_w"))).alias("weekday_mean"),
        F.avg(F.when(weekend, F.col("ratio_w"))).alias("weekend_mean"),
    )
    return drop_incomplete(means, ["weekday_mean", "weekend_mean"]).where(F.col("weekday_mean") > 0)


def weekpart_summary(weekparts: DataFrame) -> DataFrame:
    """Distribution of the station means per part of the week."""
    long = settle(weekparts.select(F.explode(F.array(
        F.struct(F.lit("weekday").alias("weekpart"), F.col("weekday_mean").alias("mean_ratio")),
        F.struct(F.lit("weekend").alias("weekpart"), F.col("weekend_mean").alias("mean_ratio")),
    )).alias("p")).select("p.*"))
    quartiles = grouped_quantiles(long, ["weekpart"], "mean_ratio", {"q25": 0.25, "med": 0.5, "q75": 0.75})
    spread = long.groupBy("weekpart").agg(
        F.min("mean_ratio").alias("low"), F.avg("mean_ratio").alias("mean"), F.max("mean_ratio").alias("high")
    )
    return quartiles.join(spread, "weekpart")
