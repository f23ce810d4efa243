"""Which stations have enough usable days in the modelling window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.config import PanelConfig
from stationflow.functions.calendar import between_dates
from stationflow.schemas import YEAR_FOLDER


def days_in_window(days: DataFrame, cfg: PanelConfig, require_valid: bool = True) -> DataFrame:
    """Rows inside the window, and only usable ones where the table says which are."""
    kept = days.where(between_dates(F.col("date"), cfg.window_start, cfg.window_end))
    if YEAR_FOLDER in days.columns:  # lets the scan skip whole folders of the written table
        kept = kept.where(F.col(YEAR_FOLDER).between(cfg.window_start.year, cfg.window_end.year))
    if require_valid and "valid_day" in days.columns:
        kept = kept.where("valid_day")
    return kept.where(F.col("station_id").isNotNull())


def eligibility_stats(days: DataFrame, cfg: PanelConfig, require_valid: bool = True) -> DataFrame:
    """Day counts, coverage and the three eligibility flags, one row per station."""
    stats = days_in_window(days, cfg, require_valid).groupBy("station_id").agg(
        F.count_distinct("date").alias("valid_days"),
        F.avg("station_volume").alias("mean_volume"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )
    return stats.withColumn("coverage", F.col("valid_days") / F.lit(cfg.expected_days)).withColumns({
        "eligible_cov": F.col("coverage") >= F.lit(cfg.coverage_threshold),
        "eligible_days": F.col("valid_days") >= F.lit(cfg.min_valid_days),
    }).withColumn("eligible", F.col("eligible_cov") & F.col("eligible_days"))


def eligible_stations(days: DataFrame, cfg: PanelConfig, require_valid: bool = True) -> DataFrame:
    """Station numbers only. A table, not a list: it grows with the number of stations."""
    return eligibility_stats(days, cfg, require_valid).where("eligible").select("station_id")


def only_eligible(days: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Rows of eligible stations, all dates kept.

    The flags are window aggregates over the station partitioning that later feature and median
    windows need anyway: one shuffle serves all of them, and nothing is joined or broadcast.
    """
    usable = between_dates(F.col("date"), cfg.window_start, cfg.window_end)
    if "valid_day" in days.columns:
        usable = usable & F.col("valid_day")
    by_day = Window.partitionBy("station_id").orderBy("day_no")
    station = Window.partitionBy("station_id")
    usable_day = F.when(usable, F.col("day_no"))
    # Highest usable day up to the row before: the row opens a new day if its own day is later.
    seen = F.max("usable_day").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    return (
        days.where(F.col("station_id").isNotNull() & F.col("date").isNotNull())
        .withColumn("day_no", F.unix_date("date"))
        .withColumn("usable_day", usable_day)
        .withColumn("opens", (F.col("usable_day") > F.coalesce(seen, F.lit(-(2**31)))).cast("int"))
        .withColumn("n_usable", F.coalesce(F.sum("opens").over(station), F.lit(0)))
        .where(
            (F.col("n_usable") >= F.lit(cfg.min_valid_days))
            & (F.col("n_usable") / F.lit(cfg.expected_days) >= F.lit(cfg.coverage_threshold))
        )
        .drop("usable_day", "opens", "n_usable")
    )
