"""Daily feature panel: calendar, lag and rolling features of log volume, without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.config import PanelConfig
from stationflow.functions.calendar import annual_cycle, split_label
from stationflow.operators.eligibility import days_in_window, only_eligible


def calendar_grid(stations: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Every station on every day of the window; the dates are a literal array, not a join."""
    dates = F.sequence(F.lit(cfg.window_start), F.lit(cfg.window_end), F.expr("interval 1 day"))
    return stations.select("station_id", F.explode(dates).alias("date"))


def with_calendar(df: DataFrame) -> DataFrame:
    sin_doy, cos_doy = annual_cycle(F.col("dayofyear"))
    return (
        df.withColumns({
            "dow": F.weekday("date"),
            "month": F.month("date"),
            "year": F.year("date"),
            "dayofyear": F.dayofyear("date"),
        })
        .withColumns({"sin_doy": sin_doy, "cos_doy": cos_doy})
    )


def with_history(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Lags and rolling statistics by calendar distance.

    Days without a row are simply absent: a range frame on the day number sees the same values as
    a shift on a gap-filled calendar, and all frames share one sort of one station partitioning.
    Needs ``y`` and ``day_no``. Two rows for one day of a station are an error: neither could be told to be its value.
    """
    by_day = Window.partitionBy("station_id").orderBy("day_no")
    alone = F.count(F.lit(1)).over(by_day.rangeBetween(0, 0)) == 1
    twice = F.raise_error(F.format_string("station %s has more than one row for %s", F.col("station_id"), F.col("date").cast("string"))).cast("double")
    out = df.withColumns({
        "y": F.when(alone, F.col("y")).otherwise(twice),
        **{f"y_lag_{k}": F.max("y").over(by_day.rangeBetween(-k, -k)) for k in cfg.lag_days},
    })
    for w in cfg.roll_windows:
        frame = by_day.rangeBetween(-w, -1)
        enough = F.count("y").over(frame) >= max(2, w // 3)
        out = out.withColumns({
            f"y_roll_mean_{w}": F.when(enough, F.avg("y").over(frame)),
            f"y_roll_std_{w}": F.when(enough, F.stddev_samp("y").over(frame)),
        })
    return out


def with_history_flags(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    flags = {f"has_y_lag_{k}": F.col(f"y_lag_{k}").isNotNull().cast("int") for k in cfg.lag_days}
    flags |= {f"has_y_roll_{w}": F.col(f"y_roll_mean_{w}").isNotNull().cast("int") for w in cfg.roll_windows}
    return df.withColumns(flags)


def panel_columns(cfg: PanelConfig) -> list[str]:
    rolls = [f"y_roll_{s}_{w}" for w in cfg.roll_windows for s in ("mean", "std")]
    return [
        "station_id", "date", "station_volume", "y",
        "dow", "month", "year", "dayofyear", "sin_doy", "cos_doy",
        *[f"y_lag_{k}" for k in cfg.lag_days], *rolls,
        *[f"has_y_lag_{k}" for k in cfg.lag_days], *[f"has_y_roll_{w}" for w in cfg.roll_windows],
        "split",
    ]


def log_series(days: DataFrame, cfg: PanelConfig, stations: DataFrame | None = None) -> DataFrame:
    """Usable days of the chosen stations with ``y`` = log1p(volume) and the day number.

    ``stations`` is a table of station numbers; without it the eligible ones are found in the same
    pass. The membership join carries no hint: Spark measures the side before it broadcasts it.
    """
    kept = days_in_window(days, cfg)
    if stations is None:
        kept = only_eligible(kept, cfg)
    else:
        kept = kept.join(stations.select("station_id"), "station_id", "left_semi")
    return kept.select(
        "station_id", "date", F.unix_date("date").alias("day_no"), "station_volume",
        F.log1p("station_volume").alias("y"),
    )


def build_panel(days: DataFrame, cfg: PanelConfig, stations: DataFrame | None = None) -> DataFrame:
    """Model rows: days with a value today and seven days ago, labelled train, val or test."""
    rows = with_history(log_series(days, cfg, stations), cfg)
    rows = rows.where(F.col("y").isNotNull() & F.col("y_lag_7").isNotNull())
    rows = with_history_flags(with_calendar(rows), cfg)
    return rows.withColumn("split", split_label(F.col("date"), cfg.train_end, cfg.val_end)).select(
        *panel_columns(cfg)
    )


def build_panel_on_grid(days: DataFrame, cfg: PanelConfig, stations: DataFrame) -> DataFrame:
    """Same table by way of the gap-filled calendar; kept as a twin to test ``build_panel``."""
    observed = days_in_window(days, cfg).select("station_id", "date", "station_volume")
    grid = calendar_grid(stations, cfg).join(observed, ["station_id", "date"], "left")
    grid = grid.withColumn("y", F.log1p("station_volume"))
    by_day = Window.partitionBy("station_id").orderBy("date")
    out = grid.withColumns({f"y_lag_{k}": F.lag("y", k).over(by_day) for k in cfg.lag_days})
    for w in cfg.roll_windows:
        frame = by_day.rowsBetween(-w, -1)
        enough = F.count("y").over(frame) >= max(2, w // 3)
        out = out.withColumns({
            f"y_roll_mean_{w}": F.when(enough, F.avg("y").over(frame)),
            f"y_roll_std_{w}": F.when(enough, F.stddev_samp("y").over(frame)),
        })
    out = with_history_flags(with_calendar(out), cfg)
    out = out.where(F.col("y").isNotNull() & F.col("y_lag_7").isNotNull())
    return out.withColumn("split", split_label(F.col("date"), cfg.train_end, cfg.val_end)).select(
        *panel_columns(cfg)
    )
