"""Hourly lane counts -> lane totals -> direction-day totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.functions.cleaning import DATE_FORMATS, as_date, as_long, dtype_of, require_columns, sum_present
from stationflow.schemas import HOUR_COLUMNS, HOURLY_KEYS

DIR_DAY_KEYS = ["station_id", "date", "dir_of_travel"]


def lane_totals(hourly: DataFrame, where: str = "hourly input", formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """One total per input row: sum of the hours present, NULL when none is.

    Values that cannot be read become NULL; rows whose date cannot be read go.
    """
    require_columns(hourly, HOURLY_KEYS + HOUR_COLUMNS, where)
    day = as_date(hourly, "date", formats)
    if isinstance(dtype_of(hourly, "date"), T.StringType):
        # Rows without a day go by way of an empty array: a filter would move below the projection and read each text,
        # and whatever it is made of, a second time in all formats.
        day = F.explode(F.array_compact(F.array(day)))
    return hourly.select(
        as_long(hourly, "station_id").alias("station_id"),
        as_long(hourly, "dir_of_travel").alias("dir_of_travel"),
        as_long(hourly, "lane_of_travel").alias("lane_of_travel"),
        day.alias("date"),
        sum_present(hourly, HOUR_COLUMNS).alias("lane_total"),
    ).where(F.col("date").isNotNull())


def year_span(hourly: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Smallest and largest year over every readable date, before any other filter."""
    day = as_date(hourly, "date", formats)
    return hourly.agg(F.year(F.min(day)).alias("min_year"), F.year(F.max(day)).alias("max_year"))


def source_facts(hourly: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> list[Column]:
    """What is to be known of hourly rows: their number, how many dates are unreadable, first and last year."""
    day = as_date(hourly, "date", formats)
    return [F.count(F.lit(1)).alias("rows"), F.count(F.when(day.isNull(), 1)).alias("unreadable_dates"),
            F.year(F.min(day)).alias("min_year"), F.year(F.max(day)).alias("max_year")]


def observed(hourly: DataFrame, facts: Sequence[Column], write: Callable[[DataFrame], None]) -> dict:
    """``facts`` of the rows, taken while ``write`` reads them for its own ends."""
    watch = Observation()
    write(hourly.observe(watch, *facts))
    try:
        return watch.get
    except Py4JJavaError:  # a plan that turns out empty is dropped while it runs, and what it observed with it
        return hourly.agg(*facts).first().asDict()


def direction_day(lanes: DataFrame) -> DataFrame:
    """Volume per station, date and direction.

    Rows with an empty key form no group. A group without any value counts as zero. The sum is
    combined in every map task first, so a key that holds most of the rows costs one row per task.
    """
    return (
        lanes.na.drop(subset=DIR_DAY_KEYS)
        .groupBy(*DIR_DAY_KEYS)
        .agg(F.coalesce(F.sum("lane_total"), F.lit(0.0)).alias("vol_dir"))
    )
