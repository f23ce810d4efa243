"""Sensor-shaped inputs derived from the order tables: whole tables, no sampling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.config import MartConfig, PanelConfig
from stationflow.schemas import HOURLY_KEYS

# Dates that fit the order tables.
WINDOW = PanelConfig(
    window_start=date(1998, 1, 1), window_end=date(2001, 6, 30),
    train_end=date(2000, 6, 30), val_end=date(2000, 12, 31),
    coverage_threshold=0.80, min_valid_days=730,
)
REPORT = MartConfig(
    baseline_year=1997, shade_from=date(1997, 3, 1), coverage_year_start=1997, coverage_year_end=2001,
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_lane(
    spark: SparkSession, sf_dir: str, station: Column | None = None, direction: Column | None = None,
    by_region: bool = False, many: bool = False,
) -> DataFrame:
    """Hourly lane counts from ``lineitem``: quantities summed into 24 hour columns.

    ``by_region`` makes the supplier's region the station; the region of a supplier is looked up
    through two joins that Spark broadcasts when it finds their side small.

    ``many`` is for stations so many that few order lines share a row: they are summed by hour in narrow rows, and the
    24 columns are laid out of those of a row, at most one per hour, so that no task keeps wide sums of all its rows.
    The number of partitions is stated for the reason given in ``station_day``.
    """
    items = read_table(spark, sf_dir, "lineitem")
    if by_region:
        supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        items = items.join(supplier, items.l_suppkey == supplier.s_suppkey).join(
            nation, F.col("s_nationkey") == nation.n_nationkey
        )
        station = F.col("n_regionkey").cast("long")
    elif station is None:
        station = F.col("l_suppkey") % 5
    if direction is None:
        direction = F.when(F.col("l_linestatus") == "O", 1).otherwise(2)
    hour = F.col("l_orderkey") % 24 + 1
    keys = [
        station.alias("station_id"),
        direction.cast("long").alias("dir_of_travel"),
        F.col("l_linenumber").cast("long").alias("lane_of_travel"),
        F.col("l_shipdate").cast("date").alias("date"),
    ]
    if not many:
        return items.groupBy(*keys).agg(*[F.sum(F.when(hour == h, F.col("l_quantity"))).alias(str(h)) for h in range(1, 25)])
    hours = items.groupBy(*keys, hour.alias("hour")).agg(F.sum("l_quantity").alias("count"))
    hours = hours.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *HOURLY_KEYS)
    row = Window.partitionBy(*HOURLY_KEYS)
    return hours.select(
        *HOURLY_KEYS, F.col("hour").eqNullSafe(F.min("hour").over(row)).alias("first"),
        *[F.max(F.when(F.col("hour") == h, F.col("count"))).over(row).alias(str(h)) for h in range(1, 25)],
    ).where("first").drop("first")


def three_directions() -> Column:
    return (
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    )


def hourly_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text row per order line, as an outside file would hold it: some keys empty, some dates
    and counts unreadable, some rows without any hour."""
    items = read_table(spark, sf_dir, "lineitem")
    hour = F.col("l_orderkey") % 24 + 1
    count = (
        F.when(F.col("l_tax") == 0.08, F.lit("n/a"))
        .when(F.col("l_tax") == 0.07, F.lit(""))
        .when(F.col("l_tax") == 0.06, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" ")))
        .otherwise(F.col("l_quantity").cast("string"))
    )
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return items.select(
        F.when(F.col("l_suppkey") % 10 == 9, F.lit(""))
        .when(F.col("l_suppkey") % 10 == 8, F.concat((F.col("l_suppkey") % 5).cast("string"), F.lit(".0")))
        .otherwise((F.col("l_suppkey") % 5).cast("string")).alias("station_id"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("2").alias("dir_of_travel"),
        F.col("l_linenumber").cast("string").alias("lane_of_travel"),
        F.when(F.col("l_discount") == 0.10, F.lit("no date"))
        .when(F.col("l_discount") == 0.09, F.concat(day, F.lit(" 00:00:00")))
        .otherwise(day).alias("date"),
        *[F.when(hour == h, count).alias(str(h)) for h in range(1, 25)],
    )


def hourly_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text row per order line, with dates written in five ways."""
    items = read_table(spark, sf_dir, "lineitem")
    hour, way = F.col("l_orderkey") % 24 + 1, F.col("l_linenumber") % 5
    forms = ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "yyyy/MM/dd", "MMM d, yyyy")
    written = F.coalesce(*[F.when(way == k, F.date_format("l_shipdate", f)) for k, f in enumerate(forms)])
    return items.select(
        (F.col("l_suppkey") % 5).cast("string").alias("station_id"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("2").alias("dir_of_travel"),
        F.col("l_linenumber").cast("string").alias("lane_of_travel"), written.alias("date"),
        *[F.when(hour == h, F.col("l_quantity").cast("string")).alias(str(h)) for h in range(1, 25)],
    )
