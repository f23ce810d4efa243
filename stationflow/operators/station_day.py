"""Direction-day totals -> station-day table with shares and validity, and its coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.functions.calendar import days_in_year

COLUMNS = [
    "station_id", "date", "station_volume", "dir_a", "dir_b", "vol_a", "vol_b",
    "share_a", "share_b", "n_dirs", "valid_day",
]


def top_two_directions(dir_day: DataFrame) -> DataFrame:
    """Two most frequent directions per station (ties: smaller number) and the direction count."""
    counts = dir_day.groupBy("station_id", "dir_of_travel").agg(F.count(F.lit(1)).alias("n_days"))
    best_first = Window.partitionBy("station_id").orderBy(F.desc("n_days"), F.asc("dir_of_travel"))
    ranked = counts.withColumn("place", F.row_number().over(best_first))
    return ranked.groupBy("station_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("dir_of_travel"))).alias("dir_a"),
        F.max(F.when(F.col("place") == 2, F.col("dir_of_travel"))).alias("dir_b"),
        F.count(F.lit(1)).alias("n_dirs"),
    )


def station_day(dir_day: DataFrame) -> DataFrame:
    """One row per station and date.

    The direction ranking is a property of the whole station history. It is computed with windows
    over the same station partitioning that the final aggregate uses, so the direction-day table
    is read once and moved once. A station has at most (days x directions) rows here, however many
    raw rows it had. The number of partitions is stated, as Spark would join them until few tasks hold many stations: it
    goes by bytes moved, and these narrow rows take many times as much when they are sorted and ranked.
    """
    parts = int(dir_day.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    station = Window.partitionBy("station_id")
    days_of_direction = Window.partitionBy("station_id", "dir_of_travel")
    best_first = station.orderBy(F.desc("n_days"), F.asc("dir_of_travel"))
    ranked = (
        dir_day.repartition(parts, "station_id")
        .withColumn("n_days", F.count(F.lit(1)).over(days_of_direction))
        .withColumn("place", F.dense_rank().over(best_first))
        .withColumn("n_dirs", F.max("place").over(station).cast("long"))
        .withColumn("dir_a", F.max(F.when(F.col("place") == 1, F.col("dir_of_travel"))).over(station))
        .withColumn("dir_b", F.max(F.when(F.col("place") == 2, F.col("dir_of_travel"))).over(station))
    )
    per_day = ranked.groupBy("station_id", "date").agg(
        F.sum("vol_dir").alias("station_volume"),
        F.max("dir_a").alias("dir_a"),
        F.max("dir_b").alias("dir_b"),
        F.max(F.when(F.col("place") == 1, F.col("vol_dir"))).alias("vol_a"),
        F.max(F.when(F.col("place") == 2, F.col("vol_dir"))).alias("vol_b"),
        F.max("n_dirs").alias("n_dirs"),
    )
    return with_shares(per_day).select(*COLUMNS)


def with_shares(per_day: DataFrame) -> DataFrame:
    """Directional shares, and the flag of a usable day."""
    both = F.coalesce(F.col("vol_a"), F.lit(0.0)) + F.coalesce(F.col("vol_b"), F.lit(0.0))
    usable = (
        (F.col("station_volume") > 0)
        & (F.col("n_dirs") == 2)
        & F.col("vol_a").isNotNull()
        & F.col("vol_b").isNotNull()
        & (both > 0)
    )
    return per_day.withColumns({
        "share_a": F.when(both > 0, F.col("vol_a") / both),
        "share_b": F.when(both > 0, F.col("vol_b") / both),
        "valid_day": F.coalesce(usable, F.lit(False)),
    })


def station_year_coverage(days: DataFrame, year_start: int, year_end: int) -> DataFrame:
    """Valid days, mean volume over all days and covered share of the year, per station and year."""
    in_years = days.where(
        (F.col("date") >= F.make_date(F.lit(year_start), F.lit(1), F.lit(1)))
        & (F.col("date") <= F.make_date(F.lit(year_end), F.lit(12), F.lit(31)))
    )
    per_year = in_years.groupBy("station_id", F.year("date").alias("year")).agg(
        F.count_if(F.col("valid_day")).alias("valid_days"),
        F.avg("station_volume").alias("avg_volume"),
    )
    expected = days_in_year(F.col("year"))
    return per_year.withColumn("expected_days", expected).withColumn(
        "cov", F.col("valid_days") / F.col("expected_days")
    )


def station_coverage(days: DataFrame, year_start: int, year_end: int) -> DataFrame:
    """Coverage over the years that have rows, one row per station."""
    return station_year_coverage(days, year_start, year_end).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("years_present"),
        F.min("cov").alias("min_cov"),
        F.avg("cov").alias("avg_cov"),
        F.avg("avg_volume").alias("avg_volume"),
    )

