from datetime import date, timedelta

from pyspark.sql import functions as F

from stationflow.operators.hourly import direction_day, lane_totals, year_span
from stationflow.operators.station_day import (
    station_coverage, station_day, station_year_coverage, top_two_directions, with_shares,
)
from stationflow.schemas import HOURLY_TEXT

D1 = date(2020, 1, 1)


def hours_row(station, direction, lane, day, first=None, rest=None):
    return (station, direction, lane, day, first, *[rest] * 23)


def dir_day_table(spark, rows):
    return spark.createDataFrame(rows, "station_id long, date date, dir_of_travel long, vol_dir double")


def test_dirty_hours(spark):
    raw = spark.createDataFrame([
        hours_row("1", "1", "1", "2020-01-01", "5", "1"),
        hours_row("1", "1", "2", "2020-01-01", "bad", "2"),
        hours_row("1", "2", "1", "2020-01-01"),
        hours_row("1", "2", "1", "no date", "9", "9"),
        hours_row(None, "2", "1", "2021-05-01", "9", "9"),
    ], HOURLY_TEXT)
    totals = {(r["dir_of_travel"], r["lane_of_travel"], r["station_id"]): r["lane_total"]
              for r in lane_totals(raw).collect()}
    assert totals == {(1, 1, 1): 28.0, (1, 2, 1): 46.0, (2, 1, 1): None, (2, 1, None): 216.0}
    # No value at all sums to zero; a row without a station belongs to no group.
    days = {(r["station_id"], r["dir_of_travel"]): r["vol_dir"] for r in direction_day(lane_totals(raw)).collect()}
    assert days == {(1, 1): 74.0, (1, 2): 0.0}
    # The year span is taken before rows are dropped for their keys.
    assert tuple(year_span(raw).first()) == (2020, 2021)


def test_direction_ties_and_third_direction(spark):
    rows = [(1, D1 + timedelta(days=i), d, 10.0 * d) for i in range(3) for d in (3, 5)]
    rows += [(1, D1, 1, 7.0)]
    dirs = top_two_directions(dir_day_table(spark, rows)).first()
    assert (dirs["dir_a"], dirs["dir_b"], dirs["n_dirs"]) == (3, 5, 3)
    days = station_day(dir_day_table(spark, rows)).orderBy("date").collect()
    assert [d["valid_day"] for d in days] == [False] * 3  # one third direction on one day spoils all days
    assert days[0]["station_volume"] == 87.0 and days[0]["vol_a"] == 30.0 and days[0]["vol_b"] == 50.0
    assert abs(days[0]["share_a"] + days[0]["share_b"] - 1) < 1e-12


def test_single_direction_and_missing_side(spark):
    rows = [(1, D1, 1, 5.0), (2, D1, 1, 5.0), (2, D1, 2, 5.0), (2, D1 + timedelta(days=1), 1, 5.0),
            (2, D1 + timedelta(days=2), 1, 0.0), (2, D1 + timedelta(days=2), 2, 0.0)]
    got = {(r["station_id"], r["date"].day): r for r in station_day(dir_day_table(spark, rows)).collect()}
    assert got[1, 1]["dir_b"] is None and not got[1, 1]["valid_day"]
    assert got[2, 1]["valid_day"] and not got[2, 2]["valid_day"] and not got[2, 3]["valid_day"]
    assert got[2, 2]["dir_b"] == 2 and got[2, 2]["share_b"] is None and got[2, 2]["share_a"] == 1.0
    assert got[2, 3]["share_a"] is None


def test_one_pass_form_equals_join_form(spark):
    rows = [(s, D1 + timedelta(days=i), d, float((s * i * d) % 17))
            for s in range(5) for i in range(40) for d in (1, 2, 4) if (s + i * d) % 3]
    dir_day = dir_day_table(spark, rows)
    totals = dir_day.groupBy("station_id", "date").agg(F.sum("vol_dir").alias("station_volume"))
    base = totals.join(top_two_directions(dir_day), "station_id", "left")
    for side in ("a", "b"):
        part = dir_day.select("station_id", "date", F.col("dir_of_travel").alias(f"dir_{side}"),
                              F.col("vol_dir").alias(f"vol_{side}"))
        base = base.join(part, ["station_id", "date", f"dir_{side}"], "left")
    one_pass = station_day(dir_day)
    joined = with_shares(base).select(*one_pass.columns)
    assert one_pass.count() == joined.count()
    assert one_pass.exceptAll(joined).isEmpty() and joined.exceptAll(one_pass).isEmpty()


def test_station_day_moves_rows_twice(spark):
    plan = station_day(dir_day_table(spark, [(1, D1, 1, 1.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # direction-day rows arrive; one more shuffle by station


def test_coverage_counts_years_with_rows_only(spark):
    rows = [(1, date(2020, 1, 1), 10.0, True), (1, date(2020, 1, 2), 20.0, False), (1, date(2022, 1, 1), 30.0, True)]
    days = spark.createDataFrame(rows, "station_id long, date date, station_volume double, valid_day boolean")
    years = {r["year"]: r for r in station_year_coverage(days, 2020, 2022).collect()}
    assert years[2020]["valid_days"] == 1 and years[2020]["avg_volume"] == 15.0
    assert years[2020]["cov"] == 1 / 366 and years[2022]["cov"] == 1 / 365 and 2021 not in years
    total = station_coverage(days, 2020, 2022).first()
    assert total["years_present"] == 2 and total["min_cov"] == 1 / 366 and total["avg_volume"] == 22.5


def test_texts_of_dates_are_read_once(spark):
    """a filter on the day put all formats into the scan's filter a second time, with the making of the text."""
    from stationflow.functions.cleaning import DATE_FORMATS

    raw = spark.createDataFrame([
        hours_row("1", "1", "1", day, "5") for day in ("2020-01-01", "1/1/2020", "20200101", "no date", None, "Jan 1, 2020")
    ], HOURLY_TEXT)
    days = direction_day(lane_totals(raw))
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == len(DATE_FORMATS)
    assert [tuple(r) for r in days.collect()] == [(1, D1, 1, 20.0)]


# --- as many stations as suppliers ----------------------------------------------------------------

def order_lines(spark, folder):
    """Order lines with repeated, empty and negative keys and empty counts."""
    from datetime import datetime

    rows = []
    for i in range(400):
        rows.append((
            None if i % 31 == 0 else -i % 60 if i % 7 else i % 60 - 90, None if i % 29 == 0 else i % 9,
            None if i % 23 == 0 else i % 2, None if i % 11 == 0 else float(i % 13) / 4, "O" if i % 3 else None,
            None if i % 37 == 0 else datetime(2020, 1, 1 + i % 5)))
    lines = spark.createDataFrame(
        rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string, l_shipdate timestamp_ntz")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_many_stations_have_the_same_hours_from_narrow_sums(spark, tmp_path):
    """F3 to F7: one wide sum of 24 hours per row and task took most of a task's memory."""
    from stationflow.sources.driver_tables import hourly_lane

    folder = order_lines(spark, str(tmp_path))
    station = F.col("l_suppkey")
    plain, many = hourly_lane(spark, folder, station=station), hourly_lane(spark, folder, station=station, many=True)
    assert many.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(str, many.collect())) == sorted(map(str, plain.collect())) and plain.count() > 100
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(sums) == 1 and sums[0].count("sum(") == 1


def test_the_many_queries_take_narrow_sums_over_a_stated_number_of_tasks(spark, tmp_path):
    import __spark_entry__ as entry

    days = entry._many_days(spark, order_lines(spark, str(tmp_path)))
    plain = entry._days(spark, str(tmp_path), station=F.col("l_suppkey"))
    assert sorted(map(str, days.collect())) == sorted(map(str, plain.collect())) and plain.count() > 10
    assert days.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
