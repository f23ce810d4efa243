from datetime import date

import pytest
from pyspark.sql import functions as F

from stationflow.functions import calendar as C
from stationflow.functions import cleaning as K


def values(df):
    return [tuple(r) for r in df.collect()]


def test_numbers_and_longs_from_text(spark):
    df = spark.createDataFrame(
        [(t,) for t in ["12", " 7.5 ", "", "n/a", None, "12d", "3f", "1e3", "NaN", "12.0", "-4", "inf"]], "t string")
    got = values(df.select(K.as_number(df, "t"), K.as_long(df, "t")))
    assert got == [(12.0, 12), (7.5, None), (None, None), (None, None), (None, None), (None, None), (None, None),
                   (1000.0, 1000), (None, None), (12.0, 12), (-4.0, -4), (float("inf"), None)]


def test_long_keeps_all_digits(spark):
    df = spark.createDataFrame([("9007199254740993",)], "t string")
    assert values(df.select(K.as_long(df, "t"))) == [(9007199254740993,)]


def test_dates(spark):
    df = spark.createDataFrame([("2021-03-04",), ("2021-03-04 10:00:00",), ("03/04/2021",), ("x",), (None,)], "t string")
    day = date(2021, 3, 4)
    assert values(df.select(K.as_date(df, "t", ()))) == [(day,), (day,), (None,), (None,), (None,)]
    assert values(df.select(K.as_date(df, "t"))) == [(day,), (day,), (day,), (None,), (None,)]
    forms = spark.createDataFrame([("20210304",), ("2021/3/4",), ("Mar 4, 2021",), ("3/4/2021",), ("4 Mar 2021",)], "t string")
    assert values(forms.select(K.as_date(forms, "t"))) == [(day,)] * 5


def test_flags_only_clear_false_is_false(spark):
    df = spark.createDataFrame([("True",), ("False",), ("0",), ("0.0",), ("yes?",), (None,)], "t string")
    assert [r[0] for r in values(df.select(K.as_flag(df, "t")))] == [True, False, False, False, True, True]
    assert K.with_valid_day(spark.range(1)).collect()[0]["valid_day"] is True


@pytest.mark.parametrize("dtype", ["string", "double"])
def test_row_sum_of_present_values(spark, dtype):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (None, None)], "a double, b double").select(
        F.col("a").cast(dtype).alias("a"), F.col("b").cast(dtype).alias("b"))
    assert [r[0] for r in values(df.select(K.sum_present(df, ["a", "b"])))] == [3.0, 3.0, None]


def test_row_sum_of_dirty_text(spark):
    df = spark.createDataFrame([("1", "x"), ("y", ""), ("5f", "2"), ("4", "7d")], "a string, b string")
    assert [r[0] for r in values(df.select(K.sum_present(df, ["a", "b"])))] == [1.0, None, 2.0, 4.0]


def test_required_columns_named_and_sorted(spark):
    with pytest.raises(ValueError, match=r"file.csv: missing required columns: \['b', 'c'\]"):
        K.require_columns(spark.range(1), ["id", "c", "b"], "file.csv")


def test_infinities_and_incomplete_rows(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,), (None,)], "x double")
    assert [r[0] for r in values(df.select(K.finite_or_null(F.col("x"))))] == [None, None, 2.0, None]
    assert K.drop_incomplete(df, ["x", "absent"]).count() == 2


def test_date_column_choice(spark):
    df = spark.range(1).withColumn("ds", F.current_date())
    assert K.pick_date_column(df) == "ds"
    with pytest.raises(ValueError):
        K.pick_date_column(spark.range(1))


def test_calendar(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 7),), (date(2024, 1, 8),)], "d date")
    got = values(df.select(C.week_ending_sunday(F.col("d")), C.weekday_name(F.weekday("d"))))
    assert got == [(date(2024, 1, 7), "Mon"), (date(2024, 1, 7), "Sun"), (date(2024, 1, 14), "Mon")]
    years = spark.createDataFrame([(2023,), (2024,)], "y int")
    assert [r[0] for r in values(years.select(C.days_in_year(F.col("y"))))] == [365, 366]
    label = C.split_label(F.col("d"), date(2024, 1, 1), date(2024, 1, 7))
    assert [r[0] for r in values(df.select(label))] == ["train", "val", "test"]
