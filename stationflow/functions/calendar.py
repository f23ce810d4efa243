"""Calendar arithmetic on dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short weekday names, Monday first.
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def between_dates(c: Column, start: date, end: date) -> Column:
    """Both ends included; plain comparisons, so the filter reaches the file scan."""
    return c.between(F.lit(start), F.lit(end))


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def weekday_name(dow: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), dow + 1)


def week_ending_sunday(c: Column) -> Column:
    return F.date_add(F.date_trunc("week", c).cast("date"), 6)


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def annual_cycle(day_of_year: Column) -> tuple[Column, Column]:
    """Sine and cosine of the position in a year of 365.25 days."""
    angle = F.lit(2.0) * F.pi() * day_of_year / F.lit(365.25)
    return F.sin(angle), F.cos(angle)


def split_label(c: Column, train_end: date, val_end: date) -> Column:
    return (
        F.when(c <= F.lit(train_end), "train")
        .when(c <= F.lit(val_end), "val")
        .otherwise("test")
    )
