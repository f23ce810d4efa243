"""Coercion of dirty input columns. Bad values become NULL; NaN never leaves this module."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Sequence[str], where: str = "input") -> None:
    """Plan-time check; the message names the source and the sorted missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{where}: missing required columns: {missing}")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def quoted(name: str) -> Column:
    """Column by its exact name, also where the name is a number such as ``1``."""
    return F.col(f"`{name}`")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def _numeric_looking(bare: Column) -> Column:
    """Cheap test before a cast: a failed cast costs an exception, and dirty files hold many.

    Every readable number starts with a sign, a dot or a digit (the characters from ``+`` up to
    ``9``) or spells infinity.
    """
    return bare.between("+", ":") | (F.lower(F.left(bare, F.lit(3))) == "inf")


def _parse(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(_numeric_looking(bare), F.nanvl(bare.try_cast("double"), F.lit(None).cast("double")))


def text_to_number(text: Column) -> Column:
    """Double, or NULL where the text is no number."""
    # Java reads '12d' and '12f' as numbers; in a count column they are text.
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), _parse(text))


def as_number(df: DataFrame, name: str) -> Column:
    """Double, or NULL where the value is no number."""
    if isinstance(dtype_of(df, name), T.StringType):
        return text_to_number(quoted(name))
    return nan_to_null(quoted(name).cast("double"))


def as_long(df: DataFrame, name: str) -> Column:
    """Whole number, or NULL. Text such as ``12.0`` counts as 12; ``12.5`` does not fit."""
    c = quoted(name)
    if isinstance(dtype_of(df, name), T.IntegralType):
        return c.cast("long")
    number = as_number(df, name)
    whole = F.when(number == F.floor(number), number.try_cast("long"))
    if isinstance(dtype_of(df, name), T.StringType):
        return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("long")).otherwise(whole)
    return whole


# Forms of dates that outside files use besides ISO; month before day where both fit.
DATE_FORMATS = ("M/d/yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "M/d/yyyy H:mm", "M-d-yyyy")


def as_date(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date, or NULL where the text is no date. ``formats`` are tried after the ISO form, in order."""
    c = quoted(name)
    if not isinstance(dtype_of(df, name), T.StringType):
        return c.cast("date")
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("date")


def as_flag(df: DataFrame, name: str) -> Column:
    """Boolean where only a clear false is false: missing or unreadable values count as true."""
    c = quoted(name)
    if isinstance(dtype_of(df, name), T.StringType):
        return F.coalesce(c.try_cast("boolean"), c.try_cast("double") != 0, F.lit(True))
    return F.coalesce(c.cast("boolean"), F.lit(True))


def with_valid_day(df: DataFrame) -> DataFrame:
    """``valid_day`` as a boolean; a table without the column counts as all valid."""
    flag = as_flag(df, "valid_day") if "valid_day" in df.columns else F.lit(True)
    return df.withColumn("valid_day", flag)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL or NaN in any of the named columns that exist in ``df``."""
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def sum_present(df: DataFrame, names: Sequence[str]) -> Column:
    """Row-wise sum over the values that are numbers; NULL when none is."""
    if any(isinstance(dtype_of(df, n), T.StringType) for n in names):
        texts = [quoted(n).cast("string") for n in names]

        def add(total: Column, value: Column) -> Column:
            return F.when(value.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + value)

        nothing = F.lit(None).cast("double")
        plain = F.aggregate(F.array(*[_parse(t) for t in texts]), nothing, add)
        # Only a row that holds a suspect suffix pays for the careful reading of each text.
        careful = F.aggregate(F.transform(F.array(*texts), text_to_number), nothing, add)
        suspect = F.concat_ws("|", *texts).rlike(r"[0-9.][dDfF]\s*(\||$)")
        return F.when(suspect, careful).otherwise(plain)
    values = [as_number(df, n) for n in names]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), total)


def pick_date_column(df: DataFrame) -> str:
    """First date-like column name of an outside predictions table."""
    # Accepted names, in order of preference.
    for name in ("date", "ds", "timestamp", "day", "datetime"):
        if name in df.columns:
            return name
    raise ValueError("no date column found")
