"""Sinks. Parquet is the hand-over between jobs; CSV, plain or gzip, is for outside readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", gzip: bool = False,
                order: Sequence[Column | str] = (), partition_by: Sequence[str] = ()) -> str:
    """Writes ``df`` as a folder of files and returns the path.

    ``order`` sorts the rows for presentation; the sort is a range partitioning over all tasks.
    """
    if order:
        df = df.orderBy(*order)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return path


def station_day_name(min_year: int, max_year: int) -> str:
    return f"station_day_{min_year}_{max_year}"


def coverage_name(year_start: int, year_end: int) -> str:
    return f"station_candidates_{year_start}_{year_end}_coverage"


def descending(*names: str) -> list[Column]:
    """Presentation order, largest first; missing values come last."""
    return [F.desc_nulls_last(n) for n in names]
