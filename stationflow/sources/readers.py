"""Readers: hourly files (folder of CSVs or zip archives), station-day, panel, prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.functions.cleaning import as_date, as_flag, as_long, as_number, require_columns
from stationflow.schemas import BACKTEST, HOUR_COLUMNS, HOURLY_KEYS, PREDICTIONS
from stationflow.sources.archives import checked_header, headers, read_zipped_csv

HOURLY_COLUMNS = HOURLY_KEYS + HOUR_COLUMNS


def read_hourly(spark: SparkSession, path: str, uniform_header: bool = False, check: bool = True) -> DataFrame:
    """Hourly rows as text from a ``.zip`` archive or a folder of ``*.csv`` files.

    With ``check`` an input without rows is an error at once, which takes a look at the first of them.
    """
    if path.lower().endswith(".zip"):
        rows = read_hourly_zip(spark, path)
    else:
        rows = read_hourly_folder(spark, path, uniform_header)
    if check and rows.isEmpty():
        raise ValueError("No data read from input.")
    return rows


def files_named(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """Sorted paths; only file names reach the driver, the content column is not read."""
    listing = spark.read.format("binaryFile")
    if pattern:
        listing = listing.option("pathGlobFilter", pattern)
    return sorted(r["path"] for r in listing.load(path).select("path").collect())


def read_hourly_folder(spark: SparkSession, folder: str, uniform_header: bool = False) -> DataFrame:
    """All CSV files of a folder, columns matched by name file by file.

    Files with the same header are read in one scan. With ``uniform_header`` no header is looked at
    up front: one scan reads everything, and a file with another header fails instead of being
    misread.
    """
    if uniform_header:
        return _scan(spark, [f"{folder}/*.csv"], HOURLY_COLUMNS)
    files = files_named(spark, folder, "*.csv")
    if not files:
        raise ValueError("No data read from input.")
    parts = []
    for names, paths in headers(spark, files).items():
        checked_header(paths[0], names, HOURLY_COLUMNS)
        parts.append(_scan(spark, paths, names).select(*[F.col(f"`{c}`") for c in HOURLY_COLUMNS]))
    return reduce(DataFrame.unionByName, parts)


def _scan(spark: SparkSession, paths: list[str], names) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "PERMISSIVE").csv(paths)
    )


def read_hourly_zip(spark: SparkSession, path: str) -> DataFrame:
    """CSV members of one or many zip archives (``path`` may be a glob), a task for each member."""
    return read_zipped_csv(spark, files_named(spark, path), HOURLY_COLUMNS)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header where the name says so (``.csv``, ``.csv.gz``)."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def load_station_day(spark: SparkSession, path: str) -> DataFrame:
    """Station-day table with typed keys and flag; rows without a readable station or date go."""
    raw = read_any(spark, path)
    require_columns(raw, ["station_id", "date", "station_volume"], path)
    typed = {"station_id": as_long(raw, "station_id"), "date": as_date(raw, "date")}
    for name in ("station_volume", "vol_a", "vol_b", "share_a", "share_b"):
        if name in raw.columns:
            typed[name] = as_number(raw, name)
    for name in ("dir_a", "dir_b", "n_dirs"):
        if name in raw.columns:
            typed[name] = as_long(raw, name)
    if "valid_day" in raw.columns:
        typed["valid_day"] = as_flag(raw, "valid_day")
    return raw.withColumns(typed).na.drop(subset=["station_id", "date"])


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """Feature panel; numbers and dates are typed where the file holds text."""
    raw = read_any(spark, path)
    require_columns(raw, ["station_id", "date", "y", "split"], path)
    typed = {"station_id": as_long(raw, "station_id"), "date": as_date(raw, "date")}
    for name, dtype in raw.dtypes:
        if name not in ("station_id", "date", "split") and dtype == "string":
            typed[name] = as_number(raw, name)
    return raw.withColumns(typed)


def _typed(raw: DataFrame, schema) -> DataFrame:
    readers = {"long": as_long, "bigint": as_long, "int": as_long, "date": as_date, "double": as_number}
    typed = {
        f.name: readers[f.dataType.simpleString()](raw, f.name).cast(f.dataType)
        for f in schema.fields if f.name in raw.columns and f.dataType.simpleString() in readers
    }
    return raw.withColumns(typed)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _typed(read_any(spark, path), PREDICTIONS)


def load_backtest(spark: SparkSession, path: str) -> DataFrame:
    return _typed(read_any(spark, path), BACKTEST)
