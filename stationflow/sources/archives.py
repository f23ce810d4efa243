"""CSV members of zip archives and headers of CSV files, as a data source of its own.

A partition is one member of one archive. Its reader opens the archive, seeks to the member and streams it: the packed
bytes are unpacked and parsed a block at a time, so neither an archive's size nor a member's is bounded by a task's
memory. The list of members is read from the archives' directories alone.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.csv as pa_csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 4 << 20  # bytes of a member that are parsed at a time


def opened(path: str) -> io.BufferedIOBase:
    """A seekable stream of a file, by whatever file system its address names."""
    address = urlparse(path)
    if address.scheme in ("", "file"):
        return open(unquote(address.path) if address.scheme else path, "rb")
    system, place = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(place))


def members_of(path: str) -> list[str]:
    with opened(path) as file, zipfile.ZipFile(file) as archive:
        return sorted(m for m in archive.namelist() if m.lower().endswith(".csv"))


def header_of(stream: io.BufferedIOBase) -> list[str]:
    line = stream.readline().decode("utf-8-sig").rstrip("\r\n")
    return next(csv.reader([line]), [])


def checked_header(name: str, header: Sequence[str], columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(header))
    if missing:
        raise ValueError(f"{name}: missing required columns: {missing}")


def member_batches(name: str, stream: io.BufferedIOBase, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``columns`` of a CSV stream as text, found by name; an empty field is null.

    A line with too few fields has nulls for the rest, one with too many loses the surplus.
    """
    header = header_of(stream)
    checked_header(name, header, columns)
    odd: list[list[str]] = []

    def kept_aside(row: pa_csv.InvalidRow) -> str:
        odd.append(next(csv.reader([row.text])))
        return "skip"

    def repaired() -> Iterator[pa.RecordBatch]:
        if odd:
            at = [header.index(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array([line[i] if i < len(line) and line[i] != "" else None for line in odd], pa.string()) for i in at],
                names=list(columns))
            odd.clear()

    try:
        reader = pa_csv.open_csv(
            stream, read_options=pa_csv.ReadOptions(column_names=header, block_size=BLOCK, use_threads=False),
            parse_options=pa_csv.ParseOptions(invalid_row_handler=kept_aside),
            convert_options=pa_csv.ConvertOptions(
                column_types={c: pa.string() for c in header}, include_columns=list(columns), strings_can_be_null=True,
                quoted_strings_can_be_null=True, null_values=[""]))
    except pa.ArrowInvalid as error:
        if "Empty CSV" in str(error):  # a header and nothing else
            return
        raise
    for batch in reader:
        yield batch
        yield from repaired()
    yield from repaired()


class Member(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


class _Members(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns

    def partitions(self) -> list[Member]:
        return [Member(path, member) for path in self.paths for member in members_of(path)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member at all
            return
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive, archive.open(partition.member) as stream:
            yield from member_batches(partition.member, io.BufferedReader(stream), self.columns)


class ZippedCsv(DataSource):
    """Options: ``paths`` and ``columns``, JSON lists."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> _Members:
        return _Members(json.loads(self.options["paths"]), json.loads(self.options["columns"]))


def read_zipped_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns``, as text, of all CSV members of the archives, one task for each member."""
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").option("paths", json.dumps(list(paths))).option("columns", json.dumps(list(columns))).load()


def headers(spark: SparkSession, paths: Sequence[str], files_of_a_task: int = 100) -> dict[tuple[str, ...], list[str]]:
    """The files by their header, from one job: every task reads the first line of some of them."""
    def read(frames):
        for frame in frames:
            found = []
            for path in frame["path"]:
                with opened(path) as file:
                    found.append(json.dumps(header_of(file)))
            yield frame.assign(header=found)

    if not paths:
        return {}
    tasks = max(1, -(-len(paths) // files_of_a_task))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    out: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(listed.mapInPandas(read, "path string, header string").collect()):
        out.setdefault(tuple(json.loads(row["header"])), []).append(row["path"])
    return out
