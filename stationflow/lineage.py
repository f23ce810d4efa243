"""Cutting lineage at the places where one table feeds several branches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what the session has set.

    Where neither is set, a scratch folder is made if driver and executors are one process (a master
    of ``local`` or ``local[...]``); on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stationflow-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written rows.

    The rows survive lost executors, and every later branch reads them in place of running the
    plan above again. Partitioning is kept, so windows on the same key need no new shuffle. Spark
    removes the files with the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_noting: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that ``staged`` writes while this lasts, for whoever deletes them when their reader is done."""
    paths: list[str] = []
    _noting.append(paths)
    try:
        yield paths
    finally:
        _noting[:] = [own for own in _noting if own is not paths]


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    For wide or large tables: later branches read only the columns they use, with statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stationflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame._staged_at = path
    for paths in _noting:
        paths.append(path)
    return frame


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, by the file system its address names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(frame: DataFrame) -> None:
    """Delete the files of a table that ``staged`` made, once nothing will read it again."""
    path = getattr(frame, "_staged_at", None)
    if path is not None:
        discard_path(frame.sparkSession, path)
