"""Bounded-memory ingest of a folder of hourly CSV files, chunk by chunk.

The folder is read as a stream of files that stops when all present files are read. Each chunk is read once: it is
reduced to direction-day partial sums, and what is to be known of its rows is observed on the way. The partials and
facts of all chunks are summed at the end. A run that was cut off goes on after its last finished chunk; a chunk that was
cut off half-way is written again in place, so that nothing counts twice; new files are picked up by the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.functions.cleaning import DATE_FORMATS
from stationflow.operators.hourly import DIR_DAY_KEYS, direction_day, lane_totals, observed, source_facts
from stationflow.schemas import HOURLY_TEXT

FACTS = "rows long, unreadable_dates long, min_year int, max_year int"


def _write_partial(work: str, formats: Sequence[str]) -> Callable[[DataFrame, int], None]:
    def write(chunk: DataFrame, chunk_id: int) -> None:
        # a repeated chunk replaces its own folders; facts come last, and without them a chunk is not finished
        def sums(rows: DataFrame) -> None:
            direction_day(lane_totals(rows, formats=formats)).write.mode("overwrite").parquet(f"{work}/partials/chunk={chunk_id}")

        facts = observed(chunk, source_facts(chunk, formats), sums)
        names = [c.split(" ")[0] for c in FACTS.split(", ")]
        chunk.sparkSession.createDataFrame([tuple(facts[n] for n in names)], FACTS).write.mode("overwrite").parquet(
            f"{work}/facts/chunk={chunk_id}")

    return write


def ingest_chunks(spark: SparkSession, folder: str, work: str, files_per_chunk: int = 16,
                  formats: Sequence[str] = DATE_FORMATS) -> None:
    """Reads all files of ``folder`` not read before; ``work`` must be a folder all executors share.

    The files must share one header, in the declared order; another header is an error.
    """
    chunks = (
        spark.readStream.schema(HOURLY_TEXT)
        .option("header", True).option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_chunk).option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    run = (
        chunks.writeStream.foreachBatch(_write_partial(work, formats))
        .option("checkpointLocation", f"{work}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def chunked_direction_day(spark: SparkSession, work: str) -> DataFrame:
    """Direction-day totals over the partial sums of all chunks."""
    partials = spark.read.parquet(f"{work}/partials")
    return partials.groupBy(*DIR_DAY_KEYS).agg(F.sum("vol_dir").alias("vol_dir"))


def chunked_facts(spark: SparkSession, work: str) -> dict:
    """What is known of the rows of all chunks."""
    return spark.read.parquet(f"{work}/facts").agg(
        F.sum("rows").alias("rows"), F.sum("unreadable_dates").alias("unreadable_dates"),
        F.min("min_year").alias("min_year"), F.max("max_year").alias("max_year")).first().asDict()
