"""The corpus pipeline: documents in, packed training sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents. Empty tables,
null texts and repeated rows pass as the operators define it; extra columns are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from stationflow.lineage import discard, discard_path, noted, staged
from stationflow.llm import line_dedup, packing, pii, quality, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, to a word, leave their texts; every document stays."""
    return line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the least doc_id."""
    return simhash.first_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids and places in sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


# Texts come to Python tasks in batches of half the size that the operators ask for by themselves: the heap has grown over
# the stages before, and what Arrow holds comes on top of it.
BATCH_BYTES = 2 << 20

# What the last call of a stage left in the shared folder: it is read until the stage's result is written, which it is
# when the next stage starts.
_left: dict[int, list[str]] = {}


def _tidy(number: int, stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _left.pop(number - 1, []):
            discard_path(spark, path)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        with noted() as paths:
            out = stage(spark, docs, sf_dir)
        _left[number] = paths
        return out

    return run_stage


STAGES = [(name, _tidy(number, stage)) for number, (name, stage) in enumerate([
    ("quality_classifier", quality_filter),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", near_dedup),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
])]

# Trained scores, extracted spans and token ids can't be said in SQL; tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each stage's written result, and what it left, go when the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        discard(before)  # the input table itself was never staged and stays
    return STAGES[-1][1](spark, docs, sf_dir)
