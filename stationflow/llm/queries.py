"""The registered queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from stationflow.llm import (
    bpe, byte_cnn, line_dedup, multi_index, nn_descent, packing, pii, quality, simhash, spelling, substring_dedup, url_filter,
    whitening,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    rows = packing.packed(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
        with_ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.removed_lines(_table(spark, sf, "documents")).drop("text_hash")


def op3_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op4_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf, "documents"))


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(_table(spark, sf, "documents"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.scored_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.document_components(_table(spark, sf, "documents"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf, "embeddings"))


def op12_trie_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf, "documents"))


def op13_byte_cnn(spark: SparkSession, sf: str) -> DataFrame:
    return byte_cnn.predicted_languages(_table(spark, sf, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_line_dedup, op3_multi_index, op4_nn_descent, op5_byte_bpe, op6_substring_dedup, op7_pii,
        op8_quality, op9_simhash, op10_url_filter, op11_whitening, op12_trie_frontier, op13_byte_cnn)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.oracle(), "op10_url_filter": url_filter.oracle(), "op12_trie_frontier": spelling.oracle()}
