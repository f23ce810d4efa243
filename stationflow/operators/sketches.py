"""Quantiles from mergeable sketches, for tables where the exact way costs too much.

A KLL sketch keeps some values of a group such that the rank of an answer is off by a small share of the rows,
whatever their number and order. Sketches merge: those of days make those of weeks, without the days' rows. With
``k`` 200 the rank is off by 1.4 % at most in 99 cases of 100, with 4096 by less than 0.1 %; a group of fewer
than ``k`` rows is answered exactly. Answers are values that occur (no interpolation).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 4096


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """Keys, ``sketch`` and ``n``: one row per key, combined in every task. Rows with an empty key or value are left out."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).na.drop()
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("__v", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Keys, ``sketch`` and ``n`` from sketches of finer keys."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Keys, the named quantiles, and ``n``."""
    return sketches.select(*keys, *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()], "n")
