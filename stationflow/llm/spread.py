"""Joins on keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANY = 20_000  # rows of a key before it is split
MOST_SPLIT = 10_000  # keys that can be split


def join_spread(rows: DataFrame, few: DataFrame, key: str | list[str], count: Column, by: Column, many: int = MANY) -> DataFrame:
    """``rows`` joined with ``few``, which has one row per key and, in ``count``, how many of ``rows`` have that key.

    The rows of a frequent key are dealt to several parts by the hash of ``by``, and the key's one row is repeated for
    each. ``few`` should be staged: it is read twice.
    """
    key = [key] if isinstance(key, str) else list(key)
    total = few.agg(F.sum(F.when(count > many, count))).first()[0]
    if total is None:
        return rows.join(few, key)
    limit = max(many, total // MOST_SPLIT)  # fewer than total / limit keys can have more rows than limit
    parts = F.greatest(F.lit(1), F.ceil(count / F.lit(limit))).cast("long")
    hot = F.broadcast(few.where(count > limit).select(*key, parts.alias("__parts")))  # MOST_SPLIT rows at most
    spread = rows.join(hot, key, "left").withColumn("__part", F.pmod(by, F.coalesce("__parts", F.lit(1)))).drop("__parts")
    copies = few.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.when(count > limit, parts - 1).otherwise(0).cast("long"))))
    return spread.join(copies, [*key, "__part"]).drop("__part")
