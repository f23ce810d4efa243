"""SimHash fingerprints, and links between those that differ in few bits.

A fingerprint is embedded as the numbers of set bits of its sixteen 4-bit segments. The Manhattan
distance of two such points is at most the number of differing bits, and two points of the grid at
distance two or less have a grid point within one step of both. So every fingerprint is filed under
its own point and the points one step away; fingerprints that meet are held against each other
exactly (bit count of the exclusive or), inside the join. One row per fingerprint goes in, however
many documents share it, and only pairs that pass come out.

Defined cases: null texts count as empty; texts without a word have fingerprint zero and are linked
like any other; repeated rows have one result each; a null doc_id is never chosen as component_id
unless a component has no other; an empty table gives an empty result. Other columns are ignored by
``document_components`` and kept by ``first_of_each``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stationflow.llm.batches import in_small_batches
from stationflow.llm.components import components
from stationflow.lineage import settle

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
CHUNK = 1 << 16  # shingles whose bits are counted at a time
SEGMENTS = 16
# Masks that add up neighbouring bits, then pairs, within each 4-bit segment.
ODD_BITS, ODD_PAIRS = 0x5555555555555555, 0x3333333333333333


def fingerprint_of(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # both act on ASCII only
    if not words:
        return 0
    if len(words) < words_each:
        words, words_each = [b" ".join(words)], 1
    total, set_bits = len(words) - words_each + 1, np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(words_each)]))
    for start in range(0, total, CHUNK):
        size = min(CHUNK, total - start)
        hashed = np.fromiter((xxh64_intdigest(s, SEED) for _, s in zip(range(size), shingles)), np.uint64, size)
        bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * set_bits[i] > total))


def fingerprint(text: Column, words_each: int = SHINGLE_WORDS) -> Column:
    """Long column: the fingerprint as a signed 64-bit number."""

    @pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(t, words_each) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return hashed(text)


def segment_counts(bits: Column) -> Column:
    """Set bits of each 4-bit segment, packed as sixteen 4-bit numbers into one long."""
    odd, pairs = F.lit(ODD_BITS), F.lit(ODD_PAIRS)
    next_bits = F.shiftrightunsigned(bits, 1)
    both, one = bits.bitwiseAND(next_bits).bitwiseAND(odd), bits.bitwiseXOR(next_bits).bitwiseAND(odd)
    halves = F.shiftleft(both, 1).bitwiseOR(one)  # no sum here: it could pass the largest long
    return halves.bitwiseAND(pairs) + F.shiftrightunsigned(halves, 2).bitwiseAND(pairs)


def linked_fingerprints(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b: pairs of the distinct values of ``bits`` that differ in at most ``max_bits`` (0 to 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("one step on the grid reaches two bits; max_bits must be 0, 1 or 2")
    at = fingerprints.select("bits", segment_counts(F.col("bits")).alias("cell"))
    here = [F.col("cell")]
    up, down = [], []
    for i in range(SEGMENTS):
        step, count = F.lit(1 << 4 * i), F.shiftrightunsigned("cell", 4 * i).bitwiseAND(F.lit(15))
        up.append(F.when(count < 4, F.col("cell") + step))
        down.append(F.when(count > 0, F.col("cell") - step))

    def filed(places: list[Column], name: str) -> DataFrame:
        return at.select(F.col("bits").alias(name), F.explode(F.array_compact(F.array(*places))).alias("place"))

    # Of two points a step or two apart, one meets the other from below or level; so only one side goes down.
    left, right = filed(here + up, "x"), filed(here + up + down, "y")
    met = left.join(right, "place").where(
        (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _labelled(rows: DataFrame, max_bits: int) -> DataFrame:
    """bits, group, component_id for every distinct value of ``bits`` in rows (doc_id, bits)."""
    each = settle(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    joined = components(linked_fingerprints(each, max_bits)).select(F.col("node").alias("bits"), "component")
    each = each.join(joined, "bits", "left").withColumn("group", F.coalesce("component", "bits"))
    first = each.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return each.select("bits", "group").join(first, "group")


def document_components(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) per row of ``docs``."""
    rows = settle(in_small_batches(docs).select("doc_id", fingerprint(F.col("text"), words_each).alias("bits")))
    found = rows.join(_labelled(rows, max_bits), "bits")
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: least doc_id, then least digest of the text."""
    rows = settle(in_small_batches(docs).select(
        "doc_id", F.xxhash64("text").alias("digest"), fingerprint(F.col("text"), words_each).alias("bits")))
    # least values that are not null come first; the third field only makes nulls comparable
    order = F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    first = rows.join(_labelled(rows, max_bits), "bits").groupBy("group").agg(F.min(order).alias("first"))
    keys = first.select("first.no_id", "first.id", "first.digest")
    chosen = keys.select(
        F.when(~F.col("no_id"), F.col("id")).alias("__chosen_id"), F.col("digest").alias("__chosen_digest"))
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__chosen_id")) & (
        F.xxhash64("text") == F.col("__chosen_digest")), "left_semi")
    # equal doc_id and text: one row of them stays
    return kept.dropDuplicates(["doc_id", "text"])
