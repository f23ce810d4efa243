"""Exact order statistics that never gather a whole group in one task.

``percentile`` keeps every distinct value of a group in one task, which is fine for groups bounded
by the calendar (a station's days) but not for groups that grow with the number of stations. The
functions here sort nothing but the few rows around each wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.lineage import settle

SUB_BUCKETS = 4096
# Keys are mostly weeks, weekdays or labels. Up to this many keys the edges (a few numbers per key)
# are broadcast, so rows of a hot key stay where they are; beyond it hot keys are salted.
BROADCAST_KEYS = 10_000
SALTS = 32


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    whole_below: int = 1_000,
    accuracy: int = 1_000,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per key, plus the row count ``n``.

    1. A mergeable sketch gives, per key, two edges around each wanted quantile. Its error is at
       most 1/accuracy of the rows, and the edges stand five times as far off.
    2. One counting pass: rows between edges keep their value, all others collapse into one count
       per gap between edges. Map-side combining leaves only the narrow bands to move.
    3. Bands are cut into sub-buckets; running counts over the buckets find those that hold a
       wanted rank, and only their rows are ordered.

    Keys with up to ``whole_below`` rows keep all their values, because edges need a few rows between
    them. Where no key has more, a plain aggregate does: its groups are bounded by that number. Rows with an empty key or value are left out. ``df`` is
    read several times: settle it first if it is costly.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).na.drop()
    if whole_below * 5 < accuracy * 2:
        raise ValueError("edges of a key with few rows need a finer sketch or a larger whole_below")
    margin = 5.0 / accuracy
    marks = [m for p in probs.values() for m in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.percentile_approx("v", marks, accuracy)
    edges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("edges"))
    few_keys = True
    if keys:
        edges = settle(edges)
        number, largest = edges.agg(F.count(F.lit(1)), F.max("n")).first()
        if number and largest <= whole_below:
            found = rows.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("q"),
                                            F.count(F.lit(1)).alias("n"))
            return found.select(*keys, *[F.col("q")[i].alias(name) for i, name in enumerate(probs)], "n")
        few_keys = number <= broadcast_keys
        if few_keys:
            placed = rows.join(F.broadcast(edges), keys)
        else:
            copies = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            placed = salted.join(copies, [*keys, "salt"]).drop("salt")
    else:
        one = edges.select(F.struct("n", "edges").alias("s")).scalar()
        placed = rows.withColumn("s", one).select("v", F.col("s.n").alias("n"), F.col("s.edges").alias("edges"))

    v = F.col("v")
    edge = [F.col("edges")[i] for i in range(len(marks))]
    small = F.col("n") <= whole_below
    in_band = _any([v.between(edge[2 * i], edge[2 * i + 1]) for i in range(len(probs))])
    # Rises with v and changes at every edge; a value on an edge has a place of its own.
    place = reduce(lambda a, b: a + b, [(v > e).cast("int") + (v >= e).cast("int") for e in edge])
    below = F.greatest(F.lit(None).cast("double"), *[F.when(e <= v, e) for e in edge])
    above = F.least(F.lit(None).cast("double"), *[F.when(e > v, e) for e in edge])
    share = F.try_divide(v - below, above - below)
    sub = F.least(F.floor(share * SUB_BUCKETS), F.lit(SUB_BUCKETS - 1)).cast("int")
    keep = small | in_band
    counts = (
        placed.select(
            *keys, "n",
            F.when(small, 0).otherwise(place).alias("place"),
            F.when(~small & in_band, F.coalesce(sub, F.lit(0))).otherwise(0).alias("sub"),
            F.when(keep, v).alias("v"),
        )
        .groupBy(*keys, "n", "place", "sub", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )

    group = keys or [F.lit(0)]
    buckets = counts.groupBy(*keys, "n", "place", "sub").agg(F.sum("c").alias("c"))
    ordered = Window.partitionBy(*group).orderBy("place", "sub")
    buckets = buckets.withColumn("b_end", F.sum("c").over(ordered)).withColumn("b_start", F.col("b_end") - F.col("c"))

    def ranks(p: float) -> tuple[Column, Column]:
        at = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(at)
        return low, F.least(low + 1, F.col("n") - 1)

    wanted = [r for p in probs.values() for r in ranks(p)]
    hit = buckets.where(_any([(r >= F.col("b_start")) & (r < F.col("b_end")) for r in wanted]))
    join_on = [*keys, "n", "place", "sub"]
    # At most two rows per key and wanted quantile.
    targets = hit.select(*join_on, "b_start")
    near = counts.join(F.broadcast(targets) if few_keys else targets, join_on)
    in_bucket = Window.partitionBy(*group, "place", "sub").orderBy("v")
    near = near.withColumn("end", F.col("b_start") + F.sum("c").over(in_bucket)).withColumn(
        "start", F.col("end") - F.col("c")
    )
    # A wanted rank in a collapsed gap would mean a broken sketch: fail, never guess.
    found = F.when(F.col("v").isNull(), F.raise_error(F.lit("quantile outside its band")).cast("double")).otherwise(F.col("v"))

    def at_rank(r: Column) -> Column:
        return F.max(F.when((r >= F.col("start")) & (r < F.col("end")), found))

    picks = []
    for name, p in probs.items():
        low, high = ranks(p)
        picks += [at_rank(low).alias(f"{name}__low"), at_rank(high).alias(f"{name}__high")]
    out = near.groupBy(*keys, "n").agg(*picks)

    def interpolate(name: str, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return out.select(*keys, *[interpolate(name, p) for name, p in probs.items()], "n")


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``position`` (1, 2, ...) in the global ascending order, and the row count ``n_total``.

    The sort is a range partitioning, so no task sees all rows. Rows are numbered inside their
    partition, and the partitions' sizes (one row per partition) give the offsets. The sorted rows
    are written first, so that sizes and numbers come from the same partitions.
    """
    numbered = settle(df.orderBy(*order).withColumn("raw", F.monotonically_increasing_id()))
    part = F.shiftright("raw", 33).cast("int")
    numbered = numbered.withColumn("part", part)
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("part").alias("o_part"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(Window.partitionBy(F.lit(0))).alias("n_total"),
    )
    inside = F.col("raw") - F.shiftleft(F.col("part").cast("long"), 33)
    # One row per partition of the sort: broadcast is bounded by the partition count.
    return numbered.join(F.broadcast(offsets), F.col("part") == F.col("o_part")).withColumn(
        "position", F.col("offset") + inside + 1
    ).drop("raw", "part", "o_part", "offset")
