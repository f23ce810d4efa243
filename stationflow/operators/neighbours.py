"""Exact k nearest neighbours as a blocked join, in two passes.

Neither side is paired in full. Train rows are grouped into cells around pivots, and there are the more pivots the
more rows there are, so that cells shrink as the table grows. First a query visits the cells nearest to it, as many as
hold k rows together; the k-th distance found there is a bound that is always reached. Then it visits those
of the other cells that can hold a nearer row, by the triangle inequality. Cells are cut into blocks of limited
size, and visiting queries into batches of limited size, so no task gets an unbounded group; a visit of a
query to a block yields k rows at most, and rows beyond the bound not at all.

Distance: standardized features, plus 2 where the stations differ (their indicators differ in two
places), or plus 1 for a query station that the train rows do not know.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.lineage import settle

CELL_ROWS, MOST_PIVOTS = 64, 16_384  # rows that a cell is meant to hold; pivots the driver holds (12 numbers each)
TRAIN_BLOCK = 20_000
QUERY_BLOCK = 5_000
CHUNK = 2_000_000  # distance entries held at once inside a task


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _own_cell(pivots: np.ndarray) -> Column:
    """The nearest pivot of a row and its distance, as a struct column."""
    @F.pandas_udf("cell int, reach double")
    def nearest_pivot(x: pd.Series) -> pd.DataFrame:
        cell, reach, step = [], [], max(1, CHUNK // len(pivots))
        for at in range(0, len(x), step):
            d2 = _squared_distances(np.stack(x.iloc[at:at + step].to_numpy()), pivots)
            cell.append(d2.argmin(axis=1))
            reach.append(np.sqrt(np.take_along_axis(d2, cell[-1][:, None], 1)[:, 0]))
        return pd.DataFrame({"cell": np.concatenate(cell or [np.zeros(0, int)]).astype("int32"),
                             "reach": np.concatenate(reach or [np.zeros(0)])})

    return nearest_pivot("x")


def _nearest_in_block(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Up to k nearest train rows of one block for each query of one batch."""
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "d2": [], "y": []}).astype({"qid": "int64"})
        train, ty, ts = np.stack(right["x"].to_numpy()), right["y"].to_numpy(), right["t_station"].to_numpy()
        queries, qs = np.stack(left["x"].to_numpy()), left["station_id"].to_numpy()
        apart, bound = left["apart"].to_numpy(), left["bound"].to_numpy()
        keep = min(k, len(train))
        out = []
        step = max(1, CHUNK // len(train))
        for at in range(0, len(queries), step):
            part = slice(at, at + step)
            # Differences, not the expanded square: equal rows must come out at exactly zero.
            d2 = np.zeros((len(queries[part]), len(train)))
            for j in range(train.shape[1]):
                d2 += (queries[part, j][:, None] - train[None, :, j]) ** 2
            d2 += np.where(qs[part][:, None] == ts[None, :], 0.0, apart[part][:, None])
            best = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
            edge = np.take_along_axis(d2, best, 1).max(1)
            for i in np.flatnonzero((d2 <= edge[:, None]).sum(1) > keep):  # ties across the edge
                near = np.flatnonzero(d2[i] <= edge[i])
                best[i] = near[np.lexsort((ty[near], d2[i, near]))[:keep]]
            found = np.take_along_axis(d2, best, 1)
            inside = found <= bound[part][:, None]
            out.append(pd.DataFrame({
                "qid": np.repeat(left["qid"].to_numpy()[part], keep)[inside.ravel()],
                "d2": found[inside],
                "y": ty[best][inside],
            }))
        return pd.concat(out)

    return search


def nearest(train: DataFrame, queries: DataFrame, inputs: Sequence[str], k: int, target: str = "y",
            pivots: int | None = None, train_block: int = TRAIN_BLOCK, query_block: int = QUERY_BLOCK,
            report: dict | None = None) -> DataFrame:
    """The k nearest train rows of every query row: qid, place, d2, y.

    ``queries`` needs a unique ``qid``. Ties at the k-th distance are settled by the smaller target. ``report`` is
    told the share of all (query, train row) pairs that were looked at.
    """
    vector = F.array(*inputs)
    train = settle(train.select(
        F.col("station_id").alias("t_station"), F.col(target).cast("double").alias("y"), vector.alias("x")))
    known = train.groupBy("t_station").agg(F.lit(2.0).alias("apart"))
    queries = settle(queries.select("qid", "station_id", vector.alias("x")).join(
        known, F.col("station_id") == F.col("t_station"), "left"
    ).select("qid", "station_id", "x", F.coalesce("apart", F.lit(1.0)).alias("apart")))

    n = train.count()
    if not n:
        raise ValueError("no train rows")
    pivots = pivots or min(MOST_PIVOTS, max(1, n // CELL_ROWS))
    # Rows of low hash, spread over the data, the same on every run; about twice as many as wanted, then exactly as many.
    place = F.pmod(F.xxhash64("x"), F.lit(1 << 30))
    few = train.select("x").where(place * F.lit(float(n)) < 2.0 * pivots * (1 << 30) + 64.0 * (1 << 30)).distinct()
    centres = few.orderBy(F.xxhash64("x"), "x").limit(pivots).collect() or train.select("x").limit(1).collect()
    centre = np.array([c[0] for c in centres])
    cells = settle(
        train.withColumn("p", _own_cell(centre)).select("*", "p.cell", "p.reach").drop("p")
        .withColumn("block", F.pmod(F.xxhash64("x", "y", "t_station", F.rand(7)), F.lit(1 << 30)))
    )
    # Per cell: size, and the least and largest distance from its pivot. At most `pivots` rows.
    stats = settle(cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.min("reach").alias("inner"), F.max("reach").alias("outer")))
    size, inner, outer = np.zeros(len(centre), np.int64), np.zeros(len(centre)), np.full(len(centre), -np.inf)
    for s in stats.collect():
        size[s["cell"]], inner[s["cell"]], outer[s["cell"]] = s["size"], s["inner"], s["outer"]
    blocks = F.broadcast(stats.select("cell", "size", F.ceil(F.col("size") / train_block).cast("int").alias("blocks")))
    held = np.flatnonzero(size)

    def first_cells(d: np.ndarray) -> np.ndarray:
        """Which cells a query takes first: the nearest ones, up to the one that brings their rows to k."""
        order = held[np.argsort(d[held], kind="stable")]
        return order[:np.searchsorted(np.cumsum(size[order]), min(k, n)) + 1]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_first(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series([first_cells(d).astype("int32") for d in np.sqrt(_squared_distances(np.stack(x.to_numpy()), centre))])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_then(x: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        out = []
        for d, limit in zip(np.sqrt(_squared_distances(np.stack(x.to_numpy()), centre)), bound.to_numpy()):
            least = np.maximum(d - outer, inner - d)  # no row of a cell is nearer
            visit = (least <= np.sqrt(limit) * (1 + 1e-9) + 1e-9) & (size > 0)
            visit[first_cells(d)] = False
            out.append(np.flatnonzero(visit).astype("int32"))
        return pd.Series(out)

    train_side = cells.join(blocks, "cell").withColumn("block", (F.col("block") % F.col("blocks")).cast("int")).select(
        "cell", "block", "x", "y", "t_station"
    )

    def looked_up(asked: DataFrame) -> DataFrame:
        """The nearest rows that queries (with cells to visit) find there, up to k from each block."""
        visits = settle(asked.withColumn("cell", F.explode("cells")).drop("cells").join(blocks, "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        if report is not None:
            report["pairs"] = report.get("pairs", 0) + (visits.agg(F.sum(F.col("size") / F.col("blocks"))).first()[0] or 0)
        visits = visits.drop("size", "blocks")
        # Query batches: each block is copied to as many batches as its visitors need.
        load = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("batches"))
        visits = visits.join(load, ["cell", "block"]).withColumn(
            "batch", F.pmod(F.xxhash64("qid"), F.col("batches")).cast("int")
        ).drop("batches")
        copies = train_side.join(load, ["cell", "block"]).withColumn(
            "batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))
        ).drop("batches")
        keys = ["cell", "block", "batch"]
        return visits.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(
            _nearest_in_block(k), "qid long, d2 double, y double"
        )

    best = Window.partitionBy("qid").orderBy("d2", "y")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

    near = settle(top(looked_up(queries.withColumns({"cells": cells_first("x"), "bound": F.lit(float("inf"))}))))
    bounds = near.groupBy("qid").agg(F.max("d2").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    again = queries.join(bounds.drop("n"), "qid")  # with fewer than k rows in all, the first pass has seen them
    found = looked_up(again.withColumn("cells", cells_then("x", "bound")))
    if report is not None:
        report["share"] = report["pairs"] / (n * max(1, queries.count()))
    return top(near.drop("place").unionByName(found))


def neighbour_means(neighbours: DataFrame, ks: Sequence[int], prefix: str = "KNN") -> DataFrame:
    """Mean target of the first k neighbours for each k, plain and weighted by inverse distance.

    Where a neighbour is at distance zero, the weighted mean is over those at zero only.
    """
    near = neighbours.withColumns({
        "d": F.sqrt("d2"),
        "hits": F.min("d2").over(Window.partitionBy("qid")) == 0,
    }).withColumn("w", F.when(F.col("hits"), (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "d")))
    out = []
    for k in ks:
        first = F.col("place") <= k
        weight, value = F.when(first, F.col("w")), F.when(first, F.col("y"))
        out.append((F.sum(weight * F.col("y")) / F.sum(weight)).alias(f"{prefix}_k{k}_dist"))
        out.append(F.avg(value).alias(f"{prefix}_k{k}_uniform"))
    return near.groupBy("qid").agg(*out)
