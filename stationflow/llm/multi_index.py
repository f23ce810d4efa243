"""Approximate nearest neighbours by inner product: an inverted multi-index.

The two halves of a vector are quantised by a codebook each; a cell is a pair of centroids. A query
visits cells in the order of the summed inner products of its halves with the two centroids, by a
heap over pairs, until the visited cells hold enough rows; these are ranked by the exact inner
product of the original vectors.

Codebooks are fitted on at most SAMPLE rows (those with the least hash of their id); every row is
indexed. How many rows a query must visit is estimated on the same sample: the share that covers
TARGET of the true neighbours of TRIAL_QUERIES sample rows. The result is then audited: the AUDIT queries with the
least hash are held against all rows, and while fewer than WANTED of their true neighbours have been found, twice as
many rows are visited, up to all.

Cells are dealt to shards of bounded size; a cell that alone is larger, such as that of one very
common vector, is spread over several. A shard's rows are moved once, however many queries there are: they come first in
their partition's order, and the queries that visit the shard stream past them. A query first visits its best
cells; the k-th score it finds there goes with it to the others, which answer only with rows that are no worse.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have
another length than most take no part, as query or candidate. Rows equal in id and vector count
once; rows that share an id are never each other's neighbours. Ties go to the smaller id. An empty
table, or one without two rows, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from stationflow.lineage import staged
from stationflow.llm import vectors as V

SAMPLE, TRIAL_QUERIES, TARGET = 20_000, 300, 0.95
AUDIT, WANTED = 100, 0.92
ROWS_PER_CELL, MOST_CENTROIDS, KMEANS_ROUNDS = 64, 256, 12
SHARD_ROWS, BATCH_QUERIES = 8_192, 512
FIRST = 10  # times k: rows that a query visits to learn a bound


def kmeans(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), size=k, replace=len(rows) < k)]
    for _ in range(KMEANS_ROUNDS):
        nearest = nearest_centre(rows, centres)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the first and the second half of the vectors."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def cell(self, rows: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        a, b = nearest_centre(rows[:, :half], self.first), nearest_centre(rows[:, half:], self.second)
        return a * len(self.second) + b

    def traverse(self, query: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
        """Cells that hold rows, best sum first, until they hold ``enough`` rows."""
        half = self.first.shape[1]
        one, two = self.first @ query[:half], self.second @ query[half:]
        i_of, j_of = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        one, two, width = one[i_of], two[j_of], len(two)
        heap, out, held = [(-(one[0] + two[0]), 0, 0)], [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(i_of[i] * width + j_of[j])
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if j + 1 < width:
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
        return out


def fit(sample: np.ndarray, rows: int) -> Codebooks:
    """Codebooks for a table of ``rows`` rows, from a sample of them."""
    k = min(MOST_CENTROIDS, max(2, int((rows / ROWS_PER_CELL) ** 0.5)))
    half = max(1, sample.shape[1] // 2)
    return Codebooks(kmeans(sample[:, :half], k, 1), kmeans(sample[:, half:], k, 2))


def share_to_visit(books: Codebooks, sample: np.ndarray, k: int, target: float = TARGET) -> float:
    """Share of all rows after which ``target`` of the true neighbours have been met, on the sample."""
    cells = books.cell(sample)
    counts = np.bincount(cells, minlength=books.cells)
    shares = []
    for q in range(0, len(sample), max(1, len(sample) // TRIAL_QUERIES)):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        true = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
        order = books.traverse(sample[q], counts, np.inf)
        met = np.zeros(books.cells)
        met[order] = np.cumsum(counts[order])
        shares.extend(met[cells[true]] / len(sample))
    return float(np.quantile(shares, target)) if shares else 1.0


def _shards(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell."""
    first, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > SHARD_ROWS:
            shard, held = shard + 1, 0
        first[cell], number[cell] = shard, max(1, -(-int(n) // SHARD_ROWS))
        shard, held = (shard, held + n) if number[cell] == 1 else (shard + number[cell], 0)
    return first, number


def _answers(k: int, width: int):
    """Streams over partitions ordered by shard, rows before queries; gives the best rows of the wanted cells."""
    def answered(ids, vecs, cells, local, asked: pd.DataFrame) -> pd.DataFrame:
        queries, out = V.matrix(asked["vec"], width), []
        rough = queries @ vecs.T
        slack = 1e-9 * (np.abs(queries).max(initial=0) * np.abs(vecs).max(initial=0) * vecs.shape[1] + 1e-300)
        for row, q, qid, wanted, bound in zip(rough, queries, asked["id"], asked["cells"], asked["bound"]):
            here = np.isin(cells, np.frombuffer(wanted, "<i4"))[local] & (ids != qid) & (row >= bound - slack)
            at = np.flatnonzero(here)
            if len(at) > k:
                at = at[row[at] >= np.partition(row[at], -k)[-k] - slack]
            scores = (vecs[at] * q).sum(axis=1)
            best = np.lexsort((ids[at], -scores))[:k]
            best = best[scores[best] >= bound]
            out.append(pd.DataFrame({"query_id": qid, "id": ids[at][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, ready = None, [], None
        for frame in frames:
            for number, part in frame.groupby("shard", sort=False):
                if number != shard:
                    shard, held, ready = number, [], None
                rows, asked = part[part["cells"].isna()], part[part["cells"].notna()]
                if len(rows):
                    held.append(rows[["id", "vec", "cell"]])
                for at in range(0, len(asked), BATCH_QUERIES):
                    if ready is None:
                        own = pd.concat(held) if held else rows
                        cells, local = np.unique(own["cell"].to_numpy(), return_inverse=True)
                        ready = own["id"].to_numpy(), V.matrix(own["vec"], width), cells, local
                    if len(ready[0]):
                        yield answered(*ready, asked.iloc[at:at + BATCH_QUERIES])

    return stream


def nearest(
    table: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", report: dict | None = None,
) -> DataFrame:
    """query_id, rank, ``key``, score: the k nearest found for the rows of ``table`` that ``is_query`` holds for.

    ``report`` is told the share of rows a query visits, and the recall of the audit.
    """
    rows = V.packed(table, key, vector).withColumnRenamed(key, "id")
    width, spark = V.width_of(rows), table.sparkSession
    total = rows.count()
    if total < 2:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.select("id", "vec").where(place * total < 2.0 * SAMPLE)  # about twice as many as wanted, then exactly as many
    sample = V.matrix(few.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).toPandas()["vec"], width)
    books = fit(sample, total)
    enough = min(total, share_to_visit(books, sample, k) * total + k + 1)

    @pandas_udf("int")
    def cell_of(vecs: pd.Series) -> pd.Series:
        return pd.Series(books.cell(V.matrix(vecs, width)) if len(vecs) else [], dtype="int32")

    indexed = staged(rows.withColumn("cell", cell_of("vec")))
    counts = np.zeros(books.cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared rows
        counts[r["cell"]] = r["count"]
    first, number = _shards(counts)
    queries = staged(indexed.where(is_query(F.col("id"))).select("id", "vec"))

    @pandas_udf("int")
    def shard_of(cells: pd.Series, hashes: pd.Series) -> pd.Series:
        at = cells.to_numpy()
        return pd.Series(first[at] + hashes.to_numpy() % number[at], dtype="int32")

    shards = max(1, int((first + number).max()))
    placed = indexed.select(
        shard_of("cell", F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))).alias("shard"), "id", "vec", "cell",
        F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("double").alias("bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def searched(enough: float) -> DataFrame:
        def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A row for each shard that a query visits, first or then, with the cells it visits there."""
            for frame in frames:
                out = []
                for qid, vec, q in zip(frame["id"], frame["vec"], V.matrix(frame["vec"], width)):
                    by_shard: dict[tuple[bool, int], list[int]] = {}
                    held = 0
                    for cell in books.traverse(q, counts, enough):
                        for s in range(first[cell], first[cell] + number[cell]):
                            by_shard.setdefault((held >= FIRST * k, int(s)), []).append(cell)
                        held += counts[cell]
                    out += [(s, later, qid, vec, np.array(c, "<i4").tobytes()) for (later, s), c in by_shard.items()]
                yield pd.DataFrame(out, columns=["shard", "later", "id", "vec", "cells"])

        asked = staged(queries.mapInPandas(probes, "shard int, later boolean, id long, vec binary, cells binary"))

        def looked_up(some: DataFrame) -> DataFrame:
            visits = some.select("shard", "id", "vec", F.lit(None).cast("int").alias("cell"), "cells", "bound")
            both = placed.unionByName(visits).repartition(shards, "shard").sortWithinPartitions("shard", F.col("cells").isNotNull())
            found = both.mapInPandas(_answers(k, width), "query_id long, id long, score double").distinct()
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        early = staged(looked_up(asked.where("NOT later").withColumn("bound", F.lit(float("-inf")))))
        bounds = early.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        then = asked.where("later").join(bounds, "id", "left").withColumn(
            "bound", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")))
        found = early.drop("rank").unionByName(looked_up(then).drop("rank")).distinct()
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return staged(ranked.select("query_id", "rank", "id", "score"))

    while True:
        found = searched(enough)
        recall = _recall(indexed, queries, found, k, width) if enough < total else 1.0
        if report is not None:
            report.update(share=enough / total, recall=recall)
        if recall >= WANTED:
            return found.withColumnRenamed("id", key)
        enough = min(total, 2 * enough)


def _recall(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int, width: int) -> float:
    """Share of the true neighbours of AUDIT queries, held against all rows, that have been found."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(AUDIT).toPandas()
    if not len(asked):
        return 1.0
    ids, vecs = asked["id"].to_numpy(), V.matrix(asked["vec"], width)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, out = frame["id"].to_numpy(), []
            scores = vecs @ V.matrix(frame["vec"], width).T if len(own) else np.zeros((len(ids), 0))
            for qid, row in zip(ids, scores):
                at = np.flatnonzero(own != qid)
                at = at[np.argsort(-row[at], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": qid, "id": own[at], "score": row[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    true = rows.select("id", "vec").mapInPandas(near, "query_id long, id long, score double").distinct()
    true = true.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id")
    row = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(
        F.count(F.lit(1)), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0
