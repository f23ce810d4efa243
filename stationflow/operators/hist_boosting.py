"""Gradient boosting over binned features, with a leaf cap, an L2 term and a least leaf size.

Features are cut at up to 254 quantile edges (a mergeable sketch; distinct values where there are few), stations
enter as splits "station = s". Each round fits a tree to the residuals: leaves wait in a queue by
gain, the best one is split next, until the cap of leaves is reached or no split gains. The gain of a split is
the rise of the summed G^2 / (n + l2) over leaves; a leaf adds rate * G / (n + l2) to its rows.

A pass over the rows is one aggregate: every task sums residuals by (node, feature, bin) and (node, station) for the
nodes whose best split is still unknown, the sums meet in a shuffle, running sums over bins give the gains, and the
driver gets one row per node. A pass settles all nodes that the queue can reach with the gains known so far, so a
tree takes about as many passes as it is deep, not as many as it has leaves. Trees are small (the cap of leaves), and
rows keep their prediction as of every KEPT rounds; the trees since then are applied on the way.

Residuals are summed in millionths as whole numbers, so that splits don't depend on the order of rows or on
partitions. Ties go to the first numeric feature, the lowest edge, the smallest station; in the queue to the older
node. A table of at most ``local_rows`` rows is boosted by one task over one set of arrays, with the same sums.

``subsample`` below 1 takes, in every round, the rows whose hash of (seed, round, row) is below that share.
With ``patience``, a share of the train rows (by hash) is held out and rounds end when their squared error has not
fallen by more than ``tolerance`` over that many rounds.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.lineage import discard, staged

SCALE = 1_000_000
PRIME = (1 << 31) - 1
BINS, SKETCH = 255, 10_000
KEPT = 16
ROWS_AT_A_TIME = 100_000
DEEPEST = 62


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 400
    rate: float = 0.05
    leaves: int = 31
    deepest: int = DEEPEST
    min_leaf: int = 20
    l2: float = 0.0
    subsample: float = 1.0
    seed: int = 7
    patience: int = 0
    held_out: float = 0.1
    tolerance: float = 1e-7
    local_rows: int = 50_000

    def __post_init__(self) -> None:
        if self.rounds < 0 or self.leaves < 1 or self.min_leaf < 1 or self.l2 < 0 or not 0 < self.subsample <= 1:
            raise ValueError("rounds and l2 must not be negative, leaves and min_leaf positive, subsample in (0, 1]")


@dataclass
class Tree:
    """Nodes by number, from the root 0. ``feature`` is -2 in a leaf, -1 for a station split."""

    feature: list[int] = field(default_factory=lambda: [-2])
    cut: list[float] = field(default_factory=lambda: [0.0])
    station: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: float, station: int) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.station[node], self.left[node] = feature, cut, station, first
        for _ in range(2):
            self.feature.append(-2)
            self.cut.append(0.0)
            self.station.append(0)
            self.left.append(0)
            self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
        return first, first + 1

    def nodes_of(self, x: np.ndarray, station: np.ndarray) -> np.ndarray:
        """The leaf of every row; the left child takes x <= cut, or the station itself."""
        feature, cut, chosen, left = (np.array(v) for v in (self.feature, self.cut, self.station, self.left))
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            f = feature[at[moving]]
            moving, f = moving[f > -2], f[f > -2]
            node = at[moving]
            goes_left = np.where(f >= 0, x[moving, np.maximum(f, 0)] <= cut[node], station[moving] == chosen[node])
            at[moving] = left[node] + ~goes_left
        return at


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    edge: int
    station: int
    n_left: int
    s_left: int


class Boosted:
    """The start value, the edges of the features, and the trees."""

    def __init__(self, start: float, edges: list[np.ndarray]):
        self.start, self.edges, self.trees = start, edges, []

    def add(self, predicted: np.ndarray, x: np.ndarray, station: np.ndarray, first: int = 0) -> np.ndarray:
        for tree in self.trees[first:]:
            predicted = predicted + np.array(tree.value)[tree.nodes_of(x, station)]
        return predicted

    def predict(self, x: np.ndarray, station: np.ndarray) -> np.ndarray:
        return self.add(np.full(len(x), self.start), x, station)


def hashed(row: np.ndarray, number: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for every row, from the row's number, another number and the seed."""
    h = (row % PRIME * 48_271 + number * 69_621 + seed * 40_692 + 1) % PRIME
    for step in (11, 29, 53):
        h = (h * 48_271 + step) % PRIME
        h = (h * h + 3 * h + step) % PRIME
    return h / PRIME


def residuals(y: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """In millionths, rounded half away from zero."""
    r = (y - predicted) * SCALE
    return (np.sign(r) * np.floor(np.abs(r) + 0.5)).astype(np.int64)


# --- sums of a batch of rows, and the best split from sums -----------------------------------------

def cells_of(node: np.ndarray, bins: np.ndarray, station: np.ndarray, q: np.ndarray) -> pd.DataFrame:
    """node, feature (-1: station), bin (the station's number there), n, s."""
    parts = []
    for feature in [-1, *range(bins.shape[1])]:
        column = station if feature < 0 else bins[:, feature]
        order = np.lexsort((column, node))
        a, b = node[order], column[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, int)
        if len(starts):
            parts.append(pd.DataFrame({
                "node": a[starts], "feature": feature, "bin": b[starts].astype(np.int64),
                "n": np.diff(np.r_[starts, len(order)]), "s": np.add.reduceat(q[order], starts)}))
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "feature", "bin", "n", "s")})
    return pd.concat(parts) if parts else empty


def _best_here(cells: pd.DataFrame, settings: BoostSettings) -> dict[int, Split]:
    """The best split of every node, from all its cells."""
    out = {}
    for node, own in cells.groupby("node"):
        totals = own[own["feature"] == -1]
        n, s = int(totals["n"].sum()), int(totals["s"].sum())
        best = None
        own = own.sort_values(["feature", "bin"], key=lambda c: c.where(c >= 0, 1 << 40) if c.name == "feature" else c)
        for feature, part in own.groupby("feature", sort=False):
            nl, sl = part["n"].to_numpy(), part["s"].to_numpy()
            if feature >= 0:
                nl, sl = nl.cumsum(), sl.cumsum()
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gain_of(nl.astype(float), sl.astype(float), float(n), float(s), settings.l2)
            gain = np.where((nl >= settings.min_leaf) & (n - nl >= settings.min_leaf), gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > (best.gain if best else 0.0):
                at = int(part["bin"].iloc[k])
                best = Split(float(gain[k]), int(feature), at if feature >= 0 else 0, at if feature < 0 else 0, int(nl[k]), int(sl[k]))
        if best:
            out[int(node)] = best
    return out


def gain_of(nl, sl, n, s, l2: float):
    """For columns and arrays alike."""
    return sl * sl / (nl + l2) + (s - sl) * (s - sl) / (n - nl + l2) - s * s / (n + l2)


def _best_of_all(partials: DataFrame, settings: BoostSettings) -> dict[int, Split]:
    """The same over cells from all tasks; the driver gets a row per node."""
    cells = partials.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = cells.where("feature = 0").groupBy("node").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    running = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    numeric = cells.where("feature >= 0").withColumns({"n": F.sum("n").over(running), "s": F.sum("s").over(running)})
    both = numeric.unionByName(cells.where("feature < 0"))  # at most 255 cells of a feature and node; stations as they come
    both = both.join(F.broadcast(totals), "node")  # a row per node, fewer than two per leaf of a tree
    fits = (F.col("n") >= settings.min_leaf) & (F.col("n_all") - F.col("n") >= settings.min_leaf)
    nl, sl, n, s = (F.col(c).cast("double") for c in ("n", "s", "n_all", "s_all"))
    scored = both.where(fits).withColumn("gain", gain_of(nl, sl, n, s, settings.l2)).where("gain > 0")
    order = F.struct((-F.col("gain")).alias("minus"), F.when(F.col("feature") < 0, 1 << 30).otherwise(F.col("feature")).alias("place"),
                     F.col("bin").alias("bin"), F.col("feature").alias("feature"), F.col("n").alias("n"), F.col("s").alias("s"))
    rows = scored.groupBy("node").agg(F.min(order).alias("b")).select("node", "b.*").collect()
    return {r["node"]: Split(-r["minus"], r["feature"], r["bin"] if r["feature"] >= 0 else 0,
                             r["bin"] if r["feature"] < 0 else 0, r["n"], r["s"]) for r in rows}


# --- one tree --------------------------------------------------------------------------------------

class Growing:
    """A tree whose queue is played through as far as gains are known."""

    def __init__(self, edges: list[np.ndarray], settings: BoostSettings):
        self.edges, self.settings, self.tree = edges, settings, Tree()
        self.best: dict[int, Split | None] = {}  # known nodes
        self.sums: dict[int, tuple[int, int]] = {}
        self.unknown = [0]

    def learn(self, found: dict[int, Split], root: tuple[int, int] | None = None) -> None:
        """Takes in the best splits of the nodes that were unknown, and plays the queue again."""
        if root:
            self.sums[0] = root
        for node in self.unknown:
            self.best[node] = found.get(node)
        self.unknown = []
        self.leaves, self.inner = [0], []
        queue = [(-self.best[0].gain, 0)] if self.best[0] else []
        while queue and len(self.leaves) < self.settings.leaves:
            _, node = heapq.heappop(queue)
            split = self.best[node]
            if self.tree.feature[node] == -2:
                cut = float(self.edges[split.feature][split.edge]) if split.feature >= 0 else 0.0
                n, s = self.sums[node]
                for child, sums in zip(self.tree.split(node, split.feature, cut, split.station),
                                       ((split.n_left, split.s_left), (n - split.n_left, s - split.s_left))):
                    self.sums[child] = sums
            self.inner.append(node)
            self.leaves.remove(node)
            for child in (self.tree.left[node], self.tree.left[node] + 1):
                self.leaves.append(child)
                ends = self.sums[child][0] < 2 * self.settings.min_leaf or self.tree.depth[child] >= self.settings.deepest
                if child not in self.best and not ends:
                    self.unknown.append(child)
                elif self.best.get(child):
                    heapq.heappush(queue, (-self.best[child].gain, child))

    def finished(self) -> Tree:
        """The tree of the nodes that the queue split; what was tried beyond them is cut off again."""
        tree, kept = self.tree, set(self.inner)
        for node in range(len(tree.feature)):
            if node not in kept:
                tree.feature[node] = -2
        for leaf in self.leaves:
            n, s = self.sums[leaf]
            tree.value[leaf] = self.settings.rate * (s / SCALE) / (n + self.settings.l2)
        return tree


def _grow(growing: Growing, passes, root) -> Tree:
    """``passes`` gives the best splits of the unknown nodes; ``root`` the size and sum of all rows."""
    n, s = root
    if n < 2 * growing.settings.min_leaf or growing.settings.leaves < 2 or growing.settings.deepest < 1:
        growing.unknown = []
        growing.best[0], growing.sums[0], growing.leaves, growing.inner = None, root, [0], []
    while growing.unknown:
        growing.learn(passes(growing), root)
    return growing.finished()


def _stops(errors: list[float], settings: BoostSettings) -> bool:
    """Whether none of the last ``patience`` errors is below the one before them by more than the tolerance."""
    if not settings.patience or len(errors) <= settings.patience:
        return False
    before, last = errors[-settings.patience - 1], errors[-settings.patience:]
    return min(last) >= before - settings.tolerance


# --- all rows in one set of arrays, or in many tasks ------------------------------------------------

def bins_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The first edge at or above each value; the number of edges if there is none."""
    return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])


def boosted_here(row, x, station, y, edges: list[np.ndarray], start: float, settings: BoostSettings) -> Boosted:
    model = Boosted(start, edges)
    tested = hashed(row, -1 % PRIME, settings.seed) < settings.held_out if settings.patience else np.zeros(len(y), bool)
    bins, predicted, errors = bins_of(x, edges), np.full(len(y), start), []
    for number in range(settings.rounds):
        used = ~tested
        if settings.subsample < 1:
            used &= hashed(row, number, settings.seed) < settings.subsample
        q = residuals(y, predicted)

        def passes(growing: Growing) -> dict[int, Split]:
            node = growing.tree.nodes_of(x, station)
            own = used & np.isin(node, growing.unknown)
            return _best_here(cells_of(node[own], bins[own], station[own], q[own]), settings)

        model.trees.append(_grow(Growing(edges, settings), passes, (int(used.sum()), int(q[used].sum()))))
        predicted = model.add(predicted, x, station, number)
        if tested.any():
            errors.append(float(((y - predicted)[tested] ** 2).mean()))
            if _stops(errors, settings):
                break
    return model


def _frame_arrays(frame: pd.DataFrame, features: int):
    x = np.column_stack([frame[f"x{i}"].to_numpy() for i in range(features)]) if features else np.zeros((len(frame), 0))
    return frame["row"].to_numpy(), x, frame["station"].to_numpy(), frame["y"].to_numpy()


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for k in range(0, len(frame), ROWS_AT_A_TIME):
            yield frame.iloc[k:k + ROWS_AT_A_TIME]


def boosted(rows: DataFrame, features: int, settings: BoostSettings) -> Boosted:
    """Fitted on ``rows`` (row, station, y, x0, x1, ...), staged, with finite values throughout."""
    marks = [k / BINS for k in range(1, BINS)]
    facts = rows.agg(F.count(F.lit(1)), F.avg("y"), *[F.percentile_approx(f"x{i}", marks, SKETCH) for i in range(features)]).first()
    n, start = facts[0], float(facts[1] or 0.0)
    edges = [np.unique(np.array(e if e else [], float)) for e in facts[2:]]
    if n <= settings.local_rows:
        return _boosted_in_one_task(rows, features, edges, start, settings)
    model = Boosted(start, edges)
    spark = rows.sparkSession
    state = staged(rows.withColumn("predicted", F.lit(start)))
    since, errors = 0, []

    def applied(frame: pd.DataFrame, held: Boosted, first: int):
        row, x, station, y = _frame_arrays(frame, features)
        predicted = held.add(frame["predicted"].to_numpy(), x, station, first)
        tested = hashed(row, -1 % PRIME, settings.seed) < settings.held_out if settings.patience else np.zeros(len(y), bool)
        used = ~tested
        if settings.subsample < 1:
            used &= hashed(row, len(held.trees), settings.seed) < settings.subsample
        return x, station, y, predicted, tested, used

    for number in range(settings.rounds):
        if number - since == KEPT:
            held, first = spark.sparkContext.broadcast(model), since

            def carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in _pieces(frames):
                    yield frame.assign(predicted=applied(frame, held.value, first)[3])

            older, state = state, staged(state.mapInPandas(carried, state.schema))
            discard(older)
            since = number
        sent, first = spark.sparkContext.broadcast(model), since

        def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2, np.int64), np.zeros(2)
            for frame in _pieces(frames):
                _, _, y, predicted, tested, used = applied(frame, sent.value, first)
                total[0][:] += int(used.sum()), int(residuals(y, predicted)[used].sum())
                total[1][:] += float(((y - predicted)[tested] ** 2).sum()), float(tested.sum())
            yield pd.DataFrame({"n": [total[0][0]], "s": [total[0][1]], "error": [total[1][0]], "tested": [total[1][1]]})

        sums = state.mapInPandas(summed, "n long, s long, error double, tested double").agg(
            F.sum("n"), F.sum("s"), F.sum("error"), F.sum("tested")).first()
        if number and sums[3]:
            errors.append(sums[2] / sums[3])
            if _stops(errors, settings):
                break

        def passes(growing: Growing) -> dict[int, Split]:
            work = spark.sparkContext.broadcast((model, growing.tree, growing.unknown))

            def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held, tree, unknown = work.value
                for frame in _pieces(frames):
                    x, station, y, predicted, _, used = applied(frame, held, first)
                    node = tree.nodes_of(x, station)
                    own = used & np.isin(node, unknown)
                    q = residuals(y, predicted)
                    yield cells_of(node[own], bins_of(x[own], held.edges), station[own], q[own])

            cells = state.mapInPandas(partial, "node long, feature long, bin long, n long, s long")
            return _best_of_all(cells, settings)

        model.trees.append(_grow(Growing(edges, settings), passes, (int(sums[0]), int(sums[1] or 0))))
    discard(state)
    return model


def _boosted_in_one_task(rows: DataFrame, features: int, edges, start: float, settings: BoostSettings) -> Boosted:
    """At most ``local_rows`` rows: fitted by one task; the trees come back as bytes."""
    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        model = boosted_here(*_frame_arrays(frame.sort_values("row"), features), edges, start, settings)
        return pd.DataFrame({"trees": [pickle.dumps(model.trees)]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "trees binary").collect()
    model = Boosted(start, edges)
    model.trees = pickle.loads(bytes(found[0]["trees"])) if found else []
    return model


def predict_boosted(rows: DataFrame, features: int, model: Boosted) -> DataFrame:
    """row, yhat for ``rows`` (row, station, x0, x1, ...)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            row, x, station, _ = _frame_arrays(frame.assign(y=0.0), features)
            yield pd.DataFrame({"row": row, "yhat": shared.value.predict(x, station)})

    return rows.mapInPandas(predicted, "row long, yhat double")
