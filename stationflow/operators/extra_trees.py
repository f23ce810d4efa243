"""Extremely randomized trees, grown level by level over a table of nodes.

Every node draws one threshold for each numeric feature, evenly between the least and the largest value that
its train rows have, from a hash of (seed, tree, node, feature); stations enter as splits "station = s", one for
each station in the node, as indicator columns would. The split with the largest gain in squared error
is taken, however small; a node ends when its targets are equal, nothing is left to split on, or no split
leaves ``min_leaf`` train rows on both sides.

Rows to be predicted ride along with weight 0: they count in no sum and share the leaf they end in, so no
tree is ever held whole by anyone. Nodes of a level are rows of a table. A level takes two aggregates, both
combined before the shuffle: one by node and station (sums, least and largest values), one of the sums left
of the drawn thresholds. A node whose rows number at most ``local_rows`` is finished by one task, with
the same draws and the same sums, so where that happens never shows in the result. Trees are grown a few at
a time where rows are many, and each level's rows are dropped once the next is written.

The same grower makes random forests: ``best`` takes, in place of a drawn threshold, the best of up to 254 quantile edges
of each feature, and ``bootstrap`` gives a row to a tree as often as a Poisson draw by (seed, tree, row) says. A row drawn
twice counts twice, also for ``min_leaf``.

Targets are taken in millionths as whole numbers: sums are exact, so a tree does not depend on the order of
rows, on partitions, or on a task run twice. Features are taken in single precision. Ties in gain go to the
first numeric feature, then to the smallest station.

Rows without a station, target (train rows) or feature are not handed in (``drop_incomplete``). A forest
without train rows predicts null. Depth ends at 62 splits, the width of a node number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.lineage import discard, staged

SCALE = 1_000_000
PRIME = (1 << 31) - 1
DEEPEST = 62
ROWS_AT_ONCE = 2_000_000_000  # rows times trees of a level that may lie in the shared folder
BINS, SKETCH = 255, 10_000  # of ``best``; the sketch errs by one row in so many
# Chances of a Poisson draw of mean one to be at most 0, 1, 2, ...; beyond ten they don't matter in 31 bits.
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(11)))
CHUNK = 50  # trees that one task grows over one copy of a small forest's rows
KEY = ("forest", "tree", "node")


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 600
    min_leaf: int = 1
    seed: int = 7
    deepest: int = DEEPEST
    local_rows: int = 50_000
    best: bool = False
    bootstrap: bool = False

    def __post_init__(self) -> None:
        if self.trees < 1 or self.min_leaf < 1 or not 0 <= self.deepest <= DEEPEST:
            raise ValueError(f"trees and min_leaf must be positive, deepest between 0 and {DEEPEST}")


def mixed(tree, node, feature: int, seed: int):
    """The draw of a node and feature, evenly spread over 0 to PRIME - 1; for columns and arrays of longs alike."""
    h = (node % PRIME * 48_271 + tree * 69_621 + (feature + 1) * 16_807 + seed * 40_692 + 1) % PRIME
    for step in (11, 29, 53):
        h = (h * 48_271 + step) % PRIME
        h = (h * h + 3 * h + step) % PRIME
    return h


def times_drawn(tree, row, seed: int):
    """How often a row goes into a tree; for columns and arrays of longs alike."""
    u = mixed(tree, (row % PRIME + PRIME) % PRIME, 200, seed) / float(PRIME)  # 200: no feature's number
    return sum((u >= limit).astype("long") if isinstance(u, Column) else (u >= limit).astype(np.int64) for limit in POISSON)


def tree_rows(rows: DataFrame, features: Sequence[str], target: str, forest: Column, row: Column, weight: Column) -> DataFrame:
    """Columns the grower reads: forest, row, station, w, yq, x0, x1, ..."""
    exact = F.when(weight > 0, F.round(F.col(target) * SCALE).cast("long"))
    return rows.select(
        forest.cast("long").alias("forest"), row.cast("long").alias("row"), F.col("station_id").alias("station"),
        weight.cast("long").alias("w"), exact.alias("yq"),
        *[F.col(f).cast("float").cast("double").alias(f"x{i}") for i, f in enumerate(features)])


# --- a node's subtree in one task ------------------------------------------------------------------

def _segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def grow_here(tree: int, node: int, station: np.ndarray, w: np.ndarray, yq: np.ndarray, x: np.ndarray,
              settings: TreeSettings) -> np.ndarray:
    """The prediction of every row, from growing the subtree below ``node`` over all of them."""
    out = np.full(len(w), np.nan)
    at = np.full(len(w), node, np.int64)
    active = np.arange(len(w))
    depth = int(node).bit_length() - 1
    features = x.shape[1]
    while len(active):
        active = active[np.lexsort((station[active], at[active]))]
        train = active[w[active] > 0]
        if not len(train):
            break  # a forest without train rows
        nodes, starts, of_row = np.unique(at[train], return_index=True, return_inverse=True)
        wt, yt, xt = w[train], yq[train], x[train]
        n, s = _segment_sums(wt, starts), _segment_sums(wt * yt, starts)
        low, high = np.minimum.reduceat(xt, starts, axis=0), np.maximum.reduceat(xt, starts, axis=0)
        mixes = np.minimum.reduceat(yt, starts) < np.maximum.reduceat(yt, starts)
        if settings.best:
            cuts, gains = _best_cuts(xt, wt, yt, of_row, n, s, settings.min_leaf)
        else:
            draws = np.stack([mixed(tree, nodes, f, settings.seed) for f in range(features)], axis=1) / float(PRIME)
            cuts = low + draws * (high - low)
            left = xt <= cuts[of_row]
            gains = _gain(_segment_sums(left * wt[:, None], starts), _segment_sums(left * (wt * yt)[:, None], starts),
                          n[:, None], s[:, None], settings.min_leaf)
        gains[low >= high] = -np.inf
        feature = gains.argmax(axis=1)
        best = gains[np.arange(len(nodes)), feature]
        # rows are in order of node and station: pairs of them are runs
        st = station[train]
        runs = np.flatnonzero(np.r_[True, (of_row[1:] != of_row[:-1]) | (st[1:] != st[:-1])])
        of_run = of_row[runs]
        by_station = _gain(_segment_sums(wt, runs), _segment_sums(wt * yt, runs), n[of_run], s[of_run], settings.min_leaf)
        first_runs = np.flatnonzero(np.r_[True, of_run[1:] != of_run[:-1]])
        best_station = np.maximum.reduceat(by_station, first_runs)
        hits = np.flatnonzero(by_station == best_station[of_run])
        hits = hits[np.unique(of_run[hits], return_index=True)[1]]
        chosen = st[runs[hits]]
        takes_station = best_station > best
        splits = mixes & (np.maximum(best, best_station) > -np.inf) & (depth < settings.deepest)
        index = np.searchsorted(nodes, at[active])
        ends = ~splits[index]
        out[active[ends]] = (s / n / SCALE)[index[ends]]
        active, index = active[~ends], index[~ends]
        goes_left = np.where(
            takes_station[index], station[active] == chosen[index], x[active, feature[index]] <= cuts[index, feature[index]])
        at[active] = 2 * at[active] + ~goes_left
        depth += 1
    return out


def _best_cuts(x, w, yq, of_row, n, s, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of each feature after which a node splits best, the lowest of equals, and the gain."""
    cuts, gains = np.zeros((len(n), x.shape[1])), np.zeros((len(n), x.shape[1]))
    for f in range(x.shape[1]):
        order = np.lexsort((x[:, f], of_row))
        node, value = of_row[order], x[order, f]
        runs = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (value[1:] != value[:-1])])
        of_run = node[runs]
        first = np.flatnonzero(np.r_[True, of_run[1:] != of_run[:-1]])
        sums = [np.add.reduceat(v[order], runs).cumsum() for v in (w, w * yq)]
        nl, sl = (v - np.r_[0, v][first][of_run] for v in sums)
        gain = _gain(nl, sl, n[of_run], s[of_run], min_leaf)
        gains[:, f] = np.maximum.reduceat(gain, first)
        hits = np.flatnonzero(gain == gains[of_run, f])
        cuts[:, f] = value[runs[hits[np.unique(of_run[hits], return_index=True)[1]]]]
    return cuts, gains


def _gain(nl, sl, n, s, min_leaf: int) -> np.ndarray:
    """Sum over both sides of squared sum by count, or minus infinity where a side is too small."""
    nr, sr = (n - nl).astype(float), (s - sl).astype(float)
    nl, sl = nl.astype(float), sl.astype(float)
    fits = (nl >= min_leaf) & (nr >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(fits, sl * sl / nl + sr * sr / nr, -np.inf)


def _arrays(frame: pd.DataFrame, features: int):
    yq = frame["yq"].fillna(0).to_numpy().astype(np.int64)
    return (frame["station"].to_numpy(), frame["w"].to_numpy(), yq,
            np.column_stack([frame[f"x{i}"].to_numpy() for i in range(features)]))


def _small_forests(rows: DataFrame, features: int, settings: TreeSettings) -> DataFrame:
    """forest, row, total, trees: forests of at most ``local_rows`` rows, a chunk of trees in every task."""
    chunks = -(-settings.trees // CHUNK)

    def grown(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        station, w, yq, x = _arrays(frame, features)
        asked, total, rows_of = w == 0, np.zeros(len(frame)), frame["row"].fillna(0).to_numpy().astype(np.int64)
        numbers = range(key[1] * CHUNK, min((key[1] + 1) * CHUNK, settings.trees))
        for tree in numbers:
            own = np.where(asked, 0, w * times_drawn(tree, rows_of, settings.seed)) if settings.bootstrap else w
            used = asked | (own > 0)
            total[used] += grow_here(tree, 1, station[used], own[used], yq[used], x[used], settings)
        return pd.DataFrame({"forest": frame["forest"][asked], "row": frame["row"][asked], "total": total[asked],
                             "trees": len(numbers)})

    copies = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return copies.groupBy("forest", "chunk").applyInPandas(grown, "forest long, row long, total double, trees long")


# --- levels over all rows --------------------------------------------------------------------------

def _nodes(work: DataFrame, features: int, settings: TreeSettings, depth: int) -> tuple[DataFrame, DataFrame]:
    """Train sums by node and station, and by node with what becomes of it: leaf, small or open."""
    train = F.col("w") > 0
    x = [F.col(f"x{i}") for i in range(features)]
    stations = staged(work.groupBy(*KEY, "station").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("yq")).alias("s"),
        F.min("yq").alias("y_low"), F.max("yq").alias("y_high"),
        *[f(F.when(train, c)).alias(f"{name}{i}") for i, c in enumerate(x) for f, name in ((F.min, "low"), (F.max, "high"))]))
    bounds = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(features) for f, name in ((F.min, "low"), (F.max, "high"))]
    nodes = stations.groupBy(*KEY).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("y_low").alias("y_low"),
        F.max("y_high").alias("y_high"), F.count_if(F.col("n") > 0).alias("stations"), *bounds)
    varied = reduce(lambda a, b: a | b, [F.col(f"low{i}") < F.col(f"high{i}") for i in range(features)], F.col("stations") > 1)
    ends = ~((F.col("y_low") < F.col("y_high")) & varied) | (F.col("n") < 2 * settings.min_leaf) | F.lit(depth >= settings.deepest)
    fate = F.when(F.coalesce(ends, F.lit(True)), "leaf").when(F.col("rows") <= settings.local_rows, "small").otherwise("open")
    return stations, staged(nodes.withColumn("fate", fate))


def _value() -> Column:
    return F.try_divide(F.col("s").cast("double"), F.col("n").cast("double")) / SCALE


def _gain_column(nl: Column, sl: Column, min_leaf: int) -> Column:
    n, s = F.col("n"), F.col("s")
    left, right = sl.cast("double"), (s - sl).cast("double")
    gain = left * left / nl.cast("double") + right * right / (n - nl).cast("double")
    return F.when((nl >= min_leaf) & (n - nl >= min_leaf), gain)


def _splits(work: DataFrame, stations: DataFrame, nodes: DataFrame, features: int, settings: TreeSettings) -> DataFrame:
    """The best split of every open node: feature and cut, or chosen station; none of them if no split fits."""
    if settings.best:
        numeric, cuts = _best_numeric(work, nodes, features, settings)
        return _with_stations(numeric, cuts, stations, settings)
    wide = F.lit(float(PRIME))
    cuts = nodes.where("fate = 'open'").select(*KEY, "n", "s", *[
        F.when(F.col(f"low{i}") < F.col(f"high{i}"), F.col(f"low{i}") + mixed(F.col("tree"), F.col("node"), i, settings.seed).cast(
            "double") / wide * (F.col(f"high{i}") - F.col(f"low{i}"))).alias(f"cut{i}") for i in range(features)])
    cuts = staged(cuts)
    left = work.where("w > 0").join(cuts.drop("n", "s"), list(KEY)).groupBy(*KEY).agg(*[
        e for i in range(features) for inside in [F.col(f"x{i}") <= F.col(f"cut{i}")] for e in (
            F.sum(F.when(inside, F.col("w"))).alias(f"nl{i}"), F.sum(F.when(inside, F.col("w") * F.col("yq"))).alias(f"sl{i}"))])
    numeric = cuts.join(left, list(KEY)).select(*KEY, "n", "s", F.array_max(F.array(*[
        F.when(gain.isNotNull(), F.struct(gain.alias("gain"), F.lit(-i).alias("minus"), F.col(f"cut{i}").alias("cut")))
        for i in range(features) for gain in [_gain_column(F.col(f"nl{i}"), F.col(f"sl{i}"), settings.min_leaf)]])).alias("best"))
    return _with_stations(numeric, cuts, stations, settings)


def _best_numeric(work: DataFrame, nodes: DataFrame, features: int, settings: TreeSettings) -> tuple[DataFrame, DataFrame]:
    """The best edge of every open node over all features, from sums by node, feature and bin; and the open nodes."""
    open_ = staged(nodes.where("fate = 'open'").select(*KEY, "n", "s"))
    values = F.posexplode(F.array(*[F.col(f"x{i}") for i in range(features)])).alias("f", "x")
    cells = work.where("w > 0").join(open_.select(*KEY), list(KEY)).select(*KEY, "w", "yq", values)
    cells = cells.groupBy(*KEY, "f", "x").agg(F.sum("w").alias("nl"), F.sum(F.col("w") * F.col("yq")).alias("sl"))
    upto = Window.partitionBy(*KEY, "f").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # at most 255 rows
    cells = cells.withColumns({"nl": F.sum("nl").over(upto), "sl": F.sum("sl").over(upto)}).join(open_, list(KEY))
    gain = _gain_column(F.col("nl"), F.col("sl"), settings.min_leaf)
    best = cells.select(*KEY, "f", "x", gain.alias("gain")).where("gain IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct((-F.col("gain")).alias("less"), F.col("f").alias("f"), F.col("x").alias("x"))).alias("b"))
    found = F.struct((-F.col("b.less")).alias("gain"), (-F.col("b.f")).alias("minus"), F.col("b.x").alias("cut"))
    return open_.join(best, list(KEY), "left").select(
        *KEY, "n", "s", F.when(F.col("b").isNotNull(), found).alias("best")), open_


def _with_stations(numeric: DataFrame, cuts: DataFrame, stations: DataFrame, settings: TreeSettings) -> DataFrame:
    """The better of the numeric split and the best station of every open node."""
    own = stations.where("n > 0").select(*KEY, "station", F.col("n").alias("n_own"), F.col("s").alias("s_own")).join(cuts, list(KEY))
    gain = _gain_column(F.col("n_own"), F.col("s_own"), settings.min_leaf)
    by_station = own.select(*KEY, "station", gain.alias("gain")).where("gain IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct((-F.col("gain")).alias("minus"), F.col("station").alias("station"))).alias("other"))
    numeric_wins = F.col("best").isNotNull() & F.coalesce(F.col("best.gain") >= -F.col("other.minus"), F.lit(True))
    return numeric.join(by_station, list(KEY), "left").select(
        *KEY, _value().alias("value"), F.when(numeric_wins, -F.col("best.minus")).alias("feature"),
        F.when(numeric_wins, F.col("best.cut")).alias("cut"), F.when(~numeric_wins, F.col("other.station")).alias("chosen"))


def _grown(rows: DataFrame, features: int, first: int, end: int, settings: TreeSettings) -> list[DataFrame]:
    """forest, row, total, trees from trees ``first`` to ``end`` over forests of any size."""
    def subtree(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = grow_here(int(key[1]), int(key[2]), *_arrays(frame, features), settings)
        asked = frame["w"].to_numpy() == 0
        return pd.DataFrame({"forest": frame["forest"][asked], "row": frame["row"][asked], "total": values[asked]})

    work = rows.withColumns({
        "tree": F.explode(F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long"))), "node": F.lit(1).cast("long")})
    if settings.bootstrap:
        asked = F.col("w") == 0
        work = work.withColumns({"asked": asked, "w": F.col("w") * times_drawn(F.col("tree"), F.col("row"), settings.seed)})
        work = work.where("asked OR w > 0").withColumn("w", F.when(F.col("asked"), 0).otherwise(F.col("w"))).drop("asked")
    work = staged(work)
    out, depth = [], 0
    while True:
        stations, nodes = _nodes(work, features, settings, depth)
        fates = {r["fate"] for r in nodes.select("fate").distinct().collect()}
        found = []
        if "leaf" in fates:
            leaves = nodes.where("fate = 'leaf'").select(*KEY, _value().alias("total"))
            found.append(work.where("w = 0").join(leaves, list(KEY)).select("forest", "row", "total"))
        if "small" in fates:
            small = nodes.where("fate = 'small'").select(*KEY)
            found.append(work.join(small, list(KEY)).groupBy(*KEY).applyInPandas(subtree, "forest long, row long, total double"))
        after = None
        if "open" in fates:
            splits = staged(_splits(work, stations, nodes, features, settings))
            closed = F.col("feature").isNull() & F.col("chosen").isNull()
            ended = splits.where(closed).select(*KEY, F.col("value").alias("total"))
            found.append(work.where("w = 0").join(ended, list(KEY)).select("forest", "row", "total"))
            value = F.coalesce(*[F.when(F.col("feature") == i, F.col(f"x{i}")) for i in range(features)])
            goes_left = F.when(F.col("feature").isNotNull(), value <= F.col("cut")).otherwise(F.col("station") == F.col("chosen"))
            child = F.col("node") * 2 + F.when(goes_left, 0).otherwise(1)
            after = staged(work.join(splits.where(~closed).drop("value"), list(KEY)).withColumn("node", child).drop(
                "feature", "cut", "chosen"))
        if found:
            done = reduce(DataFrame.unionByName, found).withColumn("trees", F.lit(1).cast("long"))
            out.append(staged(done.groupBy("forest", "row").agg(F.sum("total").alias("total"), F.sum("trees").alias("trees"))))
        for frame in (work, stations, nodes):
            discard(frame)
        if after is None or after.isEmpty():
            return out
        work, depth = after, depth + 1


def _binned(rows: DataFrame, features: int) -> DataFrame:
    """``rows`` with every feature as the number of the quantile edges of the train rows that lie below it."""
    marks = [k / BINS for k in range(1, BINS)]
    rows = staged(rows)
    facts = rows.where("w > 0").agg(*[F.percentile_approx(f"x{i}", marks, SKETCH) for i in range(features)]).first()
    edges = [np.unique(np.array(e or [], float)) for e in facts]

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({f"x{i}": np.searchsorted(e, frame[f"x{i}"].to_numpy(), side="left").astype(float)
                                for i, e in enumerate(edges)} | {"row": frame["row"].astype("Int64"), "yq": frame["yq"].astype("Int64"),
                                                                 "forest": frame["forest"], "station": frame["station"], "w": frame["w"]})

    return rows.mapInPandas(numbered, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))


def predict_forests(rows: DataFrame, features: int, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """forest, row, yhat for the rows of weight 0 of ``tree_rows``: the mean over all trees of their forest."""
    rows = staged(_binned(rows, features) if settings.best else rows)
    sizes = staged(rows.groupBy("forest").agg(F.count(F.lit(1)).alias("rows")))
    small = sizes.where(F.col("rows") <= settings.local_rows).select("forest")
    large = sizes.where(F.col("rows") > settings.local_rows).select("forest", "rows")
    total = large.agg(F.sum("rows")).first()[0]
    parts = [_small_forests(rows.join(small, "forest", "left_semi"), features, settings)]
    if total:
        at_once = max(1, min(settings.trees, ROWS_AT_ONCE // total))
        many = rows.join(large.select("forest"), "forest", "left_semi")
        for first in range(0, settings.trees, at_once):
            parts += _grown(many, features, first, min(first + at_once, settings.trees), settings)
    # a row whose forest has no train row has no sum
    return reduce(DataFrame.unionByName, parts).groupBy("forest", "row").agg(
        F.try_divide(F.sum("total"), F.sum("trees")).alias("yhat")).withColumn(
        "yhat", F.when(~F.isnan("yhat"), F.col("yhat")))
