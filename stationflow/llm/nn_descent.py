"""Near-duplicate vectors by NN-descent, with links at a cosine of ``threshold`` or more.

Equal vectors are one node that knows how many rows it stands for. Every node keeps a list of its
best neighbours. The lists start from blocks of rows that lie next to each other in a few random
orders (signs of random projections, then one projection), and are refined: two nodes that stand in
one list meet, and each enters the other's list if it is better than the worst there. Rounds go on
until the lists hardly change.

A list whose worst entry still passes the threshold is saturated. Such lists are doubled, and the
rounds repeated among saturated nodes, until no list is saturated or lists have LONGEST_LIST entries. Nodes whose lists are
saturated even then stand in crowds; their links among each other are counted exactly, by balls (``crowds``), also
between crowds that the lists don't connect. A link between a node in a crowd and one that is in none stands in the
list of the latter.

What lists hold is audited: AUDIT nodes that are in no crowd (those with the least hash) are held against all nodes; while
fewer than WANTED of their links are known, more random orders are tried. If that does not help MOST_TRIES times, all
nodes are counted as a crowd is. So every link is counted exactly, or by lists whose recall has been measured.

Defined cases: null, empty and zero vectors, and those that hold null or non-finite components or
have another length than most, link with nothing and come out as their own component; rows that
repeat an id and a vector count once, and give one row; rows that share an id and differ are nodes of
their own, and the id comes out once with the sums of their links and the least component. A row
without an id comes out alone, with nulls. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from stationflow.lineage import settle
from stationflow.llm import vectors as V
from stationflow.llm.components import components
from stationflow.llm.crowds import cosines, counted, unit

THRESHOLD = 0.9
LIST, LONGEST_LIST, ORDERS, BLOCK, MOST_ROUNDS = 10, 40, 4, 256, 5
STILL = 1e-3  # relative gain of the summed similarities below which rounds end
AUDIT, WANTED, MOST_TRIES = 200, 0.995, 3
PAIR_BLOCK = 1024  # nodes of a block when crowds are counted exactly
ROWS_OF_A_PART = 100_000  # list entries that a partition is meant to hold

_LISTS = "a long, b long, sim double"


def _best(pairs: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """The best entries of every list (a, b, sim), as many as the node's ``size``; dealt by a."""
    own = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    dealt = pairs.repartition(parts, "a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    placed = dealt.withColumn("place", F.row_number().over(own))
    return placed.join(nodes.select(F.col("node").alias("a"), "size"), "a").where("place <= size").select("a", "b", "sim")


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")


def _neighbouring(nodes: DataFrame, width: int, rows: int, seed: int) -> DataFrame:
    """Pairs of nodes that lie in one block of a random order: the best few of each node there."""
    rng_seed, bits = 1000 + seed, max(1, int(np.log2(max(2, rows / BLOCK))))

    @pandas_udf("sign long, along double")
    def ordered(vecs: pd.Series) -> pd.DataFrame:
        u = unit(vecs, width)
        if not len(u):
            return pd.DataFrame({"sign": np.array([], np.int64), "along": np.array([], float)})
        directions = np.random.default_rng(rng_seed).standard_normal((u.shape[1], bits + 1))
        at = u @ directions
        return pd.DataFrame({"sign": (at[:, :bits] > 0) @ (1 << np.arange(bits)), "along": at[:, bits]})

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), BLOCK):
                part = frame.iloc[k:k + BLOCK]
                ids, sims = part["node"].to_numpy(), cosines(*[unit(part["vec"], width)] * 2)
                np.fill_diagonal(sims, -2.0)
                most = min(LIST, len(ids) - 1)
                if most:
                    near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                    yield pd.DataFrame({
                        "a": np.repeat(ids, most), "b": ids[near].ravel(),
                        "sim": np.take_along_axis(sims, near, axis=1).ravel()})

    placed = nodes.select("node", "vec", ordered("vec").alias("o")).select("node", "vec", "o.*")
    return placed.repartitionByRange("sign", "along").sortWithinPartitions("sign", "along").mapInPandas(blocks, _LISTS)


def _meet(lists: DataFrame, nodes: DataFrame, width: int, parts: int) -> DataFrame:
    """Pairs of nodes that have a node in common in their lists, and that at least one of them has use for.

    Every node sends its vector to the nodes in its list, and those that arrive at one node meet there, at most
    MEETING at a time.
    """
    worst = lists.groupBy("a").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"))
    known = nodes.select(F.col("node").alias("a"), "vec", "size").join(worst, "a").select(
        "a", "vec", F.when(F.col("n") >= F.col("size"), F.col("worst")).otherwise(-2.0).alias("worst"))
    sent = lists.select("a", F.col("b").alias("at")).join(known, "a")

    def meetings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last node of a batch may go on in the next
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = int(np.searchsorted(frame["at"].to_numpy(), frame["at"].iloc[-1])) if len(frame) else 0
            if len(frame) - last > MEETING:
                last = len(frame)
            held = frame.iloc[last:]
            yield met(frame.iloc[:last])
        if held is not None:
            yield met(held)

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame):
            ids, worst, u = frame["a"].to_numpy(), frame["worst"].to_numpy(), unit(frame["vec"], width)
            ends = np.flatnonzero(np.diff(frame["at"].to_numpy())) + 1
            for s, e in zip([0, *ends], [*ends, len(frame)]):
                for k in range(s, e, MEETING):
                    own = slice(k, min(e, k + MEETING))
                    sims = cosines(u[own], u[own])
                    i, j = np.nonzero(np.triu(sims > np.minimum(worst[own, None], worst[None, own]), 1))
                    out.append((ids[own][i], ids[own][j], sims[i, j]))
        a, b, sim = (np.concatenate(x) for x in zip(*out)) if out else (np.array([], np.int64),) * 2 + (np.array([]),)
        return pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([b, a]), "sim": np.concatenate([sim, sim])})

    return sent.repartition(parts, "at").sortWithinPartitions("at").mapInPandas(meetings, _LISTS)


MEETING = 512  # nodes that meet at once


def _total(lists: DataFrame) -> float:
    return lists.agg(F.sum(F.col("sim") + 1)).first()[0] or 0.0


def _descend(lists: DataFrame, nodes: DataFrame, width: int, parts: int, rounds: int = MOST_ROUNDS) -> DataFrame:
    total = _total(lists)
    for _ in range(rounds):
        more = _meet(lists, nodes, width, parts).unionByName(lists).unionByName(_turned(lists))
        lists = settle(_best(more, nodes, parts))
        now = _total(lists)
        if now <= total * (1 + STILL):
            break
        total = now
    return lists


def _saturated(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    full = lists.where(F.col("sim") >= threshold).groupBy("a").count()
    return full.join(nodes.select("node", "size"), F.col("a") == F.col("node")).where("count >= size").select("node")


def _known_links(lists: DataFrame, threshold: float) -> DataFrame:
    """Both directions of every pair that passes."""
    passing = lists.where(F.col("sim") >= threshold)
    return passing.unionByName(_turned(passing)).select("a", "b").distinct()


def _audit(nodes: DataFrame, loose: DataFrame, links: DataFrame, width: int, threshold: float) -> float:
    """Share of the links of AUDIT nodes of ``loose``, held against all nodes, that are known."""
    asked = loose.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "vec").toPandas()
    if not len(asked):
        return 1.0
    ids, u = asked["node"].to_numpy(), unit(asked["vec"], width)

    def against(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            i, j = np.nonzero(cosines(u, unit(frame["vec"], width)) >= threshold) if len(frame) else ([], [])
            a, b = ids[i], frame["node"].to_numpy()[j]
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    true = nodes.select("node", "vec").mapInPandas(against, "a long, b long").withColumn("n", F.lit(1))
    row = true.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").agg(F.sum("n"), F.sum("found")).first()
    return (row[1] or 0) / row[0] if row[0] else 1.0


def _linked(nodes: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For nodes (node, vec, copies): node, others (copies of linked nodes) and node, group (least node reachable)."""
    n = nodes.count()
    parts = max(1, -(-n * LIST // ROWS_OF_A_PART))
    sized = settle(nodes.select("node", "vec", "copies", F.lit(LIST).alias("size")).repartition(parts, "node"))
    lists, links, full = None, None, None
    for attempt in range(MOST_TRIES if n > 1 else 0):
        for order in range(attempt * ORDERS, (attempt + 1) * ORDERS):
            more = _neighbouring(nodes, width, n, order)
            lists = more if lists is None else lists.unionByName(more)
        lists = _descend(settle(_best(lists.unionByName(_turned(lists)), sized, parts)), sized, width, parts)
        full = settle(_saturated(lists, sized, threshold))
        size = LIST
        while size < LONGEST_LIST and not full.isEmpty():
            size *= 2
            sized = settle(sized.join(full.withColumn("more", F.lit(size)), "node", "left").select(
                "node", "vec", "copies", F.coalesce("more", "size").alias("size")).repartition(parts, "node"))
            part = lists.join(full.withColumnRenamed("node", "a"), "a", "left_semi")
            part = _descend(part, sized, width, parts, 2)
            lists = settle(_best(lists.unionByName(part), sized, parts))
            full = settle(_saturated(lists, sized, threshold))
        links = settle(_known_links(lists, threshold))
        loose = nodes if full.isEmpty() else nodes.join(full, "node", "left_anti")
        if _audit(nodes, loose, links, width, threshold) >= WANTED:
            break
    else:
        full = nodes.select("node")
    if links is None:
        alone = nodes.select("node", F.lit(0).cast("long").alias("others"))
        return alone, nodes.select("node", F.col("node").alias("group"))
    groups = settle(components(links))
    known = links.join(nodes.select(F.col("node").alias("b"), "copies"), "b")
    crowd = nodes.join(full, "node", "left_semi")
    if full.isEmpty():
        counts = known.groupBy("a").agg(F.sum("copies").alias("others"))
    else:
        members = crowd.join(groups, "node", "left").select(
            "node", "vec", "copies", F.coalesce("component", "node").alias("group"))
        exact, edges = counted(members, width, threshold, PAIR_BLOCK)
        marked = full.withColumn("crowd", F.lit(1))
        # links that have an end outside the crowds are taken from the lists
        outside = known.join(marked.select(F.col("node").alias("a"), F.col("crowd").alias("a_in")), "a", "left").join(
            marked.select(F.col("node").alias("b"), F.col("crowd").alias("b_in")), "b", "left").where("a_in IS NULL OR b_in IS NULL")
        counts = outside.select("a", "copies").unionByName(
            exact.select(F.col("node").alias("a"), F.col("n_links").alias("copies"))).groupBy("a").agg(F.sum("copies").alias("others"))
        edges = settle(edges)
        if not edges.isEmpty():
            groups = components(links.unionByName(edges))
    counts = nodes.select("node").join(counts.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("others", F.lit(0)).alias("others"))
    groups = nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    return counts, groups


def near_duplicates(
    table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key``, n_links, component_id, kept for every row of ``table``."""
    rows = V.packed(table, key, vector)
    width = V.width_of(rows)
    classes = rows.groupBy("vec").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    # rows that share an id may stand first in several classes: nodes are numbered by place in that case
    twins = Window.partitionBy("first").orderBy("vec")
    classes = classes.withColumn("twin", F.row_number().over(twins) - 1)
    nodes = settle(classes.select(
        F.when(F.col("twin") == 0, F.col("first")).otherwise(F.xxhash64("first", "vec")).alias("node"),
        "first", "vec", "copies"))
    counts, groups = _linked(nodes, width, threshold)
    grouped = settle(nodes.join(counts, "node").join(groups, "node"))
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    by_vector = grouped.join(least, "group").select("vec", (F.col("others") + F.col("copies") - 1).alias("links"), "component_id")
    linked = rows.join(by_vector, "vec").groupBy(key).agg(
        F.sum("links").alias("links"), F.min("component_id").alias("component_id"))
    out = table.select(key).distinct().join(linked, key, "left")
    component = F.coalesce("component_id", key)
    return out.select(
        key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col(key) == component).alias("kept"))
