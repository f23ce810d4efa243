"""Exact link counts among nodes that stand in crowds, by balls.

The members of a crowd are cut into balls (a centre, a radius in angle) until a ball is tight or small. Two balls
whose centres are further apart than both radii and the threshold's angle share no link; two balls that
together span no more than that angle are linked throughout, and are counted by their size alone, so a large group of near
copies costs no comparison. The rest is compared block by block, with one row per node and block coming out and
never a pair. All balls meet, of whatever crowd, so a crowd that touches another one is found to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.lineage import settle
from stationflow.llm import vectors as V

FAN = 32  # parts into which a ball is cut at a time
BALLS_AT_ONCE = 1024
ROUNDING = 1e-6  # of an angle: pairs of balls closer to a limit than this are compared


def unit(vecs, width: int) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    rows = V.matrix(vecs, width)
    if not len(rows):
        return rows
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.clip(left @ right.T, -1.0, 1.0)


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, exact for small angles too."""
    return 2 * np.arcsin(np.clip(np.linalg.norm(left - right, axis=1) / 2, 0, 1))


def _balls(members: DataFrame, width: int) -> DataFrame:
    """ball, centre, radius, n, weight, group of the balls of ``members``."""
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                ids, at = np.unique(frame["ball"].to_numpy(), return_inverse=True)
                total = np.zeros((len(ids), len(frame["vec"].iloc[0]) // width))
                np.add.at(total, at, unit(frame["vec"], width))
                yield pd.DataFrame({"ball": ids, "sums": [t.tobytes() for t in total]})

    def centred(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, "<f8") for s in part["sums"])
        size = np.linalg.norm(total)
        centre = total / size if size > 0 else np.eye(1, len(total))[0]
        return pd.DataFrame({"ball": [part["ball"].iloc[0]], "centre": [centre.tobytes()]})

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            far = _angles(unit(frame["vec"], width), V.matrix(frame["centre"], 8)) if len(frame) else []
            yield pd.DataFrame({"ball": frame["ball"], "group": frame["group"], "copies": frame["copies"], "far": far})

    partial = members.select("ball", "vec").mapInPandas(sums, "ball long, sums binary")
    centres = settle(partial.groupBy("ball").applyInPandas(centred, "ball long, centre binary"))
    far = members.join(centres, "ball").select("ball", "group", "copies", "vec", "centre").mapInPandas(
        reach, "ball long, group long, copies long, far double")
    sizes = far.groupBy("ball").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"),
                                    F.sum("copies").alias("weight"), F.min("group").alias("group"))
    return settle(sizes.join(centres, "ball"))


def _cut(members: DataFrame, open_: DataFrame, width: int, block: int) -> DataFrame:
    """Members of the balls in ``open_`` (ball, n), each with the part of its ball whose pivot is nearest as its ball."""
    inside = members.join(open_, "ball")
    order = Window.partitionBy("ball").orderBy(F.xxhash64("node"), "node")
    pivots = inside.select("ball", "node", "vec", "n").withColumn("place", F.row_number().over(order)).where(F.col("place") <= FAN)
    chunks = F.ceil(F.col("n") / block)
    pivots = pivots.select(F.col("ball").alias("p_ball"), "place", F.col("vec").alias("p_vec"),
                           F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("p_chunk"))
    inside = inside.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).drop("n")

    def dealt(part: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return part.assign(piece=np.zeros(0, np.int64))[["node", "vec", "copies", "group", "ball", "piece"]]
        pivots = pivots.sort_values("place")
        piece = cosines(unit(part["vec"], width), unit(pivots["p_vec"], width)).argmax(axis=1)
        return part[["node", "vec", "copies", "group", "ball"]].assign(piece=piece)

    cut = inside.groupBy("ball", "chunk").cogroup(pivots.groupBy("p_ball", "p_chunk")).applyInPandas(
        dealt, "node long, vec binary, copies long, group long, ball long, piece long")
    return cut.select("node", "vec", "copies", "group", F.xxhash64("ball", "piece").alias("ball"))


def _near_balls(balls: DataFrame, angle: float) -> DataFrame:
    """ball, other, sure for all pairs of balls (in both orders, and of a ball with itself) that can share a link."""
    blocks = max(1, -(-balls.count() // BALLS_AT_ONCE))
    rows = balls.select("ball", "centre", "radius", F.pmod(F.xxhash64("ball"), F.lit(blocks)).alias("block"))
    left = rows.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("left_block"))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, others = a["ball"].to_numpy(), b["b_ball"].to_numpy()
            apart = np.arccos(cosines(V.matrix(a["centre"], 8), V.matrix(b["b_centre"], 8)))
            apart[ids[:, None] == others[None, :]] = 0.0
            span = a["radius"].to_numpy()[:, None] + b["b_radius"].to_numpy()[None, :]
            i, j = np.nonzero(apart - span <= angle + ROUNDING)
            out.append(pd.DataFrame({"ball": ids[i], "other": others[j], "sure": (apart + span)[i, j] <= angle - ROUNDING}))
        return pd.concat(out) if out else pd.DataFrame({"ball": [], "other": [], "sure": []}).astype({"sure": bool})

    return settle(left.groupBy("block", "other_block").cogroup(right.groupBy("left_block", "b_block")).applyInPandas(
        met, "ball long, other long, sure boolean"))


def counted(members: DataFrame, width: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """For ``members`` (node, vec, copies, group): node, n_links (copies of other members at ``threshold`` or more), and
    a, b: the pairs of different groups between which there is a link."""
    angle = float(np.arccos(threshold))
    members = settle(members.select("node", "vec", "copies", "group", F.col("group").alias("ball")))
    while True:
        balls = _balls(members, width)
        open_ = settle(balls.where((F.col("n") > block) & (F.col("radius") * 2 > angle - ROUNDING)).select("ball", "n"))
        if open_.isEmpty():
            break
        rest = members.join(open_.select("ball"), "ball", "left_anti").select("node", "vec", "copies", "group", "ball")
        members = settle(rest.unionByName(_cut(members, open_, width, block)))
    near = _near_balls(balls, angle)
    other = balls.select(F.col("ball").alias("other"), F.col("weight").alias("other_weight"), F.col("group").alias("other_group"))
    own = balls.select("ball", "group", F.ceil(F.col("n") / block).alias("chunks"))
    sure = near.where("sure").join(other, "other").join(own, "ball")
    by_ball = sure.groupBy("ball").agg(F.sum("other_weight").alias("weight"), F.max((F.col("ball") == F.col("other")).cast("int")).alias("itself"))
    certain = members.join(by_ball, "ball").select("node", (F.col("weight") - F.col("itself") * F.col("copies")).alias("n_links"))
    edges = sure.where("group <> other_group").select(F.col("group").alias("a"), F.col("other_group").alias("b"))

    def chunked(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    tried = near.where(~F.col("sure")).join(own.drop("group"), "ball").join(
        own.select(F.col("ball").alias("other"), F.col("chunks").alias("other_chunks")), "other")
    tried = settle(tried.withColumn("chunk", chunked("chunks")).withColumn("other_chunk", chunked("other_chunks")).select(
        "ball", "chunk", "other", "other_chunk"))
    placed = settle(members.join(own.drop("group"), "ball").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).drop("chunks"))
    left = placed.join(tried, ["ball", "chunk"])
    right = placed.select(F.col("node").alias("b"), F.col("vec").alias("b_vec"), F.col("copies").alias("b_copies"),
                          F.col("group").alias("b_group"), F.col("ball").alias("r_other"), F.col("chunk").alias("r_other_chunk"))
    keys = ["ball", "chunk", "other", "other_chunk"]
    right = right.join(tried.select(*[F.col(c).alias(f"r_{c}") for c in keys]), ["r_other", "r_other_chunk"])

    def compared(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"node": [], "n_links": [], "a": [], "b": []}, dtype=np.int64)
        links = cosines(unit(mine["vec"], width), unit(others["b_vec"], width)) >= threshold
        links &= mine["node"].to_numpy()[:, None] != others["b"].to_numpy()[None, :]
        return pd.DataFrame({"node": mine["node"].to_numpy(), "n_links": links @ others["b_copies"].to_numpy(),
                             "a": mine["group"].to_numpy(), "b": others["b_group"].iloc[0]})

    found = settle(left.groupBy(*keys).cogroup(right.groupBy(*[f"r_{c}" for c in keys])).applyInPandas(
        compared, "node long, n_links long, a long, b long"))
    edges = edges.unionByName(found.where("n_links > 0 AND a <> b").select("a", "b")).distinct()
    counts = certain.unionByName(found.select("node", "n_links")).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return counts, edges
