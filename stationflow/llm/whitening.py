"""Embedding whitening: spectral divide and conquer on polar decompositions, then broadcast projection.

Every component c of a vector becomes the whole number x = floor(64 * c) + 1000000. Sums of x are exact
whole numbers; the covariance V of x is summed from rows centred by them. All sums are made in the
tasks and added up in a tree of bounded groups, so the driver gets a handful of dimension x dimension
matrices, however many rows there are.

V is taken apart on the driver (its size depends on the dimension alone). The polar factor of V - sI,
by the dynamically weighted Halley iteration in its QR form, is the matrix sign; half of it plus the
identity projects on the subspace of eigenvalues above s. V is restricted to that subspace and to its
complement, and both are split again until single components are left. A block whose eigenvalues
can't be told apart in double precision is a multiple of the identity, and any basis of it will do.

Defined cases: rows whose vector is null, or holds null or non-finite components, or components
beyond 2^53 in size (x is no exact number there), are dropped; so are empty vectors and those of
another length than most (of the lesser length, if two are as common). A zero vector takes part.
Repeated rows and rows without an id count and come out one by one. A component without variance (one
row, a constant dimension) has ``whitened`` null and is left out of ``identity_error``, which is null
where no component has any; ``explained`` is null where the trace is zero. A ``deviation`` beyond the
range of a long is null. An empty table gives an empty result. Names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stationflow.lineage import staged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN_IN = 32  # partial sums that one task adds up
ROWS_AT_A_TIME = 4_096
EPS = float(np.finfo(float).eps)
MOST = float(1 << 53)
LEAST_VARIANCE = 1e-13  # of the largest eigenvalue, times the dimension: below it a component counts as constant


# --- polar decomposition and the splits on it -----------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QDWH iterations."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), 1e-300)
    low = EPS  # no singular value that can be told from zero is smaller
    for _ in range(30):
        weight = np.cbrt(4 * (1 - low * low) / low ** 4)
        p = np.sqrt(1 + weight) + 0.5 * np.sqrt(8 - 4 * weight + 8 * (2 - low * low) / (low * low * np.sqrt(1 + weight)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (p + q * low * low) / (1 + r * low * low))
        if low > 1 - 10 * EPS and moved < 1e-9:  # the iteration is of third order: the next step changes nothing
            break
    return x


def _split(a: np.ndarray, shift: float, size: float) -> tuple[np.ndarray, np.ndarray] | int | None:
    """Bases of the subspaces above and below ``shift``; 0 or n if all lie on one side; None if the
    shift is too close to an eigenvalue."""
    n = len(a)
    sign = polar_factor(a - shift * np.eye(n))
    projector = 0.5 * ((sign + sign.T) / 2 + np.eye(n))
    above = np.trace(projector)
    k = int(round(float(above)))
    if abs(above - k) > 1e-6:
        return None
    if k in (0, n):
        return k
    start = np.random.default_rng(n).standard_normal((n, k))
    basis, _ = np.linalg.qr(projector @ (projector @ start))
    basis, _ = np.linalg.qr(projector @ basis)
    rest = np.linalg.qr(basis, mode="complete")[0][:, k:]
    return (basis, rest) if np.linalg.norm(rest.T @ a @ basis) <= 100 * n * EPS * size else None


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(v)
    size = float(np.linalg.norm(v)) or 1.0
    waiting, vectors = [np.eye(n)] if n else [], []
    while waiting:
        basis = waiting.pop()
        if basis.shape[1] == 1:
            vectors.append(basis)
            continue
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        m, diagonal = len(block), np.diag(block)
        radius = np.abs(block).sum(axis=1) - np.abs(diagonal)
        low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
        # the diagonal says where eigenvalues are; bounds close in on them where a try gives no split
        shift, nudge = float(np.median(diagonal)), 0
        while high - low > 4 * m * EPS * size:
            found = _split(block, shift, size)
            if isinstance(found, tuple):
                waiting += [basis @ part for part in found]
                break
            if found is None:  # close to an eigenvalue: a place a little off, at another distance each time
                nudge += 1
                shift = low + (high - low) * ((0.5 + nudge * 0.6180339887) % 1.0)
                if nudge > 40:
                    break
                continue
            low, high = (shift, high) if found == m else (low, shift)
            shift = (low + high) / 2
        else:
            vectors.append(basis)
            continue
        if not isinstance(found, tuple):
            vectors.append(basis)
    q = np.hstack(vectors) if vectors else np.eye(0)
    q = np.linalg.qr(q)[0] if n else q
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


# --- sums over rows --------------------------------------------------------------------------------

def _summed(partials: DataFrame, kind: str) -> np.ndarray:
    """Sum of packed arrays (columns part, sums), FAN_IN at a time in every task."""
    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, kind) for s in group["sums"])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "sums": [total.tobytes()]})

    partials = staged(partials)
    while partials.count() > FAN_IN:
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        partials = staged(partials.groupBy(group).applyInPandas(added, "part long, sums binary"))
    return sum(np.frombuffer(r["sums"], kind) for r in partials.orderBy("part").collect())  # FAN_IN rows at most


def _partial(rows: DataFrame, column: str, make, kind: str) -> DataFrame:
    """One packed array per task: ``make`` of each batch's matrix, added up."""
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for k in range(0, len(frame), ROWS_AT_A_TIME):
                part = make(_matrix(frame[column].iloc[k:k + ROWS_AT_A_TIME], kind))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]})

    return rows.select(column).mapInPandas(sums, "part long, sums binary")


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and lower 32 bits, which a task can't bring to overflow."""
    return np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


def _covariance(rows: DataFrame, column: str, kind: str, centred, n: int) -> np.ndarray:
    """Covariance, divisor n, of the rows that ``centred`` makes of packed ones."""
    def products(x: np.ndarray) -> np.ndarray:
        d = centred(x)
        return (d.T @ d).ravel()

    total = _summed(_partial(rows, column, products, kind), "<f8")
    side = round(len(total) ** 0.5)
    return total.reshape(side, side) / n


# --- the operator ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Fitted on the fit list: its size, exact sums, eigenvalues (falling), eigenvectors (columns), trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def varied(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > max(LEAST_VARIANCE * len(self.sums) * max(self.values, default=0.0), 0.0)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers: of 64 bits where they hold, else of any size."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1)
        if most + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        exact = self.exact(x)
        if exact.dtype != object and float(np.abs(exact).max(initial=0)) ** 2 * max(1, exact.shape[1]) < float(1 << 62):
            return (exact * exact).sum(axis=1).tolist()
        whole = [sum(v * v for v in row) for row in exact.astype(object)]
        return [v if v < 1 << 63 else None for v in whole]

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Components of rows, NaN where a component has no variance."""
        scale = np.where(self.varied, np.sqrt(np.where(self.varied, self.values, 1.0)), np.nan)[:components]
        return (self.centred(x) @ self.vectors[:, :components]) / scale


def whole_numbers(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``key`` and ``x`` (packed 64-bit whole numbers) of the rows that take part, staged, and their dimension."""
    good = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= MOST, F.lit(False)))
    rows = table.select(key, vector).where(good & (F.size(vector) > 0))
    common = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = common[0]["n"] if common else 0

    @pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series(
            [(np.floor(SCALE * np.asarray(v, float)).astype("<i8") + SHIFT).tobytes() for v in vectors], dtype=object)

    return staged(rows.where(F.size(vector) == width).select(key, packed(vector).alias("x"))), width


def fit(rows: DataFrame, width: int) -> Whitening | None:
    """From ``whole_numbers``; None without any row."""
    n = rows.count()
    if not n:
        return None
    halves = _summed(_partial(rows, "x", _halves, "<i8"), "<i8")
    sums = tuple((int(a) << 32) + int(b) for a, b in zip(halves[:width], halves[width:]))
    centring = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0).centred
    covariance = _covariance(rows, "x", "<i8", centring, n)
    values, vectors = eigenvectors((covariance + covariance.T) / 2)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def whitened(
    table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key``, component (from 1), n, deviation, whitened, explained, identity_error; one row per row and component."""
    rows, width = whole_numbers(table, key, vector)
    model, spark = fit(rows, width), table.sparkSession
    if model is None:
        return spark.createDataFrame([], f"{key} long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    components = min(components, width)
    # the model is a matrix of the dimension squared, whatever the number of rows
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("deviation long, at binary")
    def projected(column: pd.Series) -> pd.DataFrame:
        deviations, at = [], []
        for k in range(0, len(column), ROWS_AT_A_TIME):
            x = _matrix(column.iloc[k:k + ROWS_AT_A_TIME], "<i8")
            deviations += shared.value.deviations(x)
            at += [row.tobytes() for row in shared.value.whiten(x, components)]
        return pd.DataFrame({"deviation": pd.array(deviations, dtype="Int64"), "at": pd.Series(at, dtype=object)})

    @pandas_udf("array<double>")
    def unpacked(column: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(a, "<f8") for a in column], dtype=object)

    projections = staged(rows.select(key, projected("x").alias("p")).select(key, "p.*"))
    used = model.varied[:components]
    error = None
    if used.any():
        mean = _summed(_partial(projections, "at", lambda a: a.sum(axis=0), "<f8"), "<f8") / model.n
        spread = _covariance(projections, "at", "<f8", lambda a: (a - mean)[:, used], model.n)
        error = float(np.abs(spread - np.eye(len(spread))).max())
    shares = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double")
                       for v in model.values[:components]])
    out = projections.select(key, "deviation", F.posexplode(unpacked("at")).alias("place", "value"))
    return out.select(
        key, (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), shares[F.col("place")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
