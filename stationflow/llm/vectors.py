"""Vectors as packed bytes, and which of them take part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stationflow.lineage import staged


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty, not all zero, and holds no null or non-finite component."""
    good = F.forall(vector, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return rows.where(good & F.exists(vector, lambda x: x != 0))


def packed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``vec`` (the components as little-endian bytes) of usable, distinct rows, staged.

    Rows without a key are left out. Only vectors of the commonest length are kept (of the lesser one, if two are as common), since
    others can be held against nothing.
    """
    rows = usable(rows.select(key, vector), vector).where(F.col(key).isNotNull())
    sizes = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    single = isinstance(rows.schema[vector].dataType.elementType, T.FloatType)

    @pandas_udf("binary")
    def to_bytes(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, "<f4" if single else "<f8").tobytes() for v in vectors], dtype=object)

    rows = rows.where(F.size(vector) == (sizes[0]["n"] if sizes else 0))
    bytes_each = F.lit(4 if single else 8).alias("width")
    return staged(rows.select(key, to_bytes(vector).alias("vec"), bytes_each).distinct())


def matrix(column, width: int) -> np.ndarray:
    """Rows of packed vectors in double precision."""
    values = list(column)
    if not values:
        return np.empty((0, 0))
    return np.frombuffer(b"".join(values), f"<f{width}").reshape(len(values), -1).astype(np.float64)


def width_of(rows: DataFrame) -> int:
    first = rows.select("width").first()
    return first["width"] if first else 4
