"""Model inputs: standardized numeric columns and station indicators, fitted on the train rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.functions.cleaning import finite_or_null


def numeric(name: str):
    """Feature as a double: infinities count as missing, missing counts as zero."""
    return F.coalesce(finite_or_null(F.col(name).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per feature; a constant feature is only centred."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str]) -> Scaling:
        stats = train.agg(*[
            e for f in features for e in (F.avg(numeric(f)), F.stddev_pop(numeric(f)))
        ]).first()
        return cls(tuple(features), tuple(float(m) for m in stats[0::2]),
                   tuple(float(d) if d and d > 1e-12 else 1.0 for d in stats[1::2]))

    @property
    def columns(self) -> list[str]:
        return [f"z_{f}" for f in self.features]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"z_{f}": (numeric(f) - F.lit(m)) / F.lit(d)
            for f, m, d in zip(self.features, self.means, self.deviations)
        })


def station_columns(rows: DataFrame, inputs: Sequence[str], max_stations: int | None = None) -> PipelineModel:
    """Adds ``features``: the inputs and the station indicators as one sparse vector, for models that read vectors.

    The library's own models need no indicators. A station unknown to ``rows`` gets all zeros. The list of stations passes
    the driver; a caller who wants fewer columns than stations names a bound, and beyond it they are hashed.
    """
    known = rows.select("station_id").distinct().limit(max_stations + 1).count() if max_stations else 0
    assemble = VectorAssembler(inputCols=[*inputs, "station_vec"], outputCol="features")
    if not max_stations or known <= max_stations:
        stages = [
            StringIndexer(inputCol="station_id", outputCol="station_idx", handleInvalid="keep"),
            OneHotEncoder(inputCol="station_idx", outputCol="station_vec", dropLast=True),
        ]
    else:
        stages = [FeatureHasher(inputCols=["station_id"], categoricalCols=["station_id"],
                                outputCol="station_vec", numFeatures=max_stations)]
    return Pipeline(stages=[*stages, assemble]).fit(rows.select("station_id", *inputs))


def is_hashed(encoder: PipelineModel) -> bool:
    return isinstance(encoder.stages[0], FeatureHasher)
