"""Forecast errors. Row terms are column expressions; callers average them with plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: floor of every denominator.
EPS = 1e-9


def to_volume(z: Column) -> Column:
    """Inverse of log1p, never below zero."""
    return F.greatest(F.expm1(z), F.lit(0.0))


def squared_error(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def absolute_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def percentage_error(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)) * 100.0


def symmetric_percentage_error(y: Column, p: Column) -> Column:
    return 2.0 * F.abs(p - y) / F.greatest(F.abs(y) + F.abs(p), F.lit(EPS)) * 100.0


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(squared_error(y, p)))


def smape(y: Column, p: Column) -> Column:
    return F.avg(symmetric_percentage_error(y, p))


def improvement_percent(base: Column, model: Column) -> Column:
    return 100.0 * (base - model) / F.greatest(base, F.lit(EPS))
