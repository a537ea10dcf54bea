"""Exact vector search: every candidate is measured, in double precision, and the first few are returned in a total order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExactError

METRICS = ("euclidean", "cosine", "inner_product")
MAX_DIMENSIONS, MAX_ID_BYTES = 16_384, 1024


def check_vector(v: list[float]) -> list[float]:
    if not v or len(v) > MAX_DIMENSIONS:
        raise ExactError("ML-VECTOR-001", f"a vector has from 1 to {MAX_DIMENSIONS} dimensions")
    if not all(math.isfinite(x) for x in v):
        raise ExactError("ML-VECTOR-002", "a vector has finite components only")
    return v


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def metric_value(a: Column, b: Column, metric: str) -> Column:
    """Of two arrays of doubles of one length. A zero vector has no cosine: that is an error."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p * q))
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    if metric == "inner_product":
        return dot(a, b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    zero = F.raise_error(F.lit("ML-VECTOR-003: cosine of a zero vector")).cast("double")
    return F.when(norms == 0, zero).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def exact_search(candidates: DataFrame, id_column: str, vector_column: str, target: list[float], metric: str, limit: int) -> DataFrame:
    """(id, metric) of the ``limit`` best: nearest by distance, largest by similarity, ties by id.

    Spark keeps the best of each task and merges them, so nothing else is shuffled.
    """
    if metric not in METRICS:
        raise ExactError("ML-VECTOR-004", f"unknown metric {metric}")
    check_vector(target)
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    t = F.array(*(F.lit(float(x)) for x in target))
    fits = (F.size(v) == len(target)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = F.raise_error(F.lit("ML-VECTOR-002: a candidate has another length or a component that is not finite")).cast("array<double>")
    key = F.col(id_column)
    if candidates.schema[id_column].dataType.typeName() == "string":
        long = F.raise_error(F.lit(f"ML-VECTOR-005: an id has 1 to {MAX_ID_BYTES} bytes")).cast("string")
        key = F.when(key.isNull() | F.octet_length(key).between(1, MAX_ID_BYTES), key).otherwise(long)
    rows = candidates.select(key.alias("id"), F.when(fits, v).otherwise(bad).alias("v")).select("id", metric_value(F.col("v"), t, metric).alias("metric"))
    return rows.orderBy(F.asc("metric") if metric == "euclidean" else F.desc("metric"), F.asc("id")).limit(limit)


def approximate_search(*_: object) -> DataFrame:
    """Declared, and refused: an approximate request is never answered by the exact search."""
    raise ExactError("ML-CAPABILITY-001", "approximate vector search is not offered")
