"""Evaluation reports as one row, by built-in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _some(n, value):
    """An evaluation of nothing is an error."""
    return F.when(n == 0, F.raise_error(F.lit("ML-EVALUATION-001: there is nothing to evaluate")).cast("double")).otherwise(value)


def evaluate_binary(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(total, correct, accuracy)."""
    right = F.col(expected).eqNullSafe(F.col(predicted))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.count(F.when(right, 1)).alias("correct"), _some(n, F.avg(F.when(right, 1.0).otherwise(0.0))).alias("accuracy"))


def evaluate_regression(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(total, mse, mae); values must be finite."""
    e, p = F.col(expected).cast("double"), F.col(predicted).cast("double")
    finite = ~F.isnan(e) & ~F.isnan(p) & (F.abs(e) < float("inf")) & (F.abs(p) < float("inf"))
    d = F.when(F.coalesce(finite, F.lit(False)), e - p).otherwise(F.raise_error(F.lit("ML-EVALUATION-002: a value is not a finite number")).cast("double"))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), _some(n, F.avg(d * d)).alias("mse"), _some(n, F.avg(F.abs(d))).alias("mae"))
