"""Rows in hand: a small table of one model, checked as it is made and after every change."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Row, SparkSession

from .expr import Expr
from .model import Model
from .plans.pipeline import Pipeline
from .session import Engine, Write


class DataSet:
    """Eager: meant for tests and for data that fits the driver; an engine holds the rest."""

    def __init__(self, spark: SparkSession, model: Model, rows: list[dict[str, Any]]):
        self.model, self.engine = model, Engine(spark)
        self.engine.load(model, rows)

    def rows(self) -> list[Row]:
        return self.engine.rows(self.model)

    def validate(self) -> None:
        self.engine.validate()

    def filter(self, condition: Expr) -> list[Row]:
        return self.engine.collect(Pipeline.from_model(self.model).filter(condition))

    def apply(self, write: Write) -> None:
        """All of the write or nothing."""
        self.engine.apply(write)
