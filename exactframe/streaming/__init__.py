"""An extension: chains of filters, projections and unnests, which keep no state, over files as they arrive."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ExactError
from ..model import Model
from ..plans.compile import Compiler
from ..plans.pipeline import Pipeline
from ..sources.jsonl import JsonlLimits, decoder

STATELESS = frozenset(("source", "filter", "project", "unnest"))


def stream_lines(spark: SparkSession, folder: str, model: Model, limits: JsonlLimits = JsonlLimits()) -> DataFrame:
    """A streaming data frame of the model's rows, from JSON Lines files that are put into ``folder``."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return lines.mapInArrow(decoder(model, limits), model.schema())


def execute(stream: DataFrame, model: Model, pipeline: Pipeline, **parameters: Any) -> DataFrame:
    """The pipeline over the stream, as a streaming data frame; start it with ``writeStream``."""
    p = pipeline
    while True:
        if p.op not in STATELESS:
            raise ExactError("ENGINE-PLACEMENT-001", f"{p.op} needs all rows; a stream runs only {', '.join(sorted(STATELESS))}")
        if not p.inputs:
            break
        p = p.inputs[0]
    return Compiler(lambda m: stream, parameters).result(pipeline)
