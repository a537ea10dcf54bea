"""Parquet files as tables of a model: explicit columns, and mappings that the source's owner declares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Model


def read(spark: SparkSession, path: str, model: Model, mapping: Mapping[str, str] | None = None, stored_as: Mapping[str, str] | None = None) -> DataFrame:
    """The model's columns of the file. ``mapping``: field name to an SQL expression over the file's columns, where its own column is not it.

    ``stored_as``: field name to the type that the file has, where it is not the model's. With it, the file's schema is
    declared as a whole and nothing is read to plan. A mapping may narrow (a double to a decimal), which no expression
    of the language may: that is the owner's to say.
    """
    mapping = mapping or {}
    want = model.schema()
    if stored_as is not None and not mapping:
        declared = ", ".join(f"`{f.name}` {stored_as.get(f.name, f.dataType.simpleString())}" for f in want.fields)
        raw = spark.read.schema(declared).parquet(path)
    else:
        raw = spark.read.parquet(path)

    def column(name: str, dtype) -> Column:
        value = F.expr(mapping[name]) if name in mapping else F.col(f"`{name}`")
        same = name not in mapping and raw.schema[name].dataType.simpleString() == dtype.simpleString()
        return (value if same else value.cast(dtype)).alias(name)

    return raw.select(*(column(f.name, f.dataType) for f in want.fields))
