"""JSON Lines under one root folder, decoded strictly: what Spark's own reader accepts silently is an error here.

Each line is one object. Blank or malformed lines, duplicate keys, and unknown fields are rejected; an absent field is
missing, a null is null. Lines are split and spread by Spark; each task decodes its own.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import ExactError
from ..model import Model, present
from ..model import row as checked_row
from ..plans.compile import Compiler
from ..plans.pipeline import Pipeline
from ..types import Type

#: What a JSON Lines source runs; joins, sorting, grouping and so on need an engine.
SUPPORTED = frozenset(("source", "filter", "project", "slice", "unnest"))


@dataclass(frozen=True)
class JsonlLimits:
    source_bytes: int = 1 << 30
    line_bytes: int = 8 << 20
    rows: int = 10_000_000
    depth: int = 64

    def __post_init__(self) -> None:
        if min(self.source_bytes, self.line_bytes, self.rows, self.depth) <= 0:
            raise ExactError("JSONL-LIMIT-000", "every limit on a JSON Lines source must allow something")


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("duplicate object key")
    return out


def _constant(_: str) -> Any:
    raise ValueError("NaN and infinities are written as strings")


_SECOND = re.compile(r"(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?")


def _nanos(text: str) -> int:
    m = _SECOND.fullmatch(text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3]) > 59:
        raise ValueError("not a time")
    return ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1_000_000_000 + int((m[4] or "0").ljust(9, "0"))


def _typed(v: Any, ty: Type, depth: int, most: int) -> Any:
    """A JSON value as a value of the type, in the written form that is exact for it."""
    if depth > most:
        raise ExactError("JSONL-LIMIT-004", "a line is nested deeper than allowed")
    if v is None:
        return None
    k, inner = ty.kind, depth + 1
    if k == "list":
        return [_typed(x, ty.parts[0], inner, most) for x in _want(v, list)]
    if k == "tuple":
        if len(_want(v, list)) != len(ty.parts):
            raise ExactError("JSONL-DECODE-006", f"a tuple of {len(ty.parts)} has {len(v)} elements in the line")
        return tuple(_typed(x, p, inner, most) for x, p in zip(v, ty.parts, strict=True))
    if k == "record":
        known = dict(zip(ty.names, ty.parts, strict=True))
        return {n: _typed(x, known[n], inner, most) for n, x in _want(v, dict).items()}
    if k == "map":
        return [(_typed(a, ty.parts[0], inner, most), _typed(b, ty.parts[1], inner, most)) for a, b in _want(v, list)]
    if k == "bool":
        return _want(v, bool)
    if k == "truth":
        return None if v == "unknown" else _want(v, bool)
    if ty.is_int or k in ("month", "weekday"):
        if isinstance(v, str) and re.fullmatch(r"-?\d+", v) and ty.is_int and ty.bits == 128:
            return int(v)
        if isinstance(v, bool):
            raise ValueError("not an integer")
        return _want(v, int)
    if k == "f32":
        return _float(_want(v, str))
    if k == "f64":
        return _float(v) if isinstance(v, str) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else _want(v, float)
    _want(v, str)
    if k == "decimal":
        return decimal.Decimal(v)
    if k == "bytes":
        if not v.startswith("hex:"):
            raise ValueError("bytes are written hex:...")
        return bytes.fromhex(v[4:])
    if k == "date":
        return dt.date.fromisoformat(v)
    if k == "time":
        return _nanos(v)
    if k == "local":
        day, _, clock = v.partition("T")
        return dt.datetime.combine(dt.date.fromisoformat(day), dt.time()) + _micros(_nanos(clock))
    if k == "instant":
        if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d{1,6})?([Zz]|[+-]\d\d:\d\d)", v):
            raise ValueError("not an RFC 3339 instant with at most microseconds")
        return dt.datetime.fromisoformat(v.upper().replace("Z", "+00:00"))
    if k == "duration":
        return int(v) if re.fullmatch(r"-?\d+", v) else _want(v, int)
    return v


def _micros(nanos: int) -> dt.timedelta:
    if nanos % 1000:
        raise ValueError("this mapping holds microseconds")
    return dt.timedelta(microseconds=nanos // 1000)


def _float(text: str) -> float:
    if text in ("NaN", "Infinity", "-Infinity"):
        return float(text.replace("Infinity", "inf"))
    x = float(text)
    if not math.isfinite(x) or not re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", text):
        raise ValueError("not a float")
    return x


def _want(v: Any, kind: type) -> Any:
    if not isinstance(v, kind):
        raise ValueError(f"expected {kind.__name__}")
    return v


def decode_line(line: str, model: Model, limits: JsonlLimits) -> tuple:
    """One line as a tuple for ``model.schema()``."""
    if len(line.encode("utf-8", "surrogatepass")) > limits.line_bytes:
        raise ExactError("JSONL-LIMIT-002", "a line is longer than allowed")
    if "\ufffd" in line:
        raise ExactError("JSONL-DECODE-007", "a line holds bytes that are not UTF-8")
    try:
        got = json.loads(line, object_pairs_hook=_pairs, parse_constant=_constant)
    except (ValueError, RecursionError) as e:
        raise ExactError("JSONL-DECODE-001", f"invalid JSON: {e}") from e
    if not isinstance(got, dict):
        raise ExactError("JSONL-DECODE-002", "a line is one object, nothing else")
    names = {f.name: f for f in model.fields}
    values = {}
    for n, v in got.items():
        if n not in names:
            raise ExactError("JSONL-DECODE-003", f"a line has a field {n}, which {model.key} has not")
        f = names[n]
        try:
            values[f.key] = _typed(v, f.type, 1, limits.depth)
        except ExactError:
            raise
        except (ValueError, KeyError, TypeError, ArithmeticError) as e:
            raise ExactError("JSONL-DECODE-005", f"the value of {n} is not of its type: {e}") from e
    try:
        return checked_row(model, values)
    except ExactError as e:
        raise ExactError("JSONL-DECODE-004", f"the line is no row of the model: {e}") from e


def decoder(model: Model, limits: JsonlLimits):
    """For ``mapInArrow`` over a column of lines."""
    schema = to_arrow_schema(model.schema())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            if seen > limits.rows:  # of one task, so that no count over all is needed
                raise ExactError("JSONL-LIMIT-003", "more rows were read than allowed")
            rows = [decode_line(x, model, limits) for x in batch.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(_arrow(c, f.type), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return decode


def _arrow(values: Any, ty: pa.DataType) -> list:
    if pa.types.is_struct(ty):
        return [None if v is None else {ty.field(k).name: x for k, x in enumerate(v)} for v in values]
    if pa.types.is_map(ty):
        return [None if v is None else list(v.items()) for v in values]
    return list(values)


class JsonlEngine:
    """Files below ``root``, each with a model; pipelines of filters, projections, slices and unnests over one of them."""

    def __init__(self, spark: SparkSession, root: str, limits: JsonlLimits = JsonlLimits()):
        self.spark, self.limits = spark, limits
        try:
            self.root = Path(root).resolve(strict=True)
        except OSError as e:
            raise ExactError("JSONL-SOURCE-001", f"the root folder cannot be found: {e}") from e
        self.files: dict[str, tuple[Model, Path]] = {}

    def bind(self, model: Model, path: str) -> None:
        if model.key in self.files:
            raise ExactError("JSONL-SOURCE-004", f"{model.key} has a file already")
        self.files[model.key] = (model, self._inside(path))

    def _inside(self, path: str) -> Path:
        try:
            at = (self.root / path).resolve(strict=True)
        except OSError as e:
            raise ExactError("JSONL-SOURCE-005", f"the file cannot be found: {e}") from e
        if Path(path).is_absolute() or ".." in Path(path).parts or not at.is_relative_to(self.root):
            raise ExactError("JSONL-SOURCE-002", "the file lies outside the root folder")
        if not at.is_file():
            raise ExactError("JSONL-SOURCE-003", "this is not a plain file")
        return at

    def table(self, model: Model) -> DataFrame:
        if model.key not in self.files:
            raise ExactError("JSONL-SOURCE-006", f"{model.key} has no file")
        known, path = self.files[model.key]
        if not known.same(model):
            raise ExactError("JSONL-SOURCE-007", f"the file of {model.key} was given with another definition")
        at = self._inside(str(path.relative_to(self.root)))
        if at.stat().st_size > self.limits.source_bytes:
            raise ExactError("JSONL-LIMIT-001", "the file is larger than allowed")
        return read_lines(self.spark, at.as_uri(), model, self.limits)

    def execute(self, pipeline: Pipeline, **parameters: Any) -> DataFrame:
        todo = [pipeline]
        while todo:
            p = todo.pop()
            if p.op not in SUPPORTED or (p.op == "filter" and any(_has_exists(e) for e in p.data)):
                raise ExactError("ENGINE-PLACEMENT-001", f"a JSONL source cannot run {p.op if p.op not in SUPPORTED else 'exists'}")
            todo += p.inputs
        return Compiler(self.table, parameters).result(pipeline)


def _has_exists(e: Any) -> bool:
    return e.op == "exists" or any(_has_exists(a) for a in e.args)


def read_lines(spark: SparkSession, path: str, model: Model, limits: JsonlLimits = JsonlLimits()) -> DataFrame:
    """Any path that Spark can read."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.mapInArrow(decoder(model, limits), model.schema())


def optional_columns(model: Model) -> list[str]:
    return [present(f.name) for f in model.fields if f.optional]
