"""A read adapter for SQL databases over JDBC: catalog mappings, and offline compilation of source, filter, projection and slice.

Everything a caller gives becomes a bind value; identifiers come from the mapping alone and are quoted. Each selected
field gives a state column (0 missing, 1 null, 2 value) and a value column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ExactError
from ..expr import Expr
from ..model import Model
from ..operators.placement import Capabilities, Support
from ..plans.pipeline import Pipeline

MAX_IDENTIFIER = 63
_COMPARE = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@dataclass(frozen=True)
class ColumnMapping:
    column: str
    presence: str | None = None


@dataclass(frozen=True)
class TableMapping:
    model: Model
    schema: str
    table: str
    columns: dict[str, ColumnMapping] = field(hash=False)

    def __post_init__(self) -> None:
        for f in self.model.fields:
            m = self.columns.get(f.key)
            if m is None:
                raise ExactError("SQL-MAPPING-001", f"field {f.key} has no column")
            if f.optional != (m.presence is not None):
                raise ExactError("SQL-MAPPING-002", f"field {f.key} needs a presence column exactly if it is optional")


@dataclass(frozen=True)
class CompiledQuery:
    sql: str
    binds: tuple[Any, ...]
    columns: tuple[str, ...]


def quoted(name: str) -> str:
    if not name or len(name.encode()) > MAX_IDENTIFIER or "\0" in name:
        raise ExactError("SQL-MAPPING-003", f"an identifier has 1 to {MAX_IDENTIFIER} bytes")
    return '"' + name.replace('"', '""') + '"'


class SqlCatalog:
    def __init__(self, *tables: TableMapping):
        self.tables = {t.model.key: t for t in tables}

    def compile(self, pipeline: Pipeline, **parameters: Any) -> CompiledQuery:
        chain: list[Pipeline] = []
        p = pipeline
        while p.inputs:
            chain.insert(0, p)
            p = p.inputs[0]
        mapping = self.tables.get(p.data[0].key)
        if mapping is None:
            raise ExactError("SQL-MAPPING-004", f"model {p.data[0].key} has no table mapping")
        binds: list[Any] = []
        where: list[str] = []
        selected = [(f.name, _field(mapping, f.key)) for f in mapping.model.fields]
        tail = ""
        for n in chain:
            if n.op == "filter" and not tail:
                where += [_expr(e, mapping, parameters, binds) for e in n.data]
            elif n.op == "project" and not tail:
                selected = [(name, _value(e, mapping)) for e, name in zip(n.data[0].parts, n.data[0].names, strict=True)]
            elif n.op == "slice" and not tail:
                offset, limit = n.data
                tail = (f" LIMIT {limit}" if limit is not None else "") + (f" OFFSET {offset}" if offset else "")
            else:
                raise ExactError("ENGINE-PLACEMENT-001", f"the SQL adapter cannot run {n.op} here")
        columns = ", ".join(f"{state} AS {quoted('s_' + name)}, {value} AS {quoted('v_' + name)}" for name, (state, value) in selected)
        sql = f"SELECT {columns} FROM {quoted(mapping.schema)}.{quoted(mapping.table)}"
        if where:
            sql += " WHERE " + " AND ".join(f"({w})" for w in where)
        return CompiledQuery(sql + tail, tuple(binds), tuple(name for name, _ in selected))

    def read(self, spark: SparkSession, url: str, model: Model, properties: dict[str, str] | None = None) -> DataFrame:
        """The whole mapped table through Spark's JDBC source, which pushes filters, columns and limits down itself."""
        m = self.tables[model.key]
        from pyspark.sql import functions as F

        raw = spark.read.jdbc(url, f"{quoted(m.schema)}.{quoted(m.table)}", properties=properties or {})
        out = []
        for f in model.fields:
            c = m.columns[f.key]
            out.append(F.col(f"`{c.column}`").cast(f.type.spark()).alias(f.name))
            if c.presence:
                out.append(F.col(f"`{c.presence}`").alias(f"{f.name}__present"))
        return raw.select(*out)

    @staticmethod
    def capabilities() -> Capabilities:
        native = Support("exact_native")
        return Capabilities(pipeline={k: native for k in ("source", "filter", "project", "slice")})


def _field(m: TableMapping, key: str) -> tuple[str, str]:
    c = m.columns[key]
    value = quoted(c.column)
    state = f"CASE WHEN {value} IS NULL THEN 1 ELSE 2 END"
    if c.presence:
        state = f"CASE WHEN NOT {quoted(c.presence)} THEN 0 WHEN {value} IS NULL THEN 1 ELSE 2 END"
    return state, value


def _value(e: Expr, m: TableMapping) -> tuple[str, str]:
    if e.op != "field":
        raise ExactError("ENGINE-PLACEMENT-001", "the SQL adapter projects fields only")
    return _field(m, e.data[1])


def _bind(v: Any, binds: list[Any]) -> str:
    binds.append(v)
    return f"${len(binds)}"


def _operand(e: Expr, m: TableMapping, parameters: dict[str, Any], binds: list[Any]) -> str:
    if e.op == "field":
        text = quoted(m.columns[e.data[1]].column)
        return text + ' COLLATE "C"' if e.type.kind in ("string", "char") else text
    if e.op == "literal":
        return _bind(e.data[0], binds)
    if e.op == "param":
        if e.data[0] not in parameters:
            raise ExactError("EXPR-EVAL-103", f"parameter {e.data[0]} is not bound")
        return _bind(parameters[e.data[0]], binds)
    raise ExactError("ENGINE-PLACEMENT-001", f"the SQL adapter cannot run {e.op}")


def _expr(e: Expr, m: TableMapping, parameters: dict[str, Any], binds: list[Any]) -> str:
    go = lambda x: _expr(x, m, parameters, binds)
    if e.op in ("and", "or"):
        return f"({go(e.args[0])}) {e.op.upper()} ({go(e.args[1])})"
    if e.op == "not":
        return f"NOT ({go(e.args[0])})"
    if e.op in _COMPARE:
        a, b = (_operand(x, m, parameters, binds) for x in e.args)
        plain = f"{a} {_COMPARE[e.op]} {b}"
        if e.args[0].type.is_float:  # a NaN equals nothing and is ordered with nothing
            nan = " OR ".join(f"{x} = 'NaN'" for x in (a, b))
            return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {nan} THEN {'TRUE' if e.op == 'ne' else 'FALSE'} ELSE {plain} END"
        return plain
    if e.op in ("is_null", "is_missing", "is_present") and e.args[0].op == "field":
        c = m.columns[e.args[0].data[1]]
        there = quoted(c.presence) if c.presence else "TRUE"
        return {"is_null": f"{there} AND {quoted(c.column)} IS NULL", "is_missing": f"NOT {there}", "is_present": there}[e.op]
    if e.op == "in":
        if len(e.args) == 1:
            return "FALSE"
        a, *rest = (_operand(x, m, parameters, binds) for x in e.args)
        return f"{a} IN ({', '.join(rest)})"
    if e.op == "literal":
        return _bind(e.data[0], binds)
    raise ExactError("ENGINE-PLACEMENT-001", f"the SQL adapter cannot run {e.op}")
