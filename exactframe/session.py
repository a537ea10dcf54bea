"""The engine: a registry of tables by model, queries, constraint-checked writes and transactions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import ExactError
from .expr import Expr
from .model import Model, present, row
from .operators.writes import Delete, Insert, Update
from .plans.compile import Compiler, Scope
from .plans.identity import exact_key
from .plans.lower import lower
from .plans.pipeline import Pipeline

Write = Insert | Update | Delete
#: A write makes a plan on top of the last one's. After so many, the table is written to the checkpoint folder, if there is one.
CUT_AFTER = 16


@dataclass(frozen=True)
class Limits:
    """Of what is brought to the driver, and of plans. Rows inside Spark have no limit."""

    rows: int = 100_000
    bytes: int = 64 << 20
    plan_nodes: int = 16_384
    timeout_seconds: float | None = None
    concurrency: int = 1

    def __post_init__(self) -> None:
        if self.concurrency <= 0:
            raise ExactError("ENGINE-LIMIT-003", "at least one query must be allowed to run")


@dataclass(frozen=True)
class CachePolicy:
    """How many compiled plans an engine keeps, and of what size: bytes of their analysed plans as text."""

    entries: int = 256
    bytes: int = 64 << 20
    entry_bytes: int = 4 << 20

    def __post_init__(self) -> None:
        if min(self.entries, self.bytes, self.entry_bytes) <= 0:
            raise ExactError("ENGINE-CACHE-001", "a plan cache must be allowed at least one entry and some bytes, in all and for one plan")
        if self.entry_bytes > self.bytes:
            raise ExactError("ENGINE-CACHE-002", "one cached plan may not be allowed more bytes than all of them")


class Engine:
    """Tables are immutable data frames; a write makes a new one and swaps it in when it is valid."""

    def __init__(self, spark: SparkSession, limits: Limits = Limits(), cache: CachePolicy = CachePolicy()):
        self.spark, self.limits, self.cache = spark, limits, cache
        self._writes = 0
        self.models: dict[str, Model] = {}
        self.tables: dict[str, DataFrame] = {}
        #: By exact key: the plan, its bytes, and the pipeline, which keeps alive what the key names by address.
        self._plans: dict[str, tuple[DataFrame, int, Pipeline]] = {}

    # --- registry ------------------------------------------------------------
    def register(self, model: Model) -> None:
        known = self.models.get(model.key)
        if known is not None and not known.same(model):
            raise ExactError("MEMORY-STORE-002", f"another definition of {model.key} is registered here")
        if known is None:
            self.bind(model, self.spark.createDataFrame([], model.schema()))

    def load(self, model: Model, rows: list[dict[str, Any]]) -> None:
        """Rows by field key; they are checked against the model and its constraints."""
        if model.key in self.models:
            raise ExactError("MEMORY-STORE-001", f"{model.key} has a table here already")
        df = self._rows(model, rows)
        self._constraints(model, df)
        self.bind(model, df)

    def bind(self, model: Model, df: DataFrame) -> None:
        """A data frame that has the model's columns; its contents are taken on trust until ``validate``."""
        want = model.schema()
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}  # whether elements can be null is left to the data
        for f in want.fields:
            if have.get(f.name) != f.dataType.simpleString():
                raise ExactError("MEMORY-STORE-004", f"column {f.name} is {have.get(f.name)}, the model wants {f.dataType}")
        self.models[model.key] = model
        self.tables[model.key] = df.select(*(F.col(f"`{f.name}`") for f in want.fields))
        self._plans.clear()

    def table(self, model: Model) -> DataFrame:
        if model.key not in self.models:
            raise ExactError("MEMORY-STORE-003", f"there is no table of {model.key}")
        if not self.models[model.key].same(model):
            raise ExactError("MEMORY-STORE-004", f"{model.key} is registered here with another definition")
        return self.tables[model.key]

    def clear(self) -> None:
        self.models.clear()
        self.tables.clear()
        self._plans.clear()

    def rows(self, model: Model) -> list[Row]:
        return self._bounded(self.table(model))

    def _rows(self, model: Model, rows: list[dict[str, Any]]) -> DataFrame:
        return self.spark.createDataFrame([row(model, r) for r in rows], model.schema())

    # --- queries -------------------------------------------------------------
    def execute(self, pipeline: Pipeline, **parameters: Any) -> DataFrame:
        """The pipeline's rows as a lazy data frame."""
        key = exact_key(pipeline) if not parameters else ""
        if key and key in self._plans:
            return self._plans[key][0]
        df = Compiler(self.table, parameters).result(pipeline)
        if key:
            size = len(df._jdf.queryExecution().analyzed().toString())
            if size <= self.cache.entry_bytes:
                while self._plans and (len(self._plans) >= self.cache.entries or sum(s for _, s, _ in self._plans.values()) + size > self.cache.bytes):
                    self._plans.pop(next(iter(self._plans)))
                self._plans[key] = (df, size, pipeline)
        return df

    def collect(self, pipeline: Pipeline, **parameters: Any) -> list[Row]:
        return self._bounded(self.execute(pipeline, **parameters))

    def _bounded(self, df: DataFrame) -> list[Row]:
        out, size, began = [], 0, time.monotonic()
        for r in df.limit(self.limits.rows + 1).toLocalIterator():
            if len(out) == self.limits.rows:
                raise ExactError("ENGINE-LIMIT-004", f"more than {self.limits.rows} rows would come to the driver")
            size += len(str(r))
            if size > self.limits.bytes:
                raise ExactError("ENGINE-COLLECT-002", f"more than {self.limits.bytes} bytes would come to the driver")
            if self.limits.timeout_seconds is not None and time.monotonic() - began > self.limits.timeout_seconds:
                raise ExactError("ENGINE-LIMIT-006", f"collecting took longer than {self.limits.timeout_seconds} seconds")
            out.append(r)
        return out

    def stream(self, pipeline: Pipeline, batch_rows: int = 1024, **parameters: Any) -> Iterator[list[Row]]:
        """The rows in batches, pulled as they are asked for; closing the iterator cancels the rest."""
        batch: list[Row] = []
        for r in self.execute(pipeline, **parameters).toLocalIterator():
            batch.append(r)
            if len(batch) == batch_rows:
                yield batch
                batch = []
        if batch:
            yield batch

    def explain(self, pipeline: Pipeline) -> list[dict[str, str]]:
        """One step per logical node, all run by Spark, and Spark's own plan as the last step's detail."""
        steps: list[dict[str, str]] = []
        seen: set[int] = set()
        todo = [(pipeline, False)]
        while todo:
            p, ready = todo.pop()
            if id(p) in seen:
                continue
            if not ready:
                todo += [(p, True), *((i, False) for i in reversed(p.inputs))]
                continue
            seen.add(id(p))
            steps.append({"operation": p.op, "site": "engine", "detail": str(p.data[0]) if p.op in ("join", "set") else ""})
        plan = self.execute(pipeline)._jdf.queryExecution().toString()
        return [*steps, {"operation": "plan", "site": "spark", "detail": plan}]

    # --- constraints ---------------------------------------------------------
    def validate(self) -> None:
        """Identity, unique and reference constraints of all tables."""
        for m in self.models.values():
            self._constraints(m, self.tables[m.key])
        self._references(self.tables)

    def _constraints(self, model: Model, df: DataFrame) -> None:
        for keys, code, what in [*([(model.identity, "DATASET-IDENTITY-001", "two rows share an identity")] if model.identity else []), *((u, "DATASET-UNIQUE-001", "two rows share values that must be unique") for u in model.uniques)]:
            if repeated(df, [model.field(k).name for k in keys]).limit(1).take(1):
                raise ExactError(code, f"{what} in model {model.key}")

    def _references(self, tables: dict[str, DataFrame]) -> None:
        for m in self.models.values():
            for r in m.references:
                bad = unreferenced(m, self.models.get(r.target), tables, r)
                if bad.limit(1).take(1):
                    raise ExactError("MEMORY-REFERENCE-002", f"a row of {m.key} refers to a row of {r.target} that is not there")

    # --- writes --------------------------------------------------------------
    def apply(self, write: Write) -> None:
        """All of the write, with all constraints and references holding after it, or nothing."""
        model = self._written(write)
        changed = written(self.tables[model.key], write, self._rows)
        self._constraints(model, changed)
        self._references({**self.tables, model.key: changed})
        self._writes += 1
        if self._writes % CUT_AFTER == 0 and self.spark.sparkContext.getCheckpointDir():
            changed = changed.checkpoint()
        self.tables[model.key] = changed
        self._plans.clear()

    def _written(self, write: Write) -> Model:
        if not isinstance(write, Write):
            raise ExactError("WRITE-SCOPE-002", "say which rows: filter(...) or all()")
        if write.model.key not in self.models:
            raise ExactError("MEMORY-WRITE-001", f"there is no table of {write.model.key} to write to")
        if not self.models[write.model.key].same(write.model):
            raise ExactError("MEMORY-WRITE-002", f"the table of {write.model.key} has another definition")
        return write.model

    def begin(self, isolation: str = "serializable", max_writes: int = 1024, max_rows: int | None = None, max_bytes: int | None = None) -> Transaction:
        """``max_rows`` and ``max_bytes`` bound the written tables, all together (bytes: of their rows as JSON); checking them reads these tables."""
        if isolation != "serializable":
            raise ExactError("MEMORY-TX-001", "transactions are serializable here, nothing weaker")
        return Transaction(self, max_writes, max_rows, max_bytes)


class Transaction:
    """Writes to private copies. References are checked at commit, which publishes all tables or none."""

    def __init__(self, engine: Engine, max_writes: int, max_rows: int | None = None, max_bytes: int | None = None):
        self.engine, self.max_writes, self.writes = engine, max_writes, 0
        self.max_rows, self.max_bytes, self.sizes = max_rows, max_bytes, {}
        self.tables, self.open = dict(engine.tables), True
        self._base = dict(engine.tables)

    def apply(self, write: Write) -> None:
        if self.writes >= self.max_writes:
            raise ExactError("MEMORY-TX-002", f"a transaction makes at most {self.max_writes} writes")
        model = self.engine._written(write)
        changed = written(self.tables[model.key], write, self.engine._rows)
        self.engine._constraints(model, changed)
        if self.max_rows is not None or self.max_bytes is not None:
            size = F.length(F.to_json(F.struct("*"))) if self.max_bytes is not None else F.lit(0)
            sizes = {**self.sizes, model.key: changed.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()}
            if self.max_rows is not None and sum(s[0] for s in sizes.values()) > self.max_rows:
                raise ExactError("MEMORY-TX-003", f"the tables written in this transaction hold more than {self.max_rows} rows")
            if self.max_bytes is not None and sum(s[1] for s in sizes.values()) > self.max_bytes:
                raise ExactError("MEMORY-TX-004", f"the tables written in this transaction hold more than {self.max_bytes} bytes")
            self.sizes = sizes
        self.tables[model.key] = changed
        self.writes += 1

    def commit(self) -> None:
        if any(self.engine.tables.get(k) is not v for k, v in self._base.items()):
            raise ExactError("MEMORY-TX-005", "someone else wrote since this transaction began")
        self.engine._references(self.tables)
        self.engine.tables.update(self.tables)
        self.engine._plans.clear()
        self.open = False

    def rollback(self) -> None:
        self.tables, self.open = {}, False


def written(df: DataFrame, write: Write, rows: Any) -> DataFrame:
    """The table after the write."""
    model = write.model
    if isinstance(write, Insert):
        return df.unionByName(rows(model, list(write.rows)))
    scope = Scope(model, None, "")
    ctx = Compiler(lambda m: df)._context((scope,), (), False)
    hit = F.lit(True) if write.condition is None else F.coalesce(lower(write.condition, ctx).value, F.lit(False))
    if isinstance(write, Delete):
        return df.filter(~hit)
    changed: dict[str, Column] = {}
    for key, e in write.assignments:
        f, got = model.field(key), lower(e, ctx)
        value = got.value
        if not f.type.null:
            value = F.when(value.isNull(), F.raise_error(F.lit("RUNTIME-003: null where no null may be")).cast(f.type.spark())).otherwise(value)
        changed[f.name] = F.when(hit, value).otherwise(F.col(f"`{f.name}`"))
        if f.optional:
            there = F.lit(True) if got.missing is None else ~got.missing
            changed[present(f.name)] = F.when(hit, there).otherwise(F.col(f"`{present(f.name)}`"))
    return df.select(*(changed.get(n, F.col(f"`{n}`")).alias(n) for n in (f.name for f in model.schema().fields)))


def repeated(df: DataFrame, names: list[str]) -> DataFrame:
    """The tuples that several rows have; those with null or missing parts do not count."""
    columns = [F.col(f"`{n}`") for n in names]
    for c in columns:
        df = df.filter(c.isNotNull())
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("times!")).filter("`times!` > 1").drop("times!")


def unreferenced(model: Model, target: Model | None, tables: dict[str, DataFrame], ref: Any) -> DataFrame:
    """Rows whose reference, without nulls, has no row in the target."""
    if target is None:
        raise ExactError("MEMORY-REFERENCE-001", f"the reference leads to {ref.target}, which has no table")
    a = tables[model.key].alias("a")
    b = tables[target.key].alias("b")
    pairs = [(model.field(s).name, target.field(t).name) for s, t in zip(ref.source_fields, ref.target_fields, strict=True)]
    for s, _ in pairs:
        a = a.filter(F.col(f"a.`{s}`").isNotNull())
    on = [F.col(f"a.`{s}`") == F.col(f"b.`{t}`") for s, t in pairs]
    return a.join(b, on, "left_anti")


def evaluate(e: Expr, model: Model, values: dict[str, Any], spark: SparkSession, **parameters: Any) -> Any:
    """One expression on one row. Unknown comes back as None."""
    engine = Engine(spark)
    engine.bind(model, engine._rows(model, [values]))
    c = Compiler(engine.table, parameters)
    done = c.run(Pipeline.from_model(model))
    return done.df.select(c._lower(e, done).value.alias("value")).first()[0]
