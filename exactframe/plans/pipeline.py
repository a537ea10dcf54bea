"""Pipelines: immutable descriptions of a computation. Nothing runs, or is checked as a whole, until one is compiled."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from .. import types as t
from ..errors import ExactError
from ..expr import LENGTH, Expr, conjunction, exists
from ..model import Model
from ..types import Type

Selection = Expr | tuple[Expr, ...] | Mapping[str, Expr]
#: Elements of a tuple, at most; adjacent limits and offsets, at most what Spark takes.
MAX_TUPLE, MAX_ROWS = 12, 2**31 - 1


@dataclass(frozen=True, eq=False)
class Aggregate:
    kind: str
    input: Expr | None = None
    present: bool = False

    @property
    def type(self) -> Type:
        if self.kind.startswith("count"):
            return LENGTH
        assert self.input is not None
        return self.input.type.nullable()

    def check(self) -> Aggregate:
        if self.kind.startswith("count"):
            return self
        assert self.input is not None
        ty = self.input.type
        if self.kind == "sum" and not ty.has("exact"):
            raise ExactError("PIPELINE-AGG-004", f"{ty.name} cannot be summed exactly")
        if self.kind != "sum" and not (ty.has("ordering") and ty.has("keyable")):
            raise ExactError("PIPELINE-AGG-005", f"{self.kind} needs values with an order and an equality, which {ty.name} has not")
        if ty.null and not self.present:
            raise ExactError("PIPELINE-AGG-006", f"the input can be null: {self.kind}_present leaves nulls out")
        return self


def count() -> Aggregate:
    return Aggregate("count")


def count_present(x: Expr) -> Aggregate:
    return Aggregate("count_present", x, True)


def sum_(x: Expr) -> Aggregate:
    return Aggregate("sum", x)


def sum_present(x: Expr) -> Aggregate:
    return Aggregate("sum", x, True)


def min_(x: Expr) -> Aggregate:
    return Aggregate("min", x)


def min_present(x: Expr) -> Aggregate:
    return Aggregate("min", x, True)


def max_(x: Expr) -> Aggregate:
    return Aggregate("max", x)


def max_present(x: Expr) -> Aggregate:
    return Aggregate("max", x, True)


@dataclass(frozen=True)
class Rows:
    """A rows frame: bounds as offsets from the current row, None for unbounded."""

    start: int | None
    end: int | None

    @staticmethod
    def all() -> Rows:
        return Rows(None, None)

    @staticmethod
    def to_current() -> Rows:
        return Rows(None, 0)

    @staticmethod
    def around(n: int) -> Rows:
        return Rows(-n, n)


@dataclass(frozen=True, eq=False)
class Window:
    kind: str
    input: Expr | None = None
    present: bool = False
    partition: tuple[Expr, ...] = ()
    order: tuple[tuple[Expr, bool], ...] = ()
    rows: Rows | None = None

    def partition_by(self, *keys: Expr) -> Window:
        return replace(self, partition=keys)

    def order_by(self, key: Expr) -> Window:
        return replace(self, order=(*self.order, (key, False)))

    def order_by_desc(self, key: Expr) -> Window:
        return replace(self, order=(*self.order, (key, True)))

    def frame(self, rows: Rows) -> Window:
        return replace(self, rows=rows)

    @property
    def type(self) -> Type:
        if self.kind == "sum":
            assert self.input is not None
            return self.input.type.nullable()
        return LENGTH


def row_number() -> Window:
    return Window("row_number")


def rank() -> Window:
    return Window("rank")


def dense_rank() -> Window:
    return Window("dense_rank")


def window_sum(x: Expr) -> Window:
    return Window("sum", x)


def window_sum_present(x: Expr) -> Window:
    return Window("sum", x, True)


@dataclass(frozen=True, eq=False)
class Pipeline:
    op: str
    inputs: tuple[Pipeline, ...] = ()
    data: tuple[Any, ...] = ()

    @staticmethod
    def from_model(model: Model) -> Pipeline:
        return Pipeline("source", (), (model, None))

    @staticmethod
    def from_model_as(model: Model, alias: str) -> Pipeline:
        if not (1 <= len(alias) <= 64 and alias.isascii() and alias.isidentifier()):
            raise ExactError("PIPELINE-SCOPE-003", "an alias is a name of 1 to 64 ASCII letters, digits and underscores")
        return Pipeline("source", (), (model, alias))

    def _then(self, op: str, *data: Any) -> Pipeline:
        return Pipeline(op, (self,), data)

    def filter(self, condition: Expr) -> Pipeline:
        """Keeps rows for which the condition is True. Adjacent filters become one."""
        if condition.type.kind != "truth":
            raise ExactError("EXPR-TYPE-008", "a filter takes a truth value")
        if self.op == "filter":
            return Pipeline("filter", self.inputs, (*self.data, condition))
        return self._then("filter", condition)

    def select(self, what: Selection) -> Pipeline:
        return self._then("project", selection(what))

    def aggregate(self, what: Aggregate | tuple[Aggregate, ...] | Mapping[str, Aggregate]) -> Pipeline:
        return self._then("aggregate", None, aggregates(what))

    def aggregate_by(self, keys: Selection, what: Aggregate | tuple[Aggregate, ...] | Mapping[str, Aggregate]) -> Pipeline:
        return self._then("aggregate", selection(keys), aggregates(what))

    def order_by(self, key: Expr) -> Pipeline:
        return self._then("sort", key, False)

    def order_by_desc(self, key: Expr) -> Pipeline:
        return self._then("sort", key, True)

    def distinct(self) -> Pipeline:
        return self if self.op == "distinct" else self._then("distinct")

    def offset(self, n: int) -> Pipeline:
        return self.slice(n, None)

    def limit(self, n: int) -> Pipeline:
        return self.slice(0, n)

    def slice(self, offset: int, n: int | None) -> Pipeline:
        for v in (offset, n or 0):
            if not 0 <= v <= MAX_ROWS:
                raise ExactError("PIPELINE-LIMIT-001", f"offset and limit must be from 0 to {MAX_ROWS}")
        return self if offset == 0 and n is None else self._then("slice", offset, n)

    def _join(self, other: Pipeline, kind: str, on: Expr | None) -> Pipeline:
        if kind == "cross" and on is not None:
            raise ExactError("PIPELINE-PLAN-007", "a cross join pairs everything and has no condition")
        if kind != "cross" and (on is None or on.type.kind != "truth"):
            raise ExactError("PIPELINE-PLAN-006", "this join needs a condition that is a truth value")
        return Pipeline("join", (self, other), (kind, on))

    def join(self, other: Pipeline, on: Expr) -> Pipeline:
        return self._join(other, "inner", on)

    def left_join(self, other: Pipeline, on: Expr) -> Pipeline:
        return self._join(other, "left", on)

    def right_join(self, other: Pipeline, on: Expr) -> Pipeline:
        return self._join(other, "right", on)

    def full_join(self, other: Pipeline, on: Expr) -> Pipeline:
        return self._join(other, "full", on)

    def cross_join(self, other: Pipeline) -> Pipeline:
        return self._join(other, "cross", None)

    def union(self, other: Pipeline) -> Pipeline:
        return Pipeline("set", (self, other), ("union",))

    def union_all(self, other: Pipeline) -> Pipeline:
        return Pipeline("set", (self, other), ("union_all",))

    def intersect(self, other: Pipeline) -> Pipeline:
        return Pipeline("set", (self, other), ("intersect",))

    def except_(self, other: Pipeline) -> Pipeline:
        return Pipeline("set", (self, other), ("except",))

    def window(self, w: Window) -> Pipeline:
        return self._then("window", w)

    def unnest(self) -> Pipeline:
        return self._then("unnest", False)

    def unnest_present(self) -> Pipeline:
        return self._then("unnest", True)

    def exists(self) -> Expr:
        return exists(self)

    def not_exists(self) -> Expr:
        return exists(self, True)

    def condition(self) -> Expr:
        """Of a filter: all its conditions as one."""
        return conjunction(list(self.data))


@dataclass(frozen=True)
class Selected:
    """A scalar (no names), a tuple (_1, _2, ...) or a record (names, sorted), of expressions or aggregates."""

    parts: tuple[Any, ...]
    names: tuple[str, ...]
    kind: str

    @property
    def type(self) -> Type:
        types = [p.type for p in self.parts]
        if self.kind == "scalar":
            return types[0]
        return t.tuple_of(*types) if self.kind == "tuple" else Type("record", tuple(types), self.names)


def _selected(what: Any) -> Selected:
    if isinstance(what, Mapping):
        names = tuple(sorted(what))
        if not names or any(not n for n in names):
            raise ExactError("PIPELINE-PROJECT-001", "a record projection needs named expressions")
        return Selected(tuple(what[n] for n in names), names, "record")
    if isinstance(what, tuple):
        if not 1 <= len(what) <= MAX_TUPLE:
            raise ExactError("TYPE-003", f"a tuple has from 1 to {MAX_TUPLE} elements")
        return Selected(what, tuple(f"_{k + 1}" for k in range(len(what))), "tuple")
    return Selected((what,), ("value",), "scalar")


def selection(what: Selection) -> Selected:
    return _selected(what)


def aggregates(what: Any) -> Selected:
    s = _selected(what)
    for a in s.parts:
        a.check()
    return s


def record(*pairs: tuple[str, Expr]) -> dict[str, Expr]:
    """A named record; a name given twice is an error."""
    if len({n for n, _ in pairs}) < len(pairs):
        raise ExactError("PIPELINE-PROJECT-002", "a record names each of its fields once")
    return dict(pairs)
