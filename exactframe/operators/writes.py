"""Writes: described first, applied to a table as a whole or not at all."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from ..errors import ExactError
from ..expr import Expr
from ..model import Model


@dataclass(frozen=True, eq=False)
class Insert:
    model: Model
    rows: tuple[dict[str, Any], ...]
    batch_rows_hint: int | None = None

    def batch_rows(self, n: int) -> Insert:
        """A hint; it changes nothing about the result."""
        if n <= 0:
            raise ExactError("WRITE-BATCH-001", "a batch has at least one row")
        return replace(self, batch_rows_hint=n)


def insert(model: Model, row: dict[str, Any]) -> Insert:
    return Insert(model, (row,))


def insert_many(model: Model, rows: list[dict[str, Any]]) -> Insert:
    return Insert(model, tuple(rows))


@dataclass(frozen=True, eq=False)
class _Unscoped:
    """An update or delete that does not say which rows: it cannot be applied."""

    model: Model
    assignments: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True, eq=False)
class Update:
    model: Model
    assignments: tuple[tuple[str, Expr], ...]
    condition: Expr | None

    def __post_init__(self) -> None:
        if not self.assignments:
            raise ExactError("WRITE-UPDATE-001", "an update changes at least one field")

    def set(self, target: Expr, value: Any) -> Update:
        return replace(self, assignments=_assigned(self, target, value))

    def all(self) -> Update:
        if self.condition is not None:
            raise ExactError("WRITE-SCOPE-001", "all() and filter() exclude each other")
        return self


@dataclass(frozen=True, eq=False)
class Delete:
    model: Model
    condition: Expr | None


class UnscopedUpdate(_Unscoped):
    def set(self, target: Expr, value: Any) -> UnscopedUpdate:
        return UnscopedUpdate(self.model, _assigned(self, target, value))

    def filter(self, condition: Expr) -> Update:
        return Update(self.model, self.assignments, _write_filter(condition))

    def all(self) -> Update:
        return Update(self.model, self.assignments, None)


class UnscopedDelete(_Unscoped):
    def filter(self, condition: Expr) -> Delete:
        return Delete(self.model, _write_filter(condition))

    def all(self) -> Delete:
        return Delete(self.model, None)


def update(model: Model) -> UnscopedUpdate:
    return UnscopedUpdate(model)


def delete(model: Model) -> UnscopedDelete:
    return UnscopedDelete(model)


def _write_filter(e: Expr) -> Expr:
    if e.type.kind != "truth":
        raise ExactError("MEMORY-WRITE-004", "a write's filter is a truth value")
    todo = [e]
    while todo:
        x = todo.pop()
        if x.op == "exists":
            raise ExactError("MEMORY-WRITE-003", "a write's filter looks at the row alone: no exists() in it")
        todo += x.args
    return e


def _assigned(w: Any, target: Expr, value: Any) -> tuple[tuple[str, Expr], ...]:
    model: Model = w.model
    if target.op != "field" or target.data[0].key != model.key:
        raise ExactError("WRITE-UPDATE-003", f"an assignment's target must be a field of model {model.key}")
    key = target.data[1]
    if not model.has(key):
        raise ExactError("WRITE-UPDATE-004", f"{model.key} has no field {key}")
    if any(k == key for k, _ in w.assignments):
        raise ExactError("WRITE-UPDATE-002", f"{key} is set twice")
    f = model.field(key)
    value = value if isinstance(value, Expr) else f_lit(value, f.type)
    if not (value.type.same(f.type) or (f.type.null and value.type.nullable().same(f.type))):
        raise ExactError("WRITE-UPDATE-005", f"the value set for {key} is of another type")
    return (*w.assignments, (key, value))


def f_lit(value: Any, ty: Any) -> Expr:
    from ..expr import lit

    return lit(value, ty)
