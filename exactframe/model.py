"""Models: immutable schemas with identity, unique fields, references and relations."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Literal

from pyspark.sql import types as T

from .errors import ExactError
from .expr import Expr, field_node
from .types import Presence, Type, consistent

#: Limits on one model.
MAX_FIELDS, MAX_RELATIONS, MAX_CONSTRAINTS, MAX_KEY = 1024, 256, 256, 512


@dataclass(frozen=True)
class FieldDef:
    key: str
    name: str
    type: Type
    presence: Presence = "required"

    @property
    def optional(self) -> bool:
        return self.presence == "optional"


@dataclass(frozen=True)
class Reference:
    """Integrity: every tuple without nulls has a row of the target."""

    target: str
    source_fields: tuple[str, ...]
    target_fields: tuple[str, ...]


@dataclass(frozen=True)
class Relation:
    """Navigation only; it never joins by itself."""

    key: str
    name: str
    target: str
    cardinality: Literal["one", "optional_one", "many"]
    mapping: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Model:
    key: str
    name: str
    fields: tuple[FieldDef, ...]
    identity: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    relations: tuple[Relation, ...] = ()
    _by_key: dict[str, FieldDef] = field(default_factory=dict, compare=False, repr=False, hash=False)

    def __hash__(self) -> int:
        return hash((self.key, self.fields))

    def __post_init__(self) -> None:
        self._by_key.update({f.key: f for f in self.fields})

    def field(self, key: str) -> FieldDef:
        if key not in self._by_key:
            raise ExactError("RUNTIME-101", f"there is no field {key}")
        return self._by_key[key]

    def has(self, key: str) -> bool:
        return key in self._by_key

    def __getitem__(self, key: str) -> Expr:
        """The field as an expression; ``.at(alias)`` binds it to one occurrence of the model."""
        return field_node(self, self.field(key))

    def get(self, key: str, ty: Type) -> Expr:
        f = self.field(key)
        if not f.type.same(ty):
            raise ExactError("RUNTIME-102", f"{key} holds {f.type.name}, not {ty.name}")
        return self[key]

    def same(self, other: Model) -> bool:
        bare = lambda m: (m.key, m.name, tuple((f.key, f.name, f.type.bare(), f.presence) for f in m.fields), m.identity, m.uniques, m.references, m.relations)
        return bare(self) == bare(other)

    def schema(self) -> T.StructType:
        """Columns by name; an optional field has a companion that says whether it is present."""
        out = []
        for f in self.fields:
            out.append(T.StructField(f.name, f.type.spark(), f.type.null or f.optional, {"key": f.key}))
            if f.optional:
                out.append(T.StructField(present(f.name), T.BooleanType(), False))
        return T.StructType(out)


def present(name: str) -> str:
    return f"{name}__present"


class ModelBuilder:
    """Collects a definition; ``freeze`` checks it as a whole."""

    def __init__(self, key: str, name: str | None = None):
        self.key, self.name = key, name if name is not None else key.rpartition("/")[2]
        self._fields: list[FieldDef] = []
        self._identity: tuple[str, ...] | None = None
        self._uniques: list[tuple[str, ...]] = []
        self._references: list[Reference] = []
        self._relations: list[Relation] = []

    def field(self, key: str, ty: Type, name: str | None = None) -> ModelBuilder:
        self._fields.append(FieldDef(key, name if name is not None else key, ty))
        return self

    def optional_field(self, key: str, ty: Type, name: str | None = None) -> ModelBuilder:
        self._fields.append(FieldDef(key, name if name is not None else key, ty, "optional"))
        return self

    def identity(self, *keys: str) -> ModelBuilder:
        if self._identity is not None:
            raise ExactError("CONSTRAINT-008", "a model has one identity")
        self._identity = keys
        return self

    def unique(self, *keys: str) -> ModelBuilder:
        self._uniques.append(keys)
        return self

    def reference(self, target: str, source: tuple[str, ...], to: tuple[str, ...]) -> ModelBuilder:
        self._references.append(Reference(target, tuple(source), tuple(to)))
        return self

    def relation(self, key: str, target: str, cardinality: str, mapping: tuple[tuple[str, str], ...], name: str | None = None) -> ModelBuilder:
        self._relations.append(Relation(key, name or key, target, cardinality, tuple(mapping)))  # type: ignore[arg-type]
        return self

    def freeze(self) -> Model:
        _text("MODEL-001", self.key, "model key")
        _text("MODEL-002", self.name, "model name")
        for count, most, code, what in ((self._fields, MAX_FIELDS, "LIMIT-001", "field"), (self._relations, MAX_RELATIONS, "LIMIT-002", "relation"), (self._uniques + self._references, MAX_CONSTRAINTS, "LIMIT-003", "constraint")):
            if len(count) > most:
                raise ExactError(code, f"model exceeds {what} limit {most}")
        known: dict[str, FieldDef] = {}
        names = set()
        for f in self._fields:
            _text("FIELD-001", f.key, "field key")
            _text("FIELD-002", f.name, "field name")
            if f.key in known:
                raise ExactError("FIELD-003", f"two fields have the key {f.key}")
            if f.name in names:
                raise ExactError("FIELD-004", f"two fields are called {f.name}")
            known[f.key] = f
            names.add(f.name)
            f.type.validate()
        consistent([f.type for f in self._fields])
        if self._identity is not None:
            self._tuple(known, self._identity, "identity")
            for k in self._identity:
                f = known[k]
                if f.optional or f.type.null:
                    raise ExactError("CONSTRAINT-002", f"{k} may lack a value, so it cannot identify rows")
                if not (f.type.has("equality") and f.type.has("keyable")):
                    raise ExactError("CONSTRAINT-006", f"values of {k} cannot be told apart, so it cannot identify rows")
        for u in self._uniques:
            self._tuple(known, u, "unique")
            for k in u:
                if not (known[k].type.has("equality") and known[k].type.has("keyable")):
                    raise ExactError("CONSTRAINT-007", f"values of {k} cannot be told apart, so they cannot be unique")
        for r in self._references:
            if not r.source_fields or len(r.source_fields) != len(r.target_fields):
                raise ExactError("CONSTRAINT-004", "a reference pairs each of its fields with one of the target")
            _text("CONSTRAINT-010", r.target, "reference target model key")
            self._tuple(known, r.source_fields, "reference")
            for k in r.target_fields:
                _text("CONSTRAINT-011", k, "reference target field key")
            if len(set(r.target_fields)) < len(r.target_fields):
                raise ExactError("CONSTRAINT-009", "a reference leads to one field twice")
        keys, rel_names = set(), set()
        for r in self._relations:
            _text("RELATION-003", r.key, "relation key")
            _text("RELATION-004", r.name, "relation name")
            _text("RELATION-008", r.target, "relation target model key")
            if r.key in keys:
                raise ExactError("RELATION-005", f"two relations have the key {r.key}")
            if r.name in rel_names:
                raise ExactError("RELATION-006", f"two relations are called {r.name}")
            keys.add(r.key)
            rel_names.add(r.name)
            if not r.mapping:
                raise ExactError("RELATION-001", "a relation needs a field to go by")
            for s, t in r.mapping:
                if s not in known:
                    raise ExactError("RELATION-002", f"unknown source field {s}")
                _text("RELATION-009", t, "relation target field key")
            if any(len({m[k] for m in r.mapping}) < len(r.mapping) for k in (0, 1)):
                raise ExactError("RELATION-007", "a relation uses each field once on its side")
        return Model(self.key, self.name, tuple(self._fields), self._identity or (), tuple(self._uniques), tuple(self._references), tuple(self._relations))

    @staticmethod
    def _tuple(known: dict[str, FieldDef], keys: tuple[str, ...], what: str) -> None:
        if not keys:
            raise ExactError("CONSTRAINT-001", f"{what}: no field is named")
        for k in keys:
            if k not in known:
                raise ExactError("CONSTRAINT-003", f"{what}: there is no field {k}")
        if len(set(keys)) < len(keys):
            raise ExactError("CONSTRAINT-005", f"{what} repeats a field")


def _text(code: str, text: str, what: str) -> None:
    if not text or len(text.encode()) > MAX_KEY:
        raise ExactError(code, f"{what} must have 1 to {MAX_KEY} bytes")


class ModelSet:
    """Models whose relations and references all resolve."""

    def __init__(self, *models: Model):
        self.models: dict[str, Model] = {}
        for m in models:
            if m.key in self.models:
                raise ExactError("MODELSET-001", f"two models have the key {m.key}")
            self.models[m.key] = m
        consistent([f.type for m in models for f in m.fields])
        for m in models:
            for r in m.relations:
                target = self._target(r.target, "RELATION-101", "relation")
                for s, t in r.mapping:
                    if not target.has(t):
                        raise ExactError("RELATION-103", f"{r.key} leads to {t}, a field that is not there")
                    if not m.field(s).type.non_null().same(target.field(t).type.non_null()):
                        raise ExactError("RELATION-104", f"{r.key} pairs fields of different types")
                if r.cardinality != "many" and not _is_key(target, tuple(t for _, t in r.mapping)):
                    raise ExactError("RELATION-105", f"{r.key} leads to one row, so its target must identify rows")
            for ref in m.references:
                target = self._target(ref.target, "CONSTRAINT-101", "reference")
                for s, t in zip(ref.source_fields, ref.target_fields, strict=True):
                    if not target.has(t):
                        raise ExactError("CONSTRAINT-103", f"the reference leads to {t}, a field that is not there")
                    if not m.field(s).type.non_null().same(target.field(t).type.non_null()):
                        raise ExactError("CONSTRAINT-104", "a reference pairs fields of one type")
                if not _is_key(target, ref.target_fields):
                    raise ExactError("CONSTRAINT-105", "a reference must lead to fields that identify rows")

    def _target(self, key: str, code: str, what: str) -> Model:
        if key not in self.models:
            raise ExactError(code, f"{what} targets unknown model {key}")
        return self.models[key]

    def __getitem__(self, key: str) -> Model:
        return self.models[key]

    def __iter__(self):
        return iter(sorted(self.models.values(), key=lambda m: m.key))


def _is_key(model: Model, fields: tuple[str, ...]) -> bool:
    return set(fields) in [set(model.identity), *map(set, model.uniques)]


def row(model: Model, values: dict[str, Any]) -> tuple:
    """A dict by field key as a tuple for ``model.schema()``; absent optional fields are missing."""
    from .values import MISSING, check

    if unknown := set(values) - {f.key for f in model.fields}:
        raise ExactError("RUNTIME-001", f"unknown field {sorted(unknown)[0]}")
    out: list[Any] = []
    for f in model.fields:
        v = check(values.get(f.key, MISSING), f.type, f.presence)
        out.append(None if v is MISSING else v)
        if f.optional:
            out.append(v is not MISSING)
    return tuple(out)
