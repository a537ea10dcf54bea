"""Catalog migration: a diff in a fixed order, risks by operation, approvals bound to one plan, and a guarded apply."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from .errors import ExactError


@dataclass(frozen=True)
class CatalogField:
    key: str
    name: str
    type: str
    required: bool = True


@dataclass(frozen=True)
class CatalogIndex:
    key: str
    name: str
    fields: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Entity:
    key: str
    name: str
    fields: tuple[CatalogField, ...] = ()
    indexes: tuple[CatalogIndex, ...] = ()


@dataclass(frozen=True)
class Snapshot:
    """``scope``: what the catalog covers. ``revision``: the backend's token for this state."""

    scope: str
    revision: str
    entities: tuple[Entity, ...] = ()

    def by_key(self) -> dict[str, Entity]:
        out = {e.key: e for e in self.entities}
        if len(out) < len(self.entities):
            raise ExactError("MIGRATE-CATALOG-001", "a catalog names each entity once")
        return out

    def content(self) -> Any:
        return sorted((e.key, e.name, sorted(repr(f) for f in e.fields), sorted(repr(i) for i in e.indexes)) for e in self.entities)


@dataclass(frozen=True)
class Operation:
    """``kind``: create_entity, drop_entity, rename_entity, add_field, drop_field, alter_field, rename_field, create_index, drop_index, rename_index."""

    kind: str
    entity: str
    key: str = ""
    detail: Any = None

    def summary(self) -> str:
        return " ".join(x for x in (self.kind, self.entity, self.key) if x)


#: (kind, parent entity key or "", key, old name, new name): names change by these declarations alone.
Rename = tuple[str, str, str, str, str]
#: The order of operations in a plan.
ORDER = ("rename_entity", "create_entity", "drop_index", "rename_field", "add_field", "alter_field", "drop_field", "rename_index", "create_index", "drop_entity")
MAX_OPERATIONS = 16_384


def diff(source: Snapshot, target: Snapshot, renames: tuple[Rename, ...] = ()) -> list[Operation]:
    if source.scope != target.scope:
        raise ExactError("MIGRATE-DIFF-002", "the two catalogs are not of one scope")
    told, used = set(renames), set()
    if len(told) < len(renames):
        raise ExactError("MIGRATE-DIFF-003", "a rename is declared twice")
    a, b = source.by_key(), target.by_key()
    out: list[Operation] = []

    def renamed(kind: str, parent: str, key: str, old: str, new: str) -> None:
        if old == new:
            return
        intent = (kind, parent, key, old, new)
        if intent not in told:
            raise ExactError("MIGRATE-DIFF-004", f"{kind} {key} changes its name from {old} to {new} without a declared intent")
        used.add(intent)
        out.append(Operation(f"rename_{kind}", parent or key, key if parent else "", (old, new)))

    for key in sorted(a.keys() | b.keys()):
        if key not in b:
            out.append(Operation("drop_entity", key))
        elif key not in a:
            out.append(Operation("create_entity", key, detail=b[key]))
        else:
            x, y = a[key], b[key]
            renamed("entity", "", key, x.name, y.name)
            for what, xs, ys in (("field", x.fields, y.fields), ("index", x.indexes, y.indexes)):
                old, new = {i.key: i for i in xs}, {i.key: i for i in ys}
                for k in sorted(old.keys() | new.keys()):
                    if k not in new:
                        out.append(Operation(f"drop_{what}", key, k))
                    elif k not in old:
                        out.append(Operation("add_field" if what == "field" else "create_index", key, k, new[k]))
                    else:
                        renamed(what, key, k, old[k].name, new[k].name)
                        if what == "field" and (old[k].type, old[k].required) != (new[k].type, new[k].required):
                            out.append(Operation("alter_field", key, k, new[k]))
                        elif what == "index" and (old[k].fields, old[k].unique) != (new[k].fields, new[k].unique):
                            out += [Operation("drop_index", key, k), Operation("create_index", key, k, new[k])]
    if told - used:
        raise ExactError("MIGRATE-DIFF-005", "a declared rename has nothing to rename")
    if len(out) > MAX_OPERATIONS:
        raise ExactError("MIGRATE-DIFF-006", "the catalogs differ in more places than allowed")
    return sorted(out, key=lambda o: (ORDER.index(o.kind), o.entity, o.key))


@dataclass(frozen=True)
class Risk:
    """Three axes: what happens to data, to operation, and who may run it."""

    data: str
    operation: str
    automation: str


def risk(o: Operation) -> Risk:
    if o.kind == "create_entity":
        return Risk("safe", "locking", "automatic")
    if o.kind in ("drop_entity", "drop_field"):
        return Risk("destructive", "locking", "approval")
    if o.kind.startswith("rename"):
        return Risk("safe", "metadata", "approval")
    if o.kind == "add_field" and not o.detail.required:
        return Risk("safe", "metadata", "automatic")
    if o.kind in ("add_field", "alter_field"):
        return Risk("rewrite", "rewrite", "approval")
    return Risk("safe", "rebuild" if o.kind == "create_index" else "locking", "approval")


@dataclass(frozen=True)
class Plan:
    source: Snapshot
    target: Snapshot
    steps: tuple[Operation, ...]

    @property
    def identity(self) -> str:
        return hashlib.blake2b(repr((self.source, self.target, self.steps)).encode(), digest_size=32).hexdigest()


def plan(source: Snapshot, target: Snapshot, renames: tuple[Rename, ...] = ()) -> Plan:
    return Plan(source, target, tuple(diff(source, target, renames)))


@dataclass(frozen=True)
class Approval:
    plan: str
    steps: frozenset[int]


def approve(p: Plan, *steps: int) -> Approval:
    return Approval(p.identity, frozenset(steps))


@dataclass(frozen=True)
class MigrationPolicy:
    """Conservative unless told otherwise."""

    rewrite: bool = False
    destructive: bool = False
    locking: bool = True
    rebuild: bool = False

    def authorize(self, p: Plan, approval: Approval | None = None) -> None:
        if approval is not None and approval.plan != p.identity:
            raise ExactError("MIGRATE-POLICY-001", "the approval was given for another plan")
        for k, o in enumerate(p.steps):
            r = risk(o)
            no = None
            if r.data == "rewrite" and not (self.rewrite or self.destructive):
                no = "data rewrite is not allowed"
            elif r.data == "destructive" and not self.destructive:
                no = "destructive changes are not allowed"
            elif r.operation == "locking" and not self.locking:
                no = "locking operations are not allowed"
            elif r.operation == "rebuild" and not self.rebuild:
                no = "external rebuilds are not allowed"
            elif r.automation == "approval" and (approval is None or k not in approval.steps):
                no = "explicit approval is required"
            if no:
                raise ExactError("MIGRATE-POLICY-002", f"step {k}: {no}")


class Backend(Protocol):
    def inspect(self, scope: str) -> Snapshot: ...
    def begin(self, p: Plan) -> None: ...
    def apply_step(self, o: Operation) -> None: ...
    def finish(self, commit: bool) -> None: ...


def apply(backend: Backend, p: Plan, policy: MigrationPolicy = MigrationPolicy(), approval: Approval | None = None, max_steps: int = 1024) -> list[str]:
    """Runs the plan between begin and commit; any failure aborts. Gives the summaries of the steps."""
    if len(p.steps) > max_steps:
        raise ExactError("MIGRATE-APPLY-002", f"the plan has {len(p.steps)} steps; {max_steps} may be applied")
    policy.authorize(p, approval)
    backend.begin(p)
    try:
        done = _locked(backend, p)
    except Exception as primary:
        try:
            backend.finish(False)
        except Exception as cleanup:
            raise ExactError("MIGRATE-APPLY-003", f"a step failed ({primary}) and so did going back ({cleanup}): look at the target before anything else") from primary
        raise
    backend.finish(True)
    return done


def _locked(backend: Backend, p: Plan) -> list[str]:
    seen = backend.inspect(p.source.scope)
    if seen.revision != p.source.revision:
        raise ExactError("MIGRATE-APPLY-STALE", f"the plan starts from revision {p.source.revision}, the target is at {seen.revision}")
    if seen.content() != p.source.content():
        raise ExactError("MIGRATE-APPLY-004", "the revision is the plan's but the contents are not")
    done: list[str] = []
    for k, o in enumerate(p.steps):
        try:
            backend.apply_step(o)
        except Exception as e:
            raise ExactError("MIGRATE-APPLY-005", f"step {k} failed, {len(done)} before it were done: {e}") from e
        done.append(o.summary())
    end = backend.inspect(p.target.scope)
    if end.revision != p.target.revision:
        raise ExactError("MIGRATE-APPLY-006", f"the target ended at revision {end.revision}, not {p.target.revision}")
    if end.content() != p.target.content():
        raise ExactError("MIGRATE-APPLY-007", "the target is not what the plan describes")
    return done


@dataclass
class TableBackend:
    """Runs steps as DDL through ``run`` (``spark.sql`` for tables whose format allows it) and keeps the catalog it describes."""

    state: Snapshot
    run: Callable[[str], Any] = lambda sql: None
    _saved: Snapshot | None = field(default=None, repr=False)
    _target: str = ""

    def inspect(self, scope: str) -> Snapshot:
        return self.state

    def begin(self, p: Plan) -> None:
        self._saved, self._target = self.state, p.target.revision
        self._steps = len(p.steps)

    def apply_step(self, o: Operation) -> None:
        entities = self.state.by_key()
        e = entities.get(o.entity)
        if o.kind == "create_entity":
            cols = ", ".join(f"`{f.name}` {f.type}" for f in o.detail.fields)
            self.run(f"CREATE TABLE `{o.detail.name}` ({cols})")
            entities[o.entity] = o.detail
        elif o.kind == "drop_entity":
            self.run(f"DROP TABLE `{e.name}`")
            del entities[o.entity]
        elif o.kind == "rename_entity":
            self.run(f"ALTER TABLE `{o.detail[0]}` RENAME TO `{o.detail[1]}`")
            entities[o.entity] = Entity(e.key, o.detail[1], e.fields, e.indexes)
        else:
            fields, indexes = {f.key: f for f in e.fields}, {i.key: i for i in e.indexes}
            if o.kind == "add_field":
                self.run(f"ALTER TABLE `{e.name}` ADD COLUMNS (`{o.detail.name}` {o.detail.type})")
                fields[o.key] = o.detail
            elif o.kind == "alter_field":
                self.run(f"ALTER TABLE `{e.name}` ALTER COLUMN `{o.detail.name}` TYPE {o.detail.type}")
                fields[o.key] = o.detail
            elif o.kind == "drop_field":
                self.run(f"ALTER TABLE `{e.name}` DROP COLUMN `{fields.pop(o.key).name}`")
            elif o.kind == "rename_field":
                self.run(f"ALTER TABLE `{e.name}` RENAME COLUMN `{o.detail[0]}` TO `{o.detail[1]}`")
                f = fields[o.key]
                fields[o.key] = CatalogField(f.key, o.detail[1], f.type, f.required)
            elif o.kind == "drop_index":
                indexes.pop(o.key)  # Spark tables have no indexes to drop
            elif o.kind == "rename_index":
                i = indexes[o.key]
                indexes[o.key] = CatalogIndex(i.key, o.detail[1], i.fields, i.unique)
            else:
                indexes[o.key] = o.detail
            entities[o.entity] = Entity(e.key, e.name, tuple(fields.values()), tuple(indexes.values()))
        self._steps -= 1
        self.state = Snapshot(self.state.scope, self._target if self._steps == 0 else f"{self.state.revision}+", tuple(entities.values()))

    def finish(self, commit: bool) -> None:
        if not commit and self._saved is not None:
            self.state = self._saved
        self._saved = None
