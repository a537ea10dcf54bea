"""Pipelines to Spark data frames: checks what Spark would let pass, then leaves all planning to Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import ExactError
from ..expr import MAX_EXPR_NODES, Expr
from ..model import Model, present
from ..types import Type
from .lower import Context, Lowered, condition, lower
from .pipeline import Pipeline, Selected, Window

MAX_PLAN_NODES = 16_384


@dataclass(frozen=True)
class Scope:
    """One occurrence of a model; its columns are called ``prefix`` + field name."""

    model: Model
    alias: str | None
    prefix: str
    nullable: bool = False
    unique: bool = True


@dataclass(frozen=True)
class Out:
    """What a row is: a model, a value in ``columns``, a product of two, or one that can be absent (flag in ``matched``)."""

    kind: str
    scope: Scope | None = None
    type: Type | None = None
    columns: tuple[str, ...] = ()
    parts: tuple[Out, ...] = ()
    matched: str = ""

    def all_columns(self) -> list[str]:
        if self.kind == "model":
            assert self.scope
            return [self.scope.prefix + f.name for f in self.scope.model.schema().fields]
        if self.kind == "value":
            return list(self.columns)
        return [c for p in self.parts for c in p.all_columns()] + ([self.matched] if self.matched else [])

    def types(self) -> list[tuple[str, Type]]:
        """(column, type) of what is compared."""
        if self.kind == "model":
            assert self.scope
            return [(self.scope.prefix + f.name, f.type) for f in self.scope.model.fields]
        if self.kind == "value":
            assert self.type
            return list(zip(self.columns, leaves(self.type), strict=True))
        return [x for p in self.parts for x in p.types()]

    def same(self, other: Out) -> bool:
        if self.kind != other.kind:
            return False
        if self.kind == "model":
            return self.scope.model.same(other.scope.model)  # type: ignore[union-attr]
        if self.kind == "value":
            return self.type.same(other.type)  # type: ignore[union-attr,arg-type]
        return len(self.parts) == len(other.parts) and all(a.same(b) for a, b in zip(self.parts, other.parts, strict=True))


def leaves(ty: Type) -> list[Type]:
    """The columns of a value: a tuple's or record's parts, and those of its parts that are tuples or records made by a selection."""
    return [x for p in ty.parts for x in (leaves(p) if p.kind in ("tuple", "record") else [p])] if ty.kind in ("tuple", "record") else [ty]


@dataclass(frozen=True)
class Compiled:
    df: DataFrame
    scopes: tuple[Scope, ...]
    out: Out
    #: How the rows are to be sorted; ``df`` is not sorted yet, so that filters written later still reach the source.
    order: tuple[Column, ...] = ()


@dataclass
class Compiler:
    """``table``: the data frame of a model, in ``model.schema()``."""

    table: Callable[[Model], DataFrame]
    parameters: dict[str, Any] = field(default_factory=dict)
    count: int = 0
    nodes: int = 0
    expressions: int = 0
    made: dict[int, Compiled] = field(default_factory=dict)
    types: dict[str, Type] = field(default_factory=dict)
    functions: dict[tuple[str, int], Any] = field(default_factory=dict)

    def run(self, p: Pipeline, outer: tuple[Scope, ...] = ()) -> Compiled:
        """Walks without recursion, so that long chains are no problem."""
        todo = [(p, False)]
        own: dict[int, Compiled] = {} if outer else self.made
        while todo:
            node, ready = todo.pop()
            if id(node) in own:
                continue
            if not ready:
                todo.append((node, True))
                todo += [(i, False) for i in reversed(node.inputs)]
                continue
            self.nodes += 1
            if self.nodes > MAX_PLAN_NODES:
                raise ExactError("PIPELINE-LIMIT-002", f"a pipeline has at most {MAX_PLAN_NODES} steps")
            own[id(node)] = getattr(self, f"_{node.op}")(node, *(own[id(i)] for i in node.inputs), outer=outer)
        return own[id(p)]

    def result(self, p: Pipeline) -> DataFrame:
        done = _settled(self.run(p))
        taken: dict[str, int] = {}
        cols = []
        for a, b in self._names(done.out, ""):
            taken[b] = taken.get(b, 0) + 1
            cols.append(F.col(a).alias(b if taken[b] == 1 else f"{b}_{taken[b]}"))
        return done.df.select(*cols)

    def _names(self, out: Out, prefix: str) -> list[tuple[str, str]]:
        if out.kind == "model":
            assert out.scope
            lead = f"{out.scope.alias or out.scope.model.name}." if prefix else ""
            return [(c, lead + c[len(out.scope.prefix) :]) for c in out.all_columns()]
        if out.kind == "value":
            return [(c, c.split("!")[0]) for c in out.columns]
        names = [x for p in out.parts for x in self._names(p, "product")]
        if out.matched:
            side = next((s.alias or s.model.name for s in self._scopes(out)), out.matched)
            names.append((out.matched, f"{side}.matched"))
        return names

    def _scopes(self, out: Out) -> list[Scope]:
        return [out.scope] if out.scope else [s for p in out.parts for s in self._scopes(p)]

    # --- expressions ---------------------------------------------------------
    def _find(self, scopes: tuple[Scope, ...], model: Model, key: str, alias: str | None) -> Scope | None:
        same = [s for s in scopes if s.model.key == model.key]
        found = [s for s in same if alias is None or s.alias == alias]
        if len(found) > 1:
            raise ExactError("EXPR-SCOPE-002", f"{model.key} is here several times; say which one is meant by at(alias)")
        return found[0] if found else None

    def _context(self, scopes: tuple[Scope, ...], outer: tuple[Scope, ...], filters: bool) -> Context:
        def column(model: Model, key: str, alias: str | None) -> Lowered:
            s = self._find(scopes, model, key, alias)
            outside = s is None
            if s is None and filters:
                s = self._find(outer, model, key, alias)
            if s is None:
                if alias is not None and any(x.model.key == model.key for x in scopes):
                    raise ExactError("EXPR-SCOPE-005", f"no source of {model.key} is called {alias} here")
                raise ExactError("EXPR-SCOPE-001", f"no field of {model.key} can be seen here")
            if not s.model.has(key):
                raise ExactError("EXPR-SCOPE-003", f"{model.key} has no field {key}")
            f = s.model.field(key)
            if not f.type.same(model.field(key).type):
                raise ExactError("EXPR-TYPE-002", f"{key} is of another type where it comes from")
            at = lambda n: F.col(s.prefix + n).outer() if outside else F.col(s.prefix + n)
            return Lowered(at(f.name), ~F.coalesce(at(present(f.name)), F.lit(True)) if f.optional else None)

        sub = (lambda p: self.run(p, outer=(*scopes, *outer)).df) if filters else None
        return Context(column, self.parameters, sub)

    def _check(self, e: Expr, scopes: tuple[Scope, ...], outer: tuple[Scope, ...], filters: bool) -> None:
        self.expressions += e.nodes
        if self.expressions > MAX_EXPR_NODES:
            raise ExactError("ENGINE-LIMIT-002", f"the expressions of a plan have at most {MAX_EXPR_NODES} parts in all")
        todo = [(e, False)]
        while todo:
            x, lifted = todo.pop()
            if x.op == "field":
                s = self._find(scopes, *x.data) or (self._find(outer, *x.data) if filters else None)
                if s is not None and s.nullable and not lifted and not x.type.null:
                    raise ExactError("EXPR-SCOPE-006", f"an outer join may leave {x.data[1]} without a value; write .nullable()")
            elif x.op == "exists" and not filters:
                raise ExactError("EXPR-EXISTS-001", "exists() belongs in a filter")
            elif x.op == "param":
                if not self.types.setdefault(x.data[0], x.type).same(x.type):
                    raise ExactError("EXPR-PARAM-003", f"the parameter {x.data[0]} has two types in this plan")
            elif x.op == "custom":
                f = x.data[0]
                if self.functions.setdefault((f.key, f.version), f) != f:
                    raise ExactError("EXPR-FUNC-004", f"two functions go by {f.key} version {f.version}")
            # whether a value is there may be asked of the optional side without a lift
            todo += [(a, x.op in ("nullable", "is_null", "is_missing", "is_present")) for a in x.args]

    def _lower(self, e: Expr, c: Compiled) -> Lowered:
        self._check(e, c.scopes, (), False)
        return lower(e, self._context(c.scopes, (), False))

    def _required(self, e: Expr, c: Compiled) -> Column:
        """A projected value: missing is an error, as there is no place for it."""
        got = self._lower(e, c)
        if got.missing is None:
            return got.value
        return F.when(got.missing, F.raise_error(F.lit("RUNTIME-002: a value that must be there is missing")).cast(e.type.spark())).otherwise(got.value)

    # --- nodes ---------------------------------------------------------------
    def _source(self, node: Pipeline, outer: tuple[Scope, ...]) -> Compiled:
        model, alias = node.data
        self.count += 1
        scope = Scope(model, alias, f"s{self.count}!")
        df = self.table(model)
        return Compiled(df.select(*(F.col(f"`{f.name}`").alias(scope.prefix + f.name) for f in model.schema().fields)), (scope,), Out("model", scope))

    def _filter(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        e = node.condition()
        self._check(e, c.scopes, outer, True)
        return replace(c, df=c.df.filter(condition(e, self._context(c.scopes, outer, True))))

    def _columns(self, s: Selected, c: Compiled, lead: str = "") -> list[Column]:
        return [self._required(e, c).alias(lead + n) for e, n in zip(s.parts, s.names, strict=True)]

    def _project(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        s: Selected = node.data[0]
        df = _settled(c).df.select(*self._columns(s, c))
        return Compiled(df, (), Out("value", type=s.type, columns=s.names))

    def _aggregate(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        keys, aggs = node.data
        for a in aggs.parts:
            if a.input is not None:
                self._check(a.input, c.scopes, (), False)
        own = self._context(c.scopes, (), False)
        made = [self._aggregated(a, None if a.input is None else lower(a.input, own)) for a in aggs.parts]
        names = aggs.names if aggs.kind == "record" else tuple(f"_2_{k + 1}" for k in range(len(made))) if keys is not None and aggs.kind == "tuple" else ("_2",) if keys is not None else aggs.names
        if keys is None:
            return Compiled(c.df.agg(*(m.alias(n) for m, n in zip(made, names, strict=True))), (), Out("value", type=aggs.type, columns=names))
        for k in keys.parts:
            if not k.type.has("keyable"):
                raise ExactError("PIPELINE-GROUP-001", f"rows cannot be grouped by {k.type.name}")
        lead = keys.names if keys.kind == "record" else tuple(f"_1_{k + 1}" for k in range(len(keys.parts))) if keys.kind == "tuple" else ("_1",)
        cols = [self._required(e, c).alias(n) for e, n in zip(keys.parts, lead, strict=True)]
        df = c.df.groupBy(*cols).agg(*(m.alias(n) for m, n in zip(made, names, strict=True)))
        from ..types import tuple_of

        return Compiled(df, (), Out("value", type=tuple_of(keys.type, aggs.type), columns=(*lead, *names)))

    def _aggregated(self, a: Any, x: Lowered | None) -> Column:
        if a.kind == "count":
            return F.count(F.lit(1))
        assert x is not None
        if a.kind == "count_present":
            return F.count(x.value if a.input.type.kind != "truth" else F.when(x.value.isNotNull() | F.lit(True), 1))
        if a.kind == "sum":
            return exact_sum(x.value, a.input.type, F.sum)
        return F.min(x.value) if a.kind == "min" else F.max(x.value)

    def _sort(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        e, down = node.data
        if not e.type.has("ordering"):
            raise ExactError("PIPELINE-TYPE-001", f"{e.type.name} has no order to sort by")
        keys = sort_keys(self._lower(e, c), e.type, down)
        return replace(c, order=(*keys, *c.order))

    def _distinct(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        _equality(c.out, "distinct")
        return replace(c, df=_distinct(c.df, c.out), order=())

    def _slice(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        offset, n = node.data
        df = _settled(c).df
        df = df.offset(offset) if offset else df
        return replace(c, df=df if n is None else df.limit(n), order=())

    def _join(self, node: Pipeline, a: Compiled, b: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        kind, on = node.data
        scopes = (*a.scopes, *b.scopes)
        by_model: dict[str, list[Scope]] = {}
        for s in scopes:
            by_model.setdefault(s.model.key, []).append(s)
        for key, same in by_model.items():
            if len(same) > 1 and any(s.alias is None for s in same):
                raise ExactError("PIPELINE-SCOPE-001", f"{key} is joined with itself; each of its sources needs an alias")
        aliases = [s.alias for s in scopes if s.alias]
        if len(set(aliases)) < len(aliases):
            raise ExactError("PIPELINE-SCOPE-002", "two sources have one alias")
        left, right = a.df, b.df
        flags = [""] * 2
        for side, lacking in enumerate((("right", "full"), ("left", "full"))):
            if kind in lacking:
                self.count += 1
                flags[side] = f"m{self.count}!"
                if side == 0:
                    left = left.withColumn(flags[0], F.lit(True))
                else:
                    right = right.withColumn(flags[1], F.lit(True))
        if kind == "cross":
            df = left.crossJoin(right)
        else:
            self._check(on, scopes, (), False)
            df = left.join(right, condition(on, self._context(scopes, (), False)), kind)
        for f in flags:
            if f:
                df = df.withColumn(f, F.coalesce(F.col(f), F.lit(False)))
        outs = [Out("nullable", parts=(x.out,), matched=f) if f else x.out for x, f in zip((a, b), flags, strict=True)]
        kept = tuple(replace(s, nullable=s.nullable or bool(flags[0] if s in a.scopes else flags[1]), unique=False) for s in scopes)
        return Compiled(df, kept, Out("product", parts=tuple(outs)))

    def _set(self, node: Pipeline, a: Compiled, b: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        (kind,) = node.data
        if not a.out.same(b.out):
            raise ExactError("PIPELINE-TYPE-003", "both sides of a set operation need rows of one shape")
        if kind != "union_all":
            _equality(a.out, kind)
        mine = a.out.all_columns()
        kept = _settled if kind == "union_all" else lambda c: c  # the others give no order
        left = kept(a).df.select(*(F.col(c) for c in mine))
        right = kept(b).df.select(*(F.col(x).alias(y) for x, y in zip(b.out.all_columns(), mine, strict=True)))
        if kind == "union_all":
            df = left.union(right)
        elif kind == "union":
            df = _distinct(left.union(right), a.out)
        else:
            x, back = _comparable(left, a.out)
            y, _ = _comparable(right, a.out)
            nan = _any_nan(a.out)
            if nan is None:
                df = back(x.intersect(y) if kind == "intersect" else x.subtract(y))
            else:  # a NaN equals nothing, not itself either
                x0, y0 = x.filter(~nan), y.filter(~nan)
                df = back(x0.intersect(y0) if kind == "intersect" else x0.subtract(y0).union(x.filter(nan)))
        if a.out.kind == "model" and len(a.scopes) == 1 and len(b.scopes) == 1:
            scope = replace(a.scopes[0], alias=None, unique=a.scopes[0].unique and kind in ("intersect", "except"))
            return Compiled(df, (scope,), Out("model", scope))
        return Compiled(df, (), a.out)

    def _unnest(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        ty = c.out.type
        if c.out.kind != "value" or ty is None or ty.kind != "list" or (ty.null and not node.data[0]):
            raise ExactError("PIPELINE-UNNEST-001", "unnest takes rows that are one list each; unnest_present those that may be null")
        part = ty.parts[0]
        return Compiled(c.df.select(F.explode(c.out.columns[0]).alias("value")), (), Out("value", type=part, columns=("value",)))

    def _window(self, node: Pipeline, c: Compiled, outer: tuple[Scope, ...]) -> Compiled:
        w: Window = node.data[0]
        if not c.scopes:
            raise ExactError("PIPELINE-WINDOW-001", "a window needs a model's rows below it")
        for k in w.partition:
            if not (k.type.has("equality") and k.type.has("keyable")):
                raise ExactError("PIPELINE-WINDOW-002", f"a window cannot be partitioned by {k.type.name}")
        for k, _ in w.order:
            if not all(k.type.has(p) for p in ("ordering", "equality", "keyable")):
                raise ExactError("PIPELINE-WINDOW-003", f"a window cannot be ordered by {k.type.name}")
        spec = W.partitionBy(*(self._lower(k, c).value for k in w.partition))
        keys = [x for k, down in w.order for x in sort_keys(self._lower(k, c), k.type, down)]
        if keys:
            spec = spec.orderBy(*keys)
        if w.kind != "sum":
            if not w.order:
                raise ExactError("PIPELINE-WINDOW-005", f"{w.kind} means nothing without an order")
            if w.rows is not None:
                raise ExactError("PIPELINE-WINDOW-006", f"{w.kind} looks at the whole partition and takes no frame")
            if w.kind == "row_number":
                self._total(c, w)
            value = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[w.kind]().over(spec).cast("long")
        else:
            if w.input is None:
                raise ExactError("PIPELINE-WINDOW-007", "window_sum needs something to sum")
            if w.input.type.null and not w.present:
                raise ExactError("PIPELINE-WINDOW-008", "the input can be null: window_sum_present leaves nulls out")
            if not w.input.type.has("exact"):
                raise ExactError("PIPELINE-WINDOW-009", f"{w.input.type.name} cannot be summed exactly")
            if w.rows is None:
                raise ExactError("PIPELINE-WINDOW-011", "say which rows are summed, such as Rows.all()")
            lo, hi = w.rows.start, w.rows.end
            if lo is not None and hi is not None and lo > hi:
                raise ExactError("PIPELINE-WINDOW-013", "the frame ends before it begins")
            if (lo, hi) != (None, None):
                if not w.order:
                    raise ExactError("PIPELINE-WINDOW-012", "a frame with a bound needs an order")
                self._total(c, w)
            spec = spec.rowsBetween(W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)
            value = exact_sum(self._lower(w.input, c).value, w.input.type, lambda x: F.sum(x).over(spec))
        self.count += 1
        name = f"w!{self.count}"
        df = c.df.withColumn(name, value)
        return replace(c, df=df, out=Out("product", parts=(c.out, Out("value", type=w.type, columns=(name,)))), order=())

    def _total(self, c: Compiled, w: Window) -> None:
        what = "row_number" if w.kind == "row_number" else "window_sum"
        if len(c.scopes) != 1:
            raise ExactError("PIPELINE-WINDOW-014", f"{what} over a join: no key is known that tells all rows apart")
        s = c.scopes[0]
        if not s.model.identity:
            raise ExactError("PIPELINE-WINDOW-015", f"{what} on a model without identity: ties would fall as chance has it")
        if not s.unique:
            raise ExactError("PIPELINE-WINDOW-018", f"{what} on rows among which an identity can repeat")
        direct = {k.data[1] for k, _ in w.order if k.op == "field"}
        for key in s.model.identity:
            if key not in direct:
                raise ExactError("PIPELINE-WINDOW-017", f"{what} could tie: order by {key} as well")


def _settled(c: Compiled) -> Compiled:
    """With its rows sorted. Rows that tie keep the order they come in: by partition, then place."""
    if not c.order:
        return c
    return replace(c, df=c.df.withColumn("ordinal!", F.monotonically_increasing_id()).orderBy(*c.order, F.col("ordinal!").asc()).drop("ordinal!"))


def exact_sum(x: Column, ty: Type, total: Callable[[Column], Column]) -> Column:
    """A sum that no order of additions changes; only its final value must fit the type."""
    target = ty.spark()
    if ty.is_int and ty.bits <= 32:
        out = total(x.cast("long"))
    else:
        out = total(x.cast(f"decimal(38,{ty.scale if ty.kind == 'decimal' else 0})"))
    if ty.is_int:
        lo, hi = ty.range
        bounds = [F.lit(str(v)).cast("decimal(38,0)") if ty.bits > 32 else F.lit(v) for v in (lo, 2**63 - 1 if ty.stored == "long" else min(hi, 10**38 - 1))]
        out = F.when(out.isNull() | out.between(*bounds), out).otherwise(F.raise_error(F.lit(f"EXPR-EVAL-002: overflow of {ty.name}")))
    return out.cast(target)


def sort_keys(x: Lowered, ty: Type, down: bool) -> list[Column]:
    """Missing, then null, then values; floats by IEEE total order but for the sign of NaN."""
    way = (lambda c: c.desc_nulls_last()) if down else (lambda c: c.asc_nulls_first())
    out = [] if x.missing is None else [way(~x.missing)]
    out.append(way(x.value))
    if ty.is_float:
        out.append(way(F.when(x.value.cast("string") == "-0.0", 0).otherwise(1)))
    return out


def _equality(out: Out, what: str) -> None:
    for name, ty in out.types():
        if not ty.has("equality"):
            raise ExactError("PIPELINE-TYPE-002", f"{what} compares rows, and {name.rpartition('!')[2]} ({ty.name}) cannot be compared")


def _any_nan(out: Out) -> Column | None:
    found = None
    for name, ty in out.types():
        if ty.is_float:
            one = F.coalesce(F.isnan(F.col(name)), F.lit(False))
            found = one if found is None else found | one
    return found


def _comparable(df: DataFrame, out: Out) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Maps as sorted entries, which Spark can compare, and the way back."""
    columns = out.all_columns()
    maps = {n for n, ty in out.types() if ty.kind == "map"}
    there = df.select(*(F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in columns))
    return there, lambda d: d.select(*(F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in columns))


def _distinct(df: DataFrame, out: Out) -> DataFrame:
    there, back = _comparable(df, out)
    nan = _any_nan(out)
    if nan is None:
        return back(there.distinct())
    # rows with a NaN are distinct from all others
    return back(there.withColumn("nan!", F.when(nan, F.monotonically_increasing_id())).distinct().drop("nan!"))
