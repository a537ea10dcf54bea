"""Expressions to Spark columns, exactly: the value, and whether it is missing.

Truth is a boolean column, null for Unknown. Where Spark's own operators differ from the language (comparison and
division of floats, equality of truth values, unsigned ranges, white space) the guarded form is written out; all of it
stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExactError
from ..expr import Expr
from ..functions import BUILT_IN
from ..types import Type
from ..values import check


class Lowered(NamedTuple):
    value: Column
    #: None if it can never be missing.
    missing: Column | None = None


class Context(NamedTuple):
    """``field``: (model, field key, alias) to a lowered column. ``parameters``: bound values. ``exists``: the data frame of a sub-pipeline."""

    field: Callable[[Any, str, str | None], Lowered]
    parameters: dict[str, Any]
    exists: Callable[[Any], DataFrame] | None = None


def _either(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a | b


def literal(value: Any, ty: Type) -> Column:
    """A checked value as a column of the type's Spark type."""
    if value is None or not ty.parts:
        return F.lit(value).cast(ty.spark())
    if ty.kind == "map":
        items = [literal(x, p) for pair in value.items() for x, p in zip(pair, ty.parts, strict=True)]
        out = F.create_map(*items)
    elif ty.kind == "list":
        out = F.array(*(literal(x, ty.parts[0]) for x in value))
    else:
        names = ty.names or tuple(f"_{k + 1}" for k in range(len(ty.parts)))
        return F.struct(*(literal(x, p).alias(n) for x, p, n in zip(value, ty.parts, names, strict=True)))
    return out if value else out.cast(ty.spark())


def _maps(ty: Type, c: Column) -> Column:
    """Maps have no order of entries and no equality in Spark."""
    return F.array_sort(F.map_entries(c)) if ty.kind == "map" else c


def lower(e: Expr, ctx: Context) -> Lowered:
    if e.op == "field":
        return ctx.field(*e.data)
    if e.op == "literal":
        return Lowered(literal(e.data[0], e.type))
    if e.op == "param":
        name = e.data[0]
        if name not in ctx.parameters:
            raise ExactError("EXPR-EVAL-103", f"parameter {name} is not bound")
        try:
            return Lowered(literal(check(ctx.parameters[name], e.type), e.type))
        except ExactError as x:
            raise ExactError("EXPR-EVAL-111", f"the value given for {name} is not of its type") from x
    if e.op == "exists":
        if ctx.exists is None:
            raise ExactError("EXPR-EVAL-112", "exists() needs a pipeline around it")
        found = ctx.exists(e.data[0]).exists()
        return Lowered(~found if e.data[1] else found)
    args = [lower(a, ctx) for a in e.args]
    a = args[0]
    if e.op in ("eq", "ne", "distinct", "not_distinct", "lt", "le", "gt", "ge"):
        return Lowered(_compare(e.op, e.args[0].type, a, args[1]))
    if e.op == "in":
        if len(args) == 1:
            return Lowered(F.lit(False))
        if e.args[0].type.is_float or e.args[0].type.kind in ("truth", "map"):
            out = F.lit(False)
            for x in args[1:]:
                out = out | _compare("eq", e.args[0].type, a, x)
            return Lowered(out)
        return Lowered(a.value.isin(*(x.value for x in args[1:])))
    if e.op == "and":
        return Lowered(a.value & args[1].value)
    if e.op == "or":
        return Lowered(a.value | args[1].value)
    if e.op == "not":
        return Lowered(~a.value)
    if e.op == "is_missing":
        return Lowered(F.lit(False) if a.missing is None else a.missing)
    if e.op == "is_present":
        return Lowered(F.lit(True) if a.missing is None else ~a.missing)
    if e.op == "is_null":
        if e.args[0].type.kind == "truth":
            return Lowered(F.lit(False))  # Unknown is a value
        return Lowered(a.value.isNull() if a.missing is None else a.value.isNull() & ~a.missing)
    if e.op == "coalesce":
        b = args[1]
        return Lowered(F.coalesce(a.value, b.value), None if b.missing is None else a.value.isNull() & b.missing)
    if e.op == "if":
        yes, no = args[1], args[2]
        missing = None
        if yes.missing is not None or no.missing is not None:
            known = lambda x: F.lit(False) if x.missing is None else x.missing
            missing = F.when(a.value, known(yes)).otherwise(known(no))
        return Lowered(F.when(a.value, yes.value).otherwise(no.value), missing)
    if e.op == "nullable":
        return a
    if e.op in ("add", "sub", "mul", "div", "rem"):
        return Lowered(_arithmetic(e.op, e.type, a.value, args[1].value, (e.args[0].type, e.args[1].type)), _either(a.missing, args[1].missing))
    if e.op == "neg":
        return Lowered(_checked_sign(-a.value, a.value, e.type), a.missing)
    if e.op == "abs":
        return Lowered(_checked_sign(F.abs(a.value), a.value, e.type), a.missing)
    if e.op == "cast":
        return Lowered(a.value.cast(e.type.spark()), a.missing)
    if e.op == "call":
        out = BUILT_IN[e.data[0]](*(x.value for x in args))
        return Lowered(out, None if e.type.kind == "truth" else a.missing)
    if e.op == "custom":
        missing = None
        for x in args:
            missing = _either(missing, x.missing)
        return Lowered(e.data[0].build(*(x.value for x in args)), missing)
    raise ExactError("EXPR-EVAL-107", f"unknown expression {e.op}")


def _checked_sign(out: Column, x: Column, ty: Type) -> Column:
    """The least signed number has no opposite."""
    if not ty.is_int or ty.kind[0] == "u" or ty.spark().typeName() == "decimal":
        return out.cast(ty.spark())
    return F.when(x == ty.range[0], _refused("EXPR-EVAL-002", f"overflow of {ty.name}", ty)).otherwise(out).cast(ty.spark())


def _compare(op: str, ty: Type, a: Lowered, b: Lowered) -> Column:
    x, y = _maps(ty, a.value), _maps(ty, b.value)
    if op in ("distinct", "not_distinct"):
        same = x.eqNullSafe(y)
        if ty.is_float:
            same = same & ~F.coalesce(F.isnan(x) | F.isnan(y), F.lit(False))
        if a.missing is not None or b.missing is not None:
            known = [F.lit(False) if m is None else m for m in (a.missing, b.missing)]
            same = same & (known[0] == known[1])
        return ~same if op == "distinct" else same
    if ty.kind == "truth" and op in ("eq", "ne"):
        return x.eqNullSafe(y) if op == "eq" else ~x.eqNullSafe(y)
    plain = {"eq": lambda: x == y, "ne": lambda: x != y, "lt": lambda: x < y, "le": lambda: x <= y, "gt": lambda: x > y, "ge": lambda: x >= y}[op]()
    if ty.is_float:
        return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when(F.isnan(x) | F.isnan(y), F.lit(op == "ne")).otherwise(plain)
    return plain


def condition(e: Expr, ctx: Context) -> Column:
    """As ``lower``, for a place where False and Unknown are the same (a filter, a join): equal floats stay a join key."""
    if e.op == "and":
        return condition(e.args[0], ctx) & condition(e.args[1], ctx)
    if e.op == "eq" and e.args[0].type.is_float:
        a, b = (lower(x, ctx).value for x in e.args)
        return (a == b) & ~F.isnan(a)
    return lower(e, ctx).value


def _arithmetic(op: str, ty: Type, a: Column, b: Column, of: tuple[Type, Type]) -> Column:
    if ty.kind == "decimal" and op == "div":
        return _decimal_division(a, b, *of).cast(ty.spark())
    if ty.is_float:
        if op == "div":
            return _float_division(a, b, ty)
        return {"add": a + b, "sub": a - b, "mul": a * b}[op].cast(ty.spark())
    if ty.kind == "decimal":
        return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[op]().cast(ty.spark())
    wide = ty.spark().typeName() == "decimal"
    if op in ("div", "rem"):
        b = F.when(b == 0, _refused("EXPR-EVAL-002", f"division of {ty.name} by zero", ty)).otherwise(b)
    if ty.kind[0] == "i" and not wide:
        return _signed(op, ty, a, b)
    if op == "div":
        out = ((a - a % b) / b) if wide else F.call_function("div", a, b)
    else:
        out = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "rem": lambda: a % b}[op]()
    if ty.kind[0] == "u" or wide:
        lo, hi = ty.range
        if ty.stored == "long":
            hi = 2**63 - 1
        bounds = [F.lit(str(v)).cast("decimal(38,0)") if wide else F.lit(v) for v in (lo, hi)]
        out = F.when(out.isNull() | out.between(*bounds), out).otherwise(F.raise_error(F.lit(f"EXPR-EVAL-002: overflow of {ty.name}")))
    return out.cast(ty.spark())


def _refused(code: str, why: str, ty: Type) -> Column:
    """An error when a row comes to it."""
    return F.raise_error(F.lit(f"{code}: {why}")).cast(ty.spark())


def _within(out: Column, ty: Type) -> Column:
    """A long that must fit a narrower signed type."""
    lo, hi = ty.range
    return F.when(out.isNull() | out.between(lo, hi), out).otherwise(_refused("EXPR-EVAL-002", f"overflow of {ty.name}", ty).cast("long")).cast(ty.spark())


def _signed(op: str, ty: Type, a: Column, b: Column) -> Column:
    """Up to 32 bits by way of longs, where nothing can overflow; 64 bits by the forms that give null where it does."""
    if ty.bits < 64:
        x, y = a.cast("long"), b.cast("long")
        return _within({"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: F.call_function("div", x, y), "rem": lambda: x % y}[op](), ty)
    if op == "rem":
        return a % b
    if op == "div":
        return F.when((b == -1) & (a == -(2**63)), _refused("EXPR-EVAL-002", f"overflow of {ty.name}", ty)).otherwise(F.call_function("div", a, b))
    out = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](a, b)
    return F.when(out.isNull() & a.isNotNull() & b.isNotNull(), _refused("EXPR-EVAL-002", f"overflow of {ty.name}", ty)).otherwise(out)


def _decimal_division(a: Column, b: Column, of: Type, by: Type) -> Column:
    """18 decimals, the last one rounded half away from zero: a long division of whole numbers in two steps of nine digits.

    Spark's own division stops at a scale that depends on the precisions. Quotients of what is divisible are exact in it.
    """
    scale = max(of.scale, by.scale)
    whole = lambda c, ty: (c * F.lit(str(10**scale)).cast(f"decimal({scale + 1},0)")).cast(f"decimal({ty.precision + scale - ty.scale},0)")
    y = whole(F.when(b == 0, _refused("EXPR-EVAL-003", "decimal division by zero", by)).otherwise(b), by)
    digits = f"decimal({by.precision + scale - by.scale},0)"
    nine = F.lit("1000000000").cast("decimal(10,0)")
    step = lambda x, kind: (((x - x % y) / y).cast(kind), (x % y).cast(digits))
    first, rest = step(whole(a, of), "decimal(19,0)")
    second, rest = step(rest * nine, "decimal(10,0)")
    third, rest = step(rest * nine, "decimal(10,0)")
    sign = F.when((a < 0) == (b < 0), 1).otherwise(-1).cast("decimal(1,0)")
    third = third + F.when(F.abs(rest) >= F.abs(y) - F.abs(rest), sign).otherwise(F.lit(0).cast("decimal(1,0)"))
    part = F.lit("0.000000001").cast("decimal(9,9)")
    return first.cast("decimal(37,18)") + (second * part + third * part * part).cast("decimal(19,18)")  # a sum that keeps its scale


def _float_division(a: Column, b: Column, ty: Type) -> Column:
    """IEEE: by zero gives an infinity or NaN. Only a zero's text tells its sign."""
    inf = lambda s: F.lit(s).cast(ty.spark())
    positive = (a < 0) == (b.cast("string") == "-0.0")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast(ty.spark()))
        .when(b != 0, a / b)
        .when(F.isnan(a) | (a == 0), inf("NaN"))
        .when(positive, inf("Infinity"))
        .otherwise(inf("-Infinity"))
        .cast(ty.spark())
    )
