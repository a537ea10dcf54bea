"""Missing, null and value: checks of single values against types."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from typing import Any

from .errors import ExactError
from .types import Presence, Type


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False


#: An optional field that is not there, as opposed to None, which is null.
MISSING = _Missing()


def check(value: Any, ty: Type, presence: Presence = "required") -> Any:
    """``value`` if it conforms, with numbers as Spark takes them."""
    if value is MISSING:
        if presence != "optional":
            raise ExactError("RUNTIME-002", "a value that must be there is missing")
        return value
    if value is None:
        if not ty.null:
            raise ExactError("RUNTIME-003", "null where no null may be")
        return None
    return _conform(value, ty)


def _no(ty: Type) -> ExactError:
    return ExactError("RUNTIME-004", f"not a value of {ty.name}")


def _inner(value: Any, ty: Type) -> Any:
    if value is MISSING:
        raise ExactError("RUNTIME-006", "only a named field can be missing")
    return check(value, ty)


def _conform(v: Any, ty: Type) -> Any:
    k = ty.kind
    if k == "bool" or k == "truth":
        if not isinstance(v, bool):
            raise _no(ty)
        return v
    if ty.is_int:
        if isinstance(v, bool) or not isinstance(v, int | decimal.Decimal) or v != int(v):
            raise _no(ty)
        lo, hi = ty.range
        if not lo <= v <= hi:
            raise _no(ty)
        return decimal.Decimal(int(v)) if isinstance(ty.spark(), _decimal_type()) else int(v)
    if ty.is_float:
        if isinstance(v, bool) or not isinstance(v, int | float):
            raise _no(ty)
        return float(v)
    if k == "decimal":
        if not isinstance(v, decimal.Decimal | int) or isinstance(v, bool):
            raise _no(ty)
        d = decimal.Decimal(v)
        with decimal.localcontext(prec=60):
            q = d.quantize(decimal.Decimal(1).scaleb(-ty.scale))
        if q != d or abs(q) >= decimal.Decimal(10) ** (ty.precision - ty.scale):
            raise _no(ty)
        return q
    if k in ("string", "char", "uuid"):
        if k == "uuid" and isinstance(v, uuid.UUID):
            v = str(v)
        if not isinstance(v, str) or (k == "char" and len(v) != 1) or (k == "uuid" and str(uuid.UUID(v)) != v):
            raise _no(ty)
        return v
    if k == "bytes":
        if not isinstance(v, bytes | bytearray):
            raise _no(ty)
        return bytes(v)
    if k in ("month", "weekday"):
        if not isinstance(v, int) or not 1 <= v <= (12 if k == "month" else 7):
            raise _no(ty)
        return v
    if k in ("time", "duration"):
        if not isinstance(v, int) or isinstance(v, bool) or (k == "time" and not 0 <= v < 86_400_000_000_000) or abs(v) >= 2**63:
            raise _no(ty)
        return v
    if k == "date":
        if not isinstance(v, dt.date) or isinstance(v, dt.datetime):
            raise _no(ty)
        return v
    if k in ("local", "instant"):
        if not isinstance(v, dt.datetime) or (v.tzinfo is not None) != (k == "instant"):
            raise _no(ty)
        return v
    if k == "list":
        if not isinstance(v, list | tuple):
            raise _no(ty)
        return [_inner(x, ty.parts[0]) for x in v]
    if k == "map":
        pairs = list(v.items()) if isinstance(v, dict) else list(v)
        out: dict[Any, Any] = {}
        for key, x in pairs:
            if key in out:
                raise ExactError("RUNTIME-007", "a map has each key once")
            out[_inner(key, ty.parts[0])] = _inner(x, ty.parts[1])
        return out
    if k == "tuple":
        if not isinstance(v, tuple | list) or len(v) != len(ty.parts):
            raise _no(ty)
        return tuple(_inner(x, p) for x, p in zip(v, ty.parts, strict=True))
    if not isinstance(v, dict):
        raise _no(ty)
    for n in ty.names:
        if n not in v:
            raise ExactError("RUNTIME-005", f"the record lacks {n}")
    if len(v) != len(ty.names):
        raise _no(ty)
    return tuple(_inner(v[n], p) for n, p in zip(ty.names, ty.parts, strict=True))


def _decimal_type():
    from pyspark.sql.types import DecimalType

    return DecimalType
