"""Semantic types: what may be compared, ordered, grouped and added, and which Spark type holds the values.

Properties are decided here, before Spark sees a plan, because Spark would accept more: it orders and groups floats,
and adds them in any order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Literal

from pyspark.sql import types as T

from .errors import ExactError

PROPERTIES = ("equality", "ordering", "keyable", "numeric", "integral", "exact", "temporal", "collection")
#: Limits on definitions.
MAX_DEPTH, MAX_WIDTH, MAX_NODES = 64, 1024, 4096

_SPARK = {
    "bool": T.BooleanType(), "truth": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "i128": T.DecimalType(38, 0), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "u128": T.DecimalType(38, 0), "f32": T.FloatType(), "f64": T.DoubleType(), "char": T.StringType(), "string": T.StringType(),
    "uuid": T.StringType(), "date": T.DateType(), "time": T.LongType(), "local": T.TimestampNTZType(), "instant": T.TimestampType(),
    "duration": T.LongType(), "month": T.ByteType(), "weekday": T.ByteType(), "bytes": T.BinaryType(),
}
_TEMPORAL = frozenset(("date", "time", "local", "instant", "duration"))


@dataclass(frozen=True)
class Type:
    """``kind``: a scalar's name, decimal, list, map, tuple or record. ``parts``: element types. ``names``: a record's fields, sorted."""

    kind: str
    parts: tuple[Type, ...] = ()
    names: tuple[str, ...] = ()
    null: bool = False
    precision: int = 0
    scale: int = 0
    key: str = ""
    version: int = 1
    #: Properties taken away from what the kind has.
    without: frozenset[str] = frozenset()
    #: How the value is stored, if the mapping of the source proves that it fits: a signed 64-bit number for u64.
    stored: str = ""

    # identity leaves storage out
    def same(self, other: Type) -> bool:
        return self.bare() == other.bare()

    def bare(self) -> Type:
        return replace(self, stored="", parts=tuple(p.bare() for p in self.parts))

    @property
    def name(self) -> str:
        if self.key:
            return self.key
        inner = ",".join((f"{n}:" if n else "") + p.name + ("?" if p.null else "") for n, p in zip(self.names or ("",) * len(self.parts), self.parts, strict=True))
        return f"core/{self.kind}" + (f"<{inner}>" if self.parts else f"({self.precision},{self.scale})" if self.kind == "decimal" else "")

    def nullable(self) -> Type:
        return replace(self, null=True)

    def non_null(self) -> Type:
        return replace(self, null=False)

    def has(self, prop: str) -> bool:
        return prop not in self.without and prop in self._properties()

    def _properties(self) -> frozenset[str]:
        k = self.kind
        if k in ("list", "map", "tuple", "record"):
            own = {"collection"}
            if all(p.has("equality") for p in self.parts):
                own.add("equality")
            if k in ("tuple", "record") and all(p.has("keyable") for p in self.parts):
                own.add("keyable")
            return frozenset(own)
        own = {"equality", "ordering", "keyable"}
        if self.is_int:
            own |= {"numeric", "integral", "exact"}
        elif self.is_float:
            own = {"equality", "ordering", "numeric"}
        elif k == "decimal":
            own |= {"numeric", "exact"}
        elif k == "truth":
            own.discard("ordering")
        elif k in _TEMPORAL:
            own.add("temporal")
        return frozenset(own)

    @property
    def is_int(self) -> bool:
        return bool(re.fullmatch(r"[iu]\d+", self.kind))

    @property
    def is_float(self) -> bool:
        return self.kind in ("f32", "f64")

    @property
    def bits(self) -> int:
        return int(self.kind[1:])

    @property
    def range(self) -> tuple[int, int]:
        """Least and largest value of an integer type. At 128 bits what a 38-digit decimal holds: more is refused, never wrapped."""
        if self.bits == 128:
            return (0 if self.kind[0] == "u" else -(10**38 - 1)), 10**38 - 1
        return (0, 2**self.bits - 1) if self.kind[0] == "u" else (-(2 ** (self.bits - 1)), 2 ** (self.bits - 1) - 1)

    def spark(self) -> T.DataType:
        if self.kind == "list":
            return T.ArrayType(self.parts[0].spark(), self.parts[0].null)
        if self.kind == "map":
            return T.MapType(self.parts[0].spark(), self.parts[1].spark(), self.parts[1].null)
        if self.kind in ("tuple", "record"):
            names = self.names or tuple(f"_{k + 1}" for k in range(len(self.parts)))
            return T.StructType([T.StructField(n, p.spark(), p.null) for n, p in zip(names, self.parts, strict=True)])
        if self.kind == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return T.LongType() if self.stored == "long" else _SPARK[self.kind]

    def validate(self, depth: int = 0) -> Type:
        if depth > MAX_DEPTH:
            raise ExactError("TYPE-001", f"types are nested at most {MAX_DEPTH} deep")
        if self.version <= 0:
            raise ExactError("TYPE-007", "versions of types begin at 1")
        if self.key and not re.fullmatch(r"[^\s/]+(/[^\s/]+)+", self.key):
            raise ExactError("TYPE-013", "a type key has the form namespace/name without white space")
        if self.kind == "tuple" and len(self.parts) > MAX_WIDTH:
            raise ExactError("TYPE-003", f"a tuple has at most {MAX_WIDTH} elements")
        if self.kind == "record" and len(self.parts) > MAX_WIDTH:
            raise ExactError("TYPE-004", f"a record has at most {MAX_WIDTH} fields")
        if self.kind == "record" and any(not n for n in self.names):
            raise ExactError("TYPE-005", "every field of a record has a name")
        if self.kind == "record" and len(set(self.names)) < len(self.names):
            raise ExactError("TYPE-006", "a record names each of its fields once")
        if self.is_int and self.bits not in (8, 16, 32, 64, 128):
            raise ExactError("TYPE-008", "integer width must be 8, 16, 32, 64 or 128 bits")
        if self.kind == "map" and (self.parts[0].null or not self.parts[0].has("equality") or not self.parts[0].has("keyable")):
            raise ExactError("TYPE-009", "map keys need an equality and cannot be null")
        for p in self.parts:
            p.validate(depth + 1)
        if depth == 0 and self.nodes() > MAX_NODES:
            raise ExactError("TYPE-010", f"type has more than {MAX_NODES} nodes")
        return self

    def nodes(self) -> int:
        return 1 + sum(p.nodes() for p in self.parts)


BOOL, TRUTH = Type("bool"), Type("truth")
I8, I16, I32, I64, I128 = (Type(f"i{b}") for b in (8, 16, 32, 64, 128))
U8, U16, U32, U64, U128 = (Type(f"u{b}") for b in (8, 16, 32, 64, 128))
F32, F64 = Type("f32"), Type("f64")
CHAR, STRING, UUID, BYTES = Type("char"), Type("string"), Type("uuid"), Type("bytes")
DATE, TIME, LOCAL, INSTANT, DURATION = (Type(k) for k in ("date", "time", "local", "instant", "duration"))
MONTH, WEEKDAY = Type("month"), Type("weekday")


def decimal(precision: int, scale: int) -> Type:
    return Type("decimal", precision=precision, scale=scale)


def list_of(part: Type) -> Type:
    return Type("list", (part,))


def map_of(key: Type, value: Type) -> Type:
    return Type("map", (key, value))


def tuple_of(*parts: Type) -> Type:
    return Type("tuple", parts)


def record_of(**parts: Type) -> Type:
    names = tuple(sorted(parts))
    return Type("record", tuple(parts[n] for n in names), names)


def semantic(base: Type, key: str, version: int = 1, without: tuple[str, ...] = ()) -> Type:
    """A caller's own type, held like ``base``; it may have fewer properties, never more."""
    if unknown := set(without) - set(PROPERTIES):
        raise ExactError("TYPE-011", f"unknown type property {sorted(unknown)[0]}")
    return replace(base, key=key, version=version, without=base.without | frozenset(without)).validate()


def consistent(types: list[Type]) -> None:
    """Each key and version has one definition."""
    seen: dict[tuple[str, int], Type] = {}

    def walk(t: Type) -> None:
        if t.key and not seen.setdefault((t.key, t.version), t.bare().non_null()).same(t.non_null()):
            raise ExactError("TYPE-101", f"two types go by {t.key} version {t.version}")
        for p in t.parts:
            walk(p)

    for t in types:
        walk(t)


Presence = Literal["required", "optional"]
