"""A canonical binary form of types, values, models and model sets, and a decoder that is bounded in every direction.

A frame: four magic bytes, major and minor version (2 bytes each), kind, flags, two reserved bytes, payload length
(8 bytes); numbers are big-endian. One value has one encoding, and the decoder takes no other.
"""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid
from dataclasses import dataclass, replace
from typing import Any

from ..errors import ExactError
from ..model import FieldDef, Model, ModelSet, Reference, Relation
from ..types import Type
from ..values import MISSING, check

MAGIC, MAJOR, MINOR, HEADER = b"XFRW", 1, 0, 20
TYPE, DATUM, MODEL, MODEL_SET = 1, 2, 3, 4
_KINDS = (
    "bool", "truth", "i8", "i16", "i32", "i64", "i128", "u8", "u16", "u32", "u64", "u128", "f32", "f64", "decimal", "char", "string", "bytes",
    "uuid", "date", "time", "local", "instant", "duration", "month", "weekday", "list", "map", "tuple", "record",
)
_CARDINALITY = ("one", "optional_one", "many")
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class WireLimits:
    total_bytes: int = 8 << 20
    nodes: int = 65_536
    depth: int = 128
    string_bytes: int = 1 << 20
    items: int = 65_536


def _fail(what: str) -> ExactError:
    return ExactError("WIRE-001", what)


class _Writer:
    def __init__(self, limits: WireLimits):
        self.out, self.limits, self.nodes = bytearray(), limits, 0

    def node(self, depth: int) -> None:
        self.nodes += 1
        if self.nodes > self.limits.nodes or depth > self.limits.depth:
            raise _fail("too many or too deeply nested nodes")

    def byte(self, v: int) -> None:
        self.out.append(v)

    def u32(self, v: int) -> None:
        self.out += struct.pack(">I", v)

    def blob(self, v: bytes) -> None:
        if len(v) > self.limits.string_bytes:
            raise _fail("string too long")
        self.u32(len(v))
        self.out += v

    def text(self, v: str) -> None:
        self.blob(v.encode())

    def wide(self, v: int) -> None:
        self.out += int(v).to_bytes(17, "big", signed=True)

    def type(self, t: Type, depth: int = 0) -> None:
        self.node(depth)
        self.byte(_KINDS.index(t.kind))
        self.byte(t.null)
        self.text(t.key)
        self.u32(t.version)
        self.byte(t.precision)
        self.byte(t.scale)
        self.u32(len(t.without))
        for p in sorted(t.without):
            self.text(p)
        self.u32(len(t.parts))
        for k, p in enumerate(t.parts):
            if t.kind == "record":
                self.text(t.names[k])
            self.type(p, depth + 1)

    def datum(self, v: Any, t: Type, depth: int = 0) -> None:
        self.node(depth)
        if v is MISSING or v is None:
            return self.byte(0 if v is MISSING else 1)
        self.byte(2)
        k, d = t.kind, depth + 1
        if k in ("bool", "truth", "month", "weekday"):
            self.byte(int(v))
        elif t.is_int or k in ("time", "duration"):
            self.wide(v)
        elif t.is_float:
            self.out += struct.pack(">f" if k == "f32" else ">d", v)
        elif k == "decimal":
            self.wide(int(decimal.Decimal(v).scaleb(t.scale, decimal.Context(prec=60))))
        elif k in ("string", "char"):
            self.text(v)
        elif k == "bytes":
            self.blob(bytes(v))
        elif k == "uuid":
            self.out += uuid.UUID(v).bytes
        elif k == "date":
            self.wide(v.toordinal())
        elif k in ("local", "instant"):
            naive = v if k == "local" else v.astimezone(dt.UTC).replace(tzinfo=None)
            self.wide((naive - _EPOCH) // dt.timedelta(microseconds=1))
        elif k == "list":
            self.u32(len(v))
            for x in v:
                self.datum(x, t.parts[0], d)
        elif k == "map":
            pairs = []
            for a, b in v.items():
                w = _Writer(self.limits)
                w.datum(a, t.parts[0], d)
                pairs.append((bytes(w.out), b))
            self.u32(len(pairs))
            for a, b in sorted(pairs, key=lambda x: x[0]):  # entries have no order, so they are sorted by key
                self.out += a
                self.datum(b, t.parts[1], d)
        else:
            for x, p in zip(v, t.parts, strict=True):
                self.datum(x, p, d)

    def names(self, v: tuple[str, ...]) -> None:
        self.u32(len(v))
        for x in v:
            self.text(x)

    def model(self, m: Model) -> None:
        self.node(0)
        self.text(m.key)
        self.text(m.name)
        self.u32(len(m.fields))
        for f in m.fields:
            self.text(f.key)
            self.text(f.name)
            self.byte(f.optional)
            self.type(f.type, 1)
        self.names(m.identity)
        self.u32(len(m.uniques))
        for u in m.uniques:
            self.names(u)
        self.u32(len(m.references))
        for r in m.references:
            self.text(r.target)
            self.names(r.source_fields)
            self.names(r.target_fields)
        self.u32(len(m.relations))
        for x in m.relations:
            self.text(x.key)
            self.text(x.name)
            self.text(x.target)
            self.byte(_CARDINALITY.index(x.cardinality))
            self.names(tuple(s for s, _ in x.mapping))
            self.names(tuple(t for _, t in x.mapping))


class _Reader:
    def __init__(self, data: bytes, limits: WireLimits):
        self.data, self.at, self.limits, self.nodes = data, 0, limits, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _fail(f"frame ends at {len(self.data)}, {n} bytes are wanted at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def node(self, depth: int) -> None:
        self.nodes += 1
        if self.nodes > self.limits.nodes or depth > self.limits.depth:
            raise _fail("too many or too deeply nested nodes")

    def byte(self, most: int = 255) -> int:
        v = self.take(1)[0]
        if v > most:
            raise _fail(f"unexpected byte {v} at {self.at - 1}")
        return v

    def u32(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def count(self) -> int:
        n = self.u32()
        if n > self.limits.items or n > len(self.data) - self.at:
            raise _fail("more items than the frame can hold")
        return n

    def blob(self) -> bytes:
        n = self.u32()
        if n > self.limits.string_bytes:
            raise _fail("string too long")
        return self.take(n)

    def text(self) -> str:
        try:
            return self.blob().decode()
        except UnicodeDecodeError as e:
            raise _fail("text is not UTF-8") from e

    def wide(self) -> int:
        return int.from_bytes(self.take(17), "big", signed=True)

    def type(self, depth: int = 0) -> Type:
        self.node(depth)
        kind = _KINDS[self.byte(len(_KINDS) - 1)]
        null, key, version, precision, scale = bool(self.byte(1)), self.text(), self.u32(), self.byte(), self.byte()
        without = [self.text() for _ in range(self.count())]
        n = self.count()
        if (kind in ("list", "map")) and n != (1 if kind == "list" else 2) or n and kind not in ("list", "map", "tuple", "record"):
            raise _fail(f"{kind} has {n} parts")
        names, parts = [], []
        for _ in range(n):
            if kind == "record":
                names.append(self.text())
            parts.append(self.type(depth + 1))
        if sorted(set(without)) != without or (kind == "record" and sorted(set(names)) != names):
            raise _fail("names are not in canonical order")
        return Type(kind, tuple(parts), tuple(names), null, precision, scale, key, version, frozenset(without))

    def datum(self, t: Type, depth: int = 0) -> Any:
        self.node(depth)
        state = self.byte(2)
        if state < 2:
            return None if state else MISSING
        k, d = t.kind, depth + 1
        if k in ("bool", "truth"):
            return bool(self.byte(1))
        if k in ("month", "weekday"):
            return self.byte(12)
        if t.is_int or k in ("time", "duration"):
            return self.wide()
        if t.is_float:
            return struct.unpack(">f" if k == "f32" else ">d", self.take(4 if k == "f32" else 8))[0]
        if k == "decimal":
            return decimal.Decimal(self.wide()).scaleb(-t.scale, decimal.Context(prec=60))
        if k in ("string", "char"):
            return self.text()
        if k == "bytes":
            return self.blob()
        if k == "uuid":
            return str(uuid.UUID(bytes=self.take(16)))
        try:
            if k == "date":
                return dt.date.fromordinal(self.wide())
            if k in ("local", "instant"):
                at = _EPOCH + dt.timedelta(microseconds=self.wide())
                return at if k == "local" else at.replace(tzinfo=dt.UTC)
        except (ValueError, OverflowError) as e:
            raise _fail("date out of range") from e
        if k == "list":
            return [self.datum(t.parts[0], d) for _ in range(self.count())]
        if k == "map":
            out, last = {}, b""
            for n in range(self.count()):
                begin = self.at
                a = self.datum(t.parts[0], d)
                now = self.data[begin : self.at]
                if n and now <= last:
                    raise _fail("map keys are not in canonical order")
                last = now
                out[a] = self.datum(t.parts[1], d)
            return out
        values = [self.datum(p, d) for p in t.parts]
        return tuple(values) if k == "tuple" else dict(zip(t.names, values, strict=True))

    def names(self) -> tuple[str, ...]:
        return tuple(self.text() for _ in range(self.count()))

    def model(self) -> Model:
        from ..model import ModelBuilder

        self.node(0)
        b = ModelBuilder(self.text(), self.text())
        for _ in range(self.count()):
            key, name, optional = self.text(), self.text(), bool(self.byte(1))
            b._fields.append(FieldDef(key, name, self.type(1), "optional" if optional else "required"))
        if identity := self.names():
            b.identity(*identity)
        b._uniques = [self.names() for _ in range(self.count())]
        b._references = [Reference(self.text(), self.names(), self.names()) for _ in range(self.count())]
        for _ in range(self.count()):
            key, name, target, card = self.text(), self.text(), self.text(), _CARDINALITY[self.byte(2)]
            b._relations.append(Relation(key, name, target, card, tuple(zip(self.names(), self.names(), strict=False))))  # type: ignore[arg-type]
        return b.freeze()

    def end(self) -> None:
        if self.at != len(self.data):
            raise _fail("bytes are left over")


def _frame(kind: int, w: _Writer) -> bytes:
    if HEADER + len(w.out) > w.limits.total_bytes:
        raise _fail("frame exceeds the byte limit")
    return MAGIC + struct.pack(">HHBBHQ", MAJOR, MINOR, kind, 0, 0, len(w.out)) + bytes(w.out)


def _open(data: bytes, kind: int, limits: WireLimits) -> _Reader:
    if len(data) > limits.total_bytes or len(data) < HEADER:
        raise _fail("frame is too long or too short")
    if data[:4] != MAGIC:
        raise _fail("not a frame")
    major, minor, found, flags, reserved, n = struct.unpack(">HHBBHQ", data[4:HEADER])
    if major != MAJOR or minor > MINOR:
        raise _fail("unsupported version")
    if found != kind or flags or reserved or n != len(data) - HEADER:
        raise _fail("header does not fit the frame")
    return _Reader(data[HEADER:], limits)


def encode_type(t: Type, limits: WireLimits = WireLimits()) -> bytes:
    w = _Writer(limits)
    w.type(replace(t.validate(), stored="").bare())
    return _frame(TYPE, w)


def decode_type(data: bytes, limits: WireLimits = WireLimits()) -> Type:
    r = _open(data, TYPE, limits)
    t = r.type()
    r.end()
    return t.validate()


def encode_datum(value: Any, t: Type, optional: bool = False, limits: WireLimits = WireLimits()) -> bytes:
    value = check(value, t, "optional" if optional else "required")
    w = _Writer(limits)
    w.type(t.validate().bare())
    w.byte(optional)
    w.datum(value, t)
    return _frame(DATUM, w)


def decode_datum(data: bytes, limits: WireLimits = WireLimits()) -> tuple[Any, Type, bool]:
    r = _open(data, DATUM, limits)
    t = r.type().validate()
    optional = bool(r.byte(1))
    v = r.datum(t)
    r.end()
    check(v, t, "optional" if optional else "required")
    return v, t, optional


def encode_model(m: Model, limits: WireLimits = WireLimits()) -> bytes:
    w = _Writer(limits)
    w.model(m)
    return _frame(MODEL, w)


def decode_model(data: bytes, limits: WireLimits = WireLimits()) -> Model:
    r = _open(data, MODEL, limits)
    m = r.model()
    r.end()
    return m


def encode_models(models: ModelSet, limits: WireLimits = WireLimits()) -> bytes:
    w = _Writer(limits)
    w.u32(len(models.models))
    for m in models:
        w.model(m)
    return _frame(MODEL_SET, w)


def decode_models(data: bytes, limits: WireLimits = WireLimits()) -> ModelSet:
    r = _open(data, MODEL_SET, limits)
    found = [r.model() for _ in range(r.count())]
    r.end()
    if [m.key for m in found] != sorted(m.key for m in found):
        raise _fail("models are not in canonical order")
    return ModelSet(*found)
