"""Fingerprints: equal for pipelines that mean the same by construction."""

from __future__ import annotations

import hashlib
from typing import Any

from ..expr import Expr
from ..model import Model
from ..types import Type
from .pipeline import Aggregate, Pipeline, Rows, Selected, Window


def fingerprint(x: Any) -> str:
    """Aliases of sources are left out; the inputs of union, union_all and intersect commute, those of except do not."""
    return _digest(x, {}).hex()


def exact_key(x: Any) -> str:
    """Equal only for pipelines that give the same rows under the same names: aliases, the order of inputs and a function's code count."""
    return _digest(x, {}, exact=True).hex()


def _hash(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=32)
    for p in parts:
        h.update(len(p).to_bytes(8, "big"))
        h.update(p)
    return h.digest()


def _digest(x: Any, seen: dict[int, bytes], exact: bool = False) -> bytes:
    if isinstance(x, Pipeline | Expr):
        todo: list[tuple[Any, bool]] = [(x, False)]
        while todo:
            n, ready = todo.pop()
            if id(n) in seen:
                continue
            below = n.inputs if isinstance(n, Pipeline) else n.args
            if not ready:
                todo.append((n, True))
                todo += [(b, False) for b in below]
                continue
            inner = [seen[id(b)] for b in below]
            if isinstance(n, Pipeline) and n.op == "set" and n.data[0] != "except" and not exact:
                inner.sort()
            data = n.data[:1] if n.op == "source" and not exact else n.data
            kind = _digest(n.type, seen, exact) if isinstance(n, Expr) else b""
            seen[id(n)] = _hash(type(n).__name__.encode(), n.op.encode(), kind, *inner, *(_digest(d, seen, exact) for d in data))
        return seen[id(x)]
    if isinstance(x, Aggregate | Window):
        fields = [x.kind, x.input, x.present] + ([x.partition, x.order, x.rows] if isinstance(x, Window) else [])
        return _hash(type(x).__name__.encode(), *(_digest(f, seen, exact) for f in fields))
    if isinstance(x, Selected):
        return _hash(b"selected", x.kind.encode(), *(n.encode() for n in x.names), *(_digest(p, seen, exact) for p in x.parts))
    if isinstance(x, tuple | list):
        return _hash(b"tuple", *(_digest(i, seen, exact) for i in x))
    if isinstance(x, Model):
        names = [f.name.encode() for f in x.fields] if exact else []
        return _hash(b"model", x.key.encode(), *(_hash(f.key.encode(), f.presence.encode(), _digest(f.type, seen, exact)) for f in x.fields), *names)
    if isinstance(x, Type):
        return _hash(b"type", x.name.encode(), str((x.version, x.null, sorted(x.without), x.precision, x.scale)).encode(), *(_digest(p, seen, exact) for p in x.parts))
    if isinstance(x, float) and not exact:
        x = 0.0 if x == 0 else x
    if hasattr(x, "key") and hasattr(x, "version"):
        code = f"#{id(x.build)}" if exact and hasattr(x, "build") else ""
        return _hash(b"function", f"{x.key}@{x.version}{code}".encode())
    if isinstance(x, Rows) or x is None or isinstance(x, str | int | float | bytes | bool):
        return _hash(type(x).__name__.encode(), repr(x).encode())
    return _hash(type(x).__name__.encode(), str(x).encode())
