"""Built-in functions as Spark columns, and the registry of a caller's own."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExactError
from ..types import Type

if TYPE_CHECKING:
    from ..expr import Expr

_SPACE = r"\p{IsWhite_Space}+"

BUILT_IN: dict[str, Callable[..., Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "trim": lambda c: F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", ""),
    "trim_start": lambda c: F.regexp_replace(c, f"^{_SPACE}", ""),
    "trim_end": lambda c: F.regexp_replace(c, f"{_SPACE}$", ""),
    "contains": F.contains,
    "starts_with": F.startswith,
    "ends_with": F.endswith,
    "len": lambda c: F.octet_length(c).cast("long"),
    "scalar_len": lambda c: F.char_length(c).cast("long"),
    "year": F.year,
    "month": lambda c: F.month(c).cast("byte"),
    "day": lambda c: F.dayofmonth(c).cast("short"),
    "ordinal": F.dayofyear,
    "weekday": lambda c: (F.weekday(c) + 1).cast("byte"),
    "date": F.to_date,
    # nanoseconds of the day
    "time": lambda c: (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long") * 1000,
    "unix_timestamp": F.unix_seconds,
    "whole_seconds": lambda c: F.call_function("div", c, F.lit(1_000_000_000)),
}


@dataclass(frozen=True)
class SemanticFunction:
    """A scalar, deterministic function of one or two arguments. ``build`` makes a column of columns: built-in functions, or an Arrow or pandas UDF."""

    key: str
    version: int
    takes: tuple[Type, ...]
    gives: Type
    build: Callable[..., Column] = field(compare=False)
    deterministic: bool = True
    depends: tuple[tuple[str, int], ...] = ()

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[^\s/]+(/[^\s/]+)+", self.key):
            raise ExactError("EXPR-FUNC-001", "a function is called like org.example/name")
        if self.version <= 0:
            raise ExactError("EXPR-FUNC-002", "versions of functions begin at 1")
        if any(not n or v <= 0 for n, v in self.depends):
            raise ExactError("EXPR-FUNC-003", "what a function depends on has a name and a version from 1")
        if self.key.startswith("core/"):
            raise ExactError("EXPR-FUNC-005", "names under core/ are the language's own")
        if not self.deterministic:
            raise ExactError("EXPR-FUNC-006", "a function must give the same for the same arguments")
        if len(self.takes) not in (1, 2):
            raise ExactError("EXPR-FUNCTION-001", "a function takes one or two arguments")

    def result_type(self, args: tuple[Expr, ...]) -> Type:
        if len(args) != len(self.takes):
            raise ExactError("EXPR-FUNCTION-001", f"function {self.key} takes {len(self.takes)} arguments")
        for a, ty in zip(args, self.takes, strict=True):
            if not a.type.non_null().same(ty.non_null()):
                raise ExactError("EXPR-TYPE-008", f"argument of {self.key} has type {a.type.name}, not {ty.name}")
        return self.gives.nullable() if any(a.type.null for a in args) and self.gives.kind != "truth" else self.gives
