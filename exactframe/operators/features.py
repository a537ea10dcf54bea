"""Named feature values, bounded in number and size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..errors import ExactError
from .vector import check_vector


@dataclass(frozen=True)
class FeatureLimits:
    features: int = 4096
    name_bytes: int = 256
    category_bytes: int = 4096


class FeatureSet:
    """Unique names to numbers, booleans, categories or vectors, in the order of the names."""

    def __init__(self, limits: FeatureLimits = FeatureLimits()):
        self.limits = limits
        self._values: dict[str, float | bool | str | list[float]] = {}

    def insert(self, name: str, value: float | bool | str | list[float]) -> FeatureSet:
        if not name or len(name.encode()) > self.limits.name_bytes:
            raise ExactError("ML-FEATURE-001", "a feature needs a name, and not too long a one")
        if isinstance(value, list):
            check_vector(value)
        elif isinstance(value, str):
            if len(value.encode()) > self.limits.category_bytes:
                raise ExactError("ML-FEATURE-003", "the text of a category is too long")
        elif not isinstance(value, bool) and not math.isfinite(value):
            raise ExactError("ML-FEATURE-002", "a numeric feature is a finite number")
        if name in self._values:
            raise ExactError("ML-FEATURE-004", f"{name} is given twice")
        if len(self._values) >= self.limits.features:
            raise ExactError("ML-FEATURE-005", "there are more features than allowed")
        self._values[name] = value
        return self

    def items(self) -> list[tuple[str, float | bool | str | list[float]]]:
        return sorted(self._values.items())
