"""One exception for all rejected definitions, plans and data."""

from __future__ import annotations


class ExactError(ValueError):
    """``code`` is stable; the message is for people."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message
