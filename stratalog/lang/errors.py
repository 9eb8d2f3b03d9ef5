"""Errors with stable codes."""

from __future__ import annotations


class DatalogError(Exception):
    """``code`` is stable; ``where`` is ``source:line:column`` when it is known."""

    def __init__(self, code: str, message: str, where: str = ""):
        super().__init__(f"{where + ': ' if where else ''}[{code}] {message}")
        self.code, self.message, self.where = code, message, where
