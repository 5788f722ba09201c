"""Errors that a caller can act on: a code for scripts, a message and a hint."""

from __future__ import annotations

OK, GENERAL, USER, NOT_FOUND, PARTIAL = range(5)


class CorpusError(Exception):
    def __init__(self, code: int, message: str, hint: str = ""):
        super().__init__(message)
        self.code, self.message, self.hint = code, message, hint
