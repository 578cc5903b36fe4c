"""One exception class; its code says what went wrong."""

from __future__ import annotations

from enum import Enum


class Code(Enum):
    INVALID_REQUEST = "invalid request"
    WHERE = "where clause"
    UNSUPPORTED = "unsupported"
    NOT_FOUND = "not found"
    AMBIGUOUS = "ambiguous name"
    READ_FAILED = "read failed"
    CORRUPT = "corrupt data"
    SOURCE_CHANGED = "source changed"
    RESULT_LIMIT = "result limit exceeded"
    MEMORY_LIMIT = "memory limit exceeded"
    CANCELLED = "cancelled"
    DEADLINE = "deadline exceeded"
    INVALID_GEOMETRY = "invalid geometry"


class EngineError(Exception):
    def __init__(self, code: Code, message: str):
        super().__init__(f"{code.value}: {message}")
        self.code = code


class WhereError(EngineError):
    def __init__(self, message: str):
        super().__init__(Code.WHERE, message)
