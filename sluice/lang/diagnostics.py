"""Diagnostics with stable codes."""

from __future__ import annotations

from dataclasses import dataclass

#: The codes and what they stand for.
LEXER = "KQL000"
UNKNOWN_COLUMN = "KQL001"
TYPE_MISMATCH = "KQL002"
UNKNOWN_FUNCTION = "KQL003"
ARITY = "KQL004"
SYNTAX = "KQL005"
PARAMETER = "KQL006"
SCOPE = "KQL007"
MISSING = "KQL008"
TRANSLATION = "KQL200"
UNSUPPORTED = "KQL201"

WARNINGS = {TYPE_MISMATCH, UNKNOWN_FUNCTION, ARITY}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    line: int = 0
    column: int = 0

    @property
    def severity(self) -> str:
        return "warning" if self.code in WARNINGS else "error"

    def __str__(self) -> str:
        at = f" ({self.line}:{self.column})" if self.line else ""
        return f"{self.code}{at}: {self.message}"


class QueryError(ValueError):
    """A query that cannot be lexed, parsed or compiled."""

    def __init__(self, code: str, message: str, text: str | None = None, position: int | None = None):
        line = column = 0
        if text is not None and position is not None:
            line = text.count("\n", 0, position) + 1
            column = position - (text.rfind("\n", 0, position) + 1) + 1
        self.diagnostic = Diagnostic(code, message, line, column)
        super().__init__(str(self.diagnostic))

    @property
    def code(self) -> str:
        return self.diagnostic.code


def unsupported(what: str) -> QueryError:
    return QueryError(UNSUPPORTED, f"{what} is not supported")
