"""Syntax trees: expressions, operators with named parts, statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass
class Literal(Expr):
    kind: str  # string long int real decimal bool datetime timespan guid dynamic null
    value: Any


@dataclass
class Name(Expr):
    name: str


@dataclass
class Star(Expr):
    pass


@dataclass
class Pattern(Expr):
    """A column name with wildcards."""

    text: str


@dataclass
class Member(Expr):
    object: Expr
    name: str


@dataclass
class Index(Expr):
    object: Expr
    index: Expr


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]


@dataclass
class Unary(Expr):
    op: str
    operand: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class Among(Expr):
    """in, has_any, has_all and their kin."""

    op: str
    operand: Expr
    items: list[Expr]


@dataclass
class Between(Expr):
    negated: bool
    operand: Expr
    low: Expr
    high: Expr


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class Named(Expr):
    names: list[str]  # several for (a, b) = e
    value: Expr


@dataclass
class Sub(Expr):
    """A pipeline in the place of an expression."""

    pipeline: Pipeline


@dataclass
class Datatable(Expr):
    schema: list[tuple[str, str]]
    values: list[Expr]


@dataclass
class Op:
    name: str
    parts: dict[str, Any] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    at: int = 0


@dataclass
class Pipeline:
    source: Expr | None  # None: the first operator makes rows
    ops: list[Op]


@dataclass
class Lambda:
    params: list[tuple[str, str, Expr | None]]
    body: Script


@dataclass
class Let:
    name: str
    value: Any  # Pipeline (whose source may be a scalar) or Lambda


@dataclass
class SetOption:
    name: str
    value: Any


@dataclass
class Parameters:
    items: list[tuple[str, str, Expr | None]]


@dataclass
class Ignored:
    what: str


@dataclass
class Script:
    statements: list[Any]
