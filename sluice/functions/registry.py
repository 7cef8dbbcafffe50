"""The function registry: name -> Spec. Each family module registers its functions when it is imported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from typing import Any

from pyspark.sql import types as T

from sluice.plans.expr import E, compile_expr


@dataclass(frozen=True)
class Spec:
    name: str
    least: int
    most: int | None
    kind: str  # B built-in, C composed, W row order, U Arrow UDF, M session, X unsupported, aggregate
    build: Callable[[Any, Any], E]


_SPECS: dict[str, Spec] = {}


def put(names: str, least: int, most: int | None, kind: str, build: Callable) -> None:
    for name in names.split():
        _SPECS[name] = Spec(name, least, most, kind, build)


def function(names: str, least: int, most: int | None = -1, kind: str = "C"):
    """Register build(ctx, args) of compiled arguments; most -1: as many as least."""

    def register(build):
        def run(ctx, call):
            return build(ctx, [compile_expr(ctx, a) for a in call.args])

        put(names, least, least if most == -1 else most, kind, run)
        return build

    return register


def raw(names: str, least: int, most: int | None = -1, kind: str = "C"):
    """Register build(ctx, call) of the syntax tree."""

    def register(build):
        put(names, least, least if most == -1 else most, kind, build)
        return build

    return register


def unsupported(names: str) -> None:
    put(names, 0, None, "X", lambda ctx, call: None)


def cols(table: dict[str, Callable], count: int = 1, result: T.DataType | None = None, kind: str = "B", prepare: Callable | None = None) -> None:
    """Functions of columns alone, of so many arguments."""
    for names, build in table.items():
        def run(ctx, args, build=build):
            return E(build(*[prepare(ctx, a) if prepare else a.column for a in args]), result)

        function(names, count, kind=kind)(run)


@cache
def _load() -> None:
    from sluice.functions import aggregates, arrays, conversion, datetimes, encoding, geo, maths, network, rowwise, series, session, strings  # noqa: F401


def find(name: str) -> Spec | None:
    _load()
    return _SPECS.get(name.lower())


def names() -> list[str]:
    _load()
    return sorted(_SPECS)
