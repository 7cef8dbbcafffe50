"""The step machine of the scan operator, in plain Python; it is sent to the executors."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

from sluice.lang import ast as A
from sluice.lang.diagnostics import unsupported


def evaluate(e: A.Expr, row: dict, steps: dict[str, dict | None]) -> Any:
    """An expression over Python values; null in, null out."""
    if isinstance(e, A.Literal):
        return dt.timedelta(microseconds=e.value / 10) if e.kind == "timespan" and isinstance(e.value, int) else e.value
    if isinstance(e, A.Name):
        if e.name in row:
            return row[e.name]
        low = {k.lower(): v for k, v in row.items()}
        return low.get(e.name.lower())
    if isinstance(e, A.Member):
        if isinstance(e.object, A.Name) and e.object.name in steps:
            matched = steps[e.object.name]
            return None if matched is None else matched.get(e.name)
        raise unsupported("member access in scan")
    if isinstance(e, A.Unary):
        v = evaluate(e.operand, row, steps)
        return None if v is None else -v if e.op == "-" else v
    if isinstance(e, A.Between):
        v, a, b = (evaluate(x, row, steps) for x in (e.operand, e.low, e.high))
        return None if v is None or a is None or b is None else (a <= v <= b) != e.negated
    if isinstance(e, A.Binary):
        if e.op in ("and", "or"):
            a = evaluate(e.left, row, steps)
            if e.op == "and" and not a or e.op == "or" and a:
                return bool(a)
            return bool(evaluate(e.right, row, steps))
        a, b = evaluate(e.left, row, steps), evaluate(e.right, row, steps)
        if a is None or b is None:
            return None
        return _BINARY[e.op](a, b)
    if isinstance(e, A.Call):
        name = e.name.lower()
        args = [evaluate(a, row, steps) for a in e.args]
        if name in ("iff", "iif"):
            return args[1] if args[0] else args[2]
        if name == "case":
            return next((v for t, v in zip(args[:-1:2], args[1::2], strict=False) if t), args[-1])
        if name in _CALLS:
            return _CALLS[name](*args)
    raise unsupported(f"{type(e).__name__} in scan")


def _divide(a, b):
    if b == 0:
        return None
    return int(a / b) if isinstance(a, int) and isinstance(b, int) else a / b


_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "%": lambda a, b: a % b if b else None,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "=~": lambda a, b: str(a).lower() == str(b).lower(), "!~": lambda a, b: str(a).lower() != str(b).lower(),
    "has": lambda a, b: str(b).lower() in str(a).lower(), "contains": lambda a, b: str(b).lower() in str(a).lower(),
    "startswith": lambda a, b: str(a).lower().startswith(str(b).lower()), "endswith": lambda a, b: str(a).lower().endswith(str(b).lower()),
    "matches regex": lambda a, b: re.search(b, a) is not None,
}
_CALLS = {
    "isnull": lambda v: v is None, "isnotnull": lambda v: v is not None, "isempty": lambda v: v in (None, ""), "isnotempty": lambda v: v not in (None, ""), "not": lambda v: not v,
    "coalesce": lambda *v: next((x for x in v if x is not None), None), "abs": lambda v: None if v is None else abs(v), "strcat": lambda *v: "".join("" if x is None else str(x) for x in v),
    "max_of": lambda *v: max((x for x in v if x is not None), default=None), "min_of": lambda *v: min((x for x in v if x is not None), default=None),
    "tostring": lambda v: None if v is None else str(v), "tolong": lambda v: None if v is None else int(v), "toreal": lambda v: None if v is None else float(v),
}


@dataclass
class State:
    active: list[dict[str, dict | None] | None] = field(default_factory=list)  # for each step its match so far
    ids: list[int | None] = field(default_factory=list)
    next_id: int = 0


class Machine:
    """A row is tried at the last step first; at step k it goes on with the state of k itself or of k - 1."""

    def __init__(self, columns: list[str], declared: list[tuple[str, Any]], steps: list[dict], match_id: bool):
        self.columns, self.declared, self.steps, self.match_id = columns, declared, steps, match_id

    def start(self) -> State:
        return State([None] * len(self.steps), [None] * len(self.steps))

    def feed(self, state: State, values: tuple) -> list[tuple]:
        row = dict(zip(self.columns, values, strict=True))
        blank = dict(self.declared)
        out = []
        for k in reversed(range(len(self.steps))):
            step = self.steps[k]
            for source in (k, k - 1):
                if source >= 0 and state.active[source] is None:
                    continue
                if source == k - 1 and k == 0:
                    matches = {s["name"]: dict(blank) for s in self.steps}
                elif source < 0:
                    continue
                else:
                    matches = {n: dict(m) for n, m in state.active[source].items()}
                if not evaluate(step["condition"], row | self._own(matches, step), matches):
                    continue
                own = dict(blank) | {n: v for n, v in (matches.get(step["name"]) or {}).items() if n in blank}
                for a in step["assign"]:
                    own[a.names[0]] = evaluate(a.value, row | own, matches)
                matches[step["name"]] = row | own
                number = state.ids[source] if source >= 0 and state.ids[source] is not None and source != -1 else None
                if number is None:
                    number, state.next_id = state.next_id, state.next_id + 1
                if source == k - 1 and source >= 0:
                    state.active[source], state.ids[source] = None, None
                state.active[k], state.ids[k] = matches, number
                if step["output"] != "none" and (step["output"] != "last" or k == len(self.steps) - 1):
                    out.append((*values, *[own[n] for n, _ in self.declared], *([number] if self.match_id else [])))
                break
        return out

    def _own(self, matches: dict, step: dict) -> dict:
        mine = matches.get(step["name"]) or {}
        return {n: mine.get(n, d) for n, d in self.declared}
