"""Tokens of the pipe language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from sluice.lang.diagnostics import LEXER, QueryError

#: Suffixes of timespan literals, in ticks of 100 ns.
TICKS = {
    "d": 864_000_000_000, "day": 864_000_000_000, "days": 864_000_000_000,
    "h": 36_000_000_000, "hr": 36_000_000_000, "hrs": 36_000_000_000, "hour": 36_000_000_000, "hours": 36_000_000_000,
    "m": 600_000_000, "min": 600_000_000, "minute": 600_000_000, "minutes": 600_000_000,
    "s": 10_000_000, "sec": 10_000_000, "second": 10_000_000, "seconds": 10_000_000,
    "ms": 10_000, "milli": 10_000, "millis": 10_000, "millisecond": 10_000, "milliseconds": 10_000,
    "microsecond": 10, "microseconds": 10, "micro": 10, "micros": 10,
    "tick": 1, "ticks": 1,
}

#: Names whose parentheses hold a literal instead of expressions.
TYPED = {"datetime", "date", "timespan", "time", "guid", "uuid", "uniqueid", "dynamic"}
#: The same, if what they hold is a plain literal.
TYPED_PLAIN = {"bool", "boolean", "int", "long", "int64", "real", "double", "decimal"}

_SPACE = re.compile(r"(?:[\s﻿​]+|//[^\n]*)+")
_NAME = re.compile(r"[^\W\d]\w*|\$\w+|_\w*")
_SPAN = re.compile(r"(\d+(?:\.\d+)?)(" + "|".join(sorted(TICKS, key=len, reverse=True)) + r")\b")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+")
_NEGATED = re.compile(r"!(in~|in|between|[a-z]+_cs|has|hasprefix|hassuffix|contains|startswith|endswith|like|likecs)(?![\w])")
_SYMBOL = re.compile(r"\.\.|=>|==|!=|<>|<=|>=|=~|!~|[-+*/%<>=(){}\[\],;|.:?@#&~!]")
_PLAIN = re.compile(r"\s*(null|true|false|[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?:(?<=real\()|(?<=double\())(?:nan|[-+]?inf))\s*\)", re.I)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, string, long, real, timespan, typed, symbol, end
    text: str
    at: int
    end: int
    value: Any = None

    def is_(self, *texts: str) -> bool:
        return self.kind in ("symbol", "name") and self.text in texts


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "ux" and len(x) > 1:
            return chr(int(x[1:], 16))
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, body, flags=re.S)


def _string(text: str, at: int) -> tuple[str, int] | None:
    """Value and end of the string literal at a place, or None."""
    start = at
    if text[at] in "hH" and at + 1 < len(text) and text[at + 1] in "\"'@":
        at += 1
    for fence in ("```", "~~~"):
        if text.startswith(fence, at):
            end = text.find(fence, at + 3)
            if end < 0:
                raise QueryError(LEXER, "unterminated string", text, start)
            return text[at + 3 : end], end + 3
    verbatim = text[at] == "@" and text[at + 1 : at + 2] in ("'", '"')
    at += verbatim
    quote = text[at] if at < len(text) else ""
    if quote not in ("'", '"') or not quote:
        return None
    m = re.compile(f"(?:[^{quote}]|{quote}{quote})*{quote}" if verbatim else rf"(?:[^\\{quote}\n]|\\.)*{quote}", re.S).match(text, at + 1)
    if not m:
        raise QueryError(LEXER, "unterminated string", text, start)
    body = m[0][:-1]
    return (body.replace(quote * 2, quote) if verbatim else _unescape(body)), m.end()


def _balanced(text: str, at: int) -> int:
    """The place of the parenthesis that closes the one before `at`; strings are skipped."""
    depth, i = 1, at
    while i < len(text):
        c = text[i]
        if c in "\"'" and (s := _string(text, i)):
            i = s[1]
            continue
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i
        i += 1
    raise QueryError(LEXER, "unclosed parenthesis", text, at)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while True:
        if m := _SPACE.match(text, at):
            at = m.end()
        if at >= len(text):
            out.append(Token("end", "", at, at))
            return out
        c = text[at]
        if c in "\"'@hH`~" and (s := _string(text, at)):
            out.append(Token("string", text[at : s[1]], at, s[1], s[0]))
        elif (m := _NAME.match(text, at)) and m[0]:
            word, end = m[0], m.end()
            low = word.lower()
            after = re.compile(r"\s*\(").match(text, end)
            if low == "in" and text[end : end + 1] == "~":
                out.append(Token("name", "in~", at, end + 1))
            elif low == "matches" and (r := re.compile(r"\s+regex\b").match(text, end)):
                out.append(Token("name", "matches regex", at, r.end()))
            elif after and low in TYPED and not (out and out[-1].is_(".")) and (low != "time" or not re.match(r"\s*\w+\s*[,)]", text[after.end() :])):
                close = _balanced(text, after.end())
                out.append(Token("typed", low, at, close + 1, text[after.end() : close].strip()))
            elif after and low in TYPED_PLAIN and (p := _PLAIN.match(text, after.end())):
                out.append(Token("typed", low, at, p.end(), p[1]))
            else:
                out.append(Token("name", word, at, end))
        elif m := _SPAN.match(text, at):
            whole, dot, part = m[1].partition(".")
            unit = TICKS[m[2]]
            ticks = int(whole) * unit + (int(part) * unit // 10 ** len(part) if dot else 0)
            out.append(Token("timespan", m[0], at, m.end(), ticks))
        elif m := _NUMBER.match(text, at):
            raw = m[0]
            if raw[:2] in ("0x", "0X"):
                out.append(Token("long", raw, at, m.end(), int(raw, 16)))
            elif re.fullmatch(r"\d+", raw):
                out.append(Token("long", raw, at, m.end(), int(raw)))
            else:
                out.append(Token("real", raw, at, m.end(), float(raw)))
        elif m := _NEGATED.match(text, at):
            out.append(Token("name", m[0], at, m.end()))
        elif m := _SYMBOL.match(text, at):
            out.append(Token("symbol", m[0], at, m.end()))
        elif c == "\\":  # stray continuations; quotes that were escaped once too often
            quote = text[at : at + 2]
            end = text.find(quote, at + 2) if quote[1:] in ("'", '"') else -1
            if end < 0:
                at += 1
                continue
            out.append(Token("string", text[at : end + 2], at, end + 2, text[at + 2 : end]))
        else:
            raise QueryError(LEXER, f"unexpected character {c!r}", text, at)
        at = out[-1].end
