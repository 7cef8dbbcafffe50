"""Recursive descent over the tokens of a script.

Operators are parsed by the functions in OPERATORS, by name; each fills an Op's parts. An operator that nobody knows, or
whose text cannot be read, is an error at its place.
"""

from __future__ import annotations

from collections.abc import Callable

from sluice.lang.ast import (
    Among, Between, Binary, Call, Datatable, Expr, Ignored, Index, Lambda, Let, ListOf, Literal, Member, Name, Named, Op,
    Parameters, Pattern, Pipeline, Script, SetOption, Star, Sub, Unary,
)
from sluice.lang.diagnostics import SYNTAX, QueryError
from sluice.lang.lexer import Token, tokens

_STRING_OPS = {
    "has", "hasprefix", "hassuffix", "contains", "startswith", "endswith", "like", "likecs", "has_cs", "hasprefix_cs", "hassuffix_cs",
    "contains_cs", "startswith_cs", "endswith_cs",
}
STRING_OPS = _STRING_OPS | {f"!{op}" for op in _STRING_OPS} | {"matches regex", "=~", "!~", ":"}
AMONG = {"in", "!in", "in~", "!in~", "has_any", "has_all"}
HEADS = {"union", "print", "range", "find", "search", "externaldata", "evaluate"}


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = tokens(text)
        self.i = 0

    # ---- tokens -----------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def fail(self, what: str, token: Token | None = None) -> QueryError:
        token = token or self.now
        return QueryError(SYNTAX, f"{what}, found {token.text or 'the end'!r}", self.text, token.at)

    def take(self) -> Token:
        t = self.now
        self.i += 1
        return t

    def sees(self, *texts: str) -> bool:
        return self.now.is_(*texts)

    def word(self, *words: str) -> bool:
        return self.now.kind == "name" and self.now.text.lower() in words

    def accept(self, *texts: str) -> bool:
        if self.sees(*texts) or self.word(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not (self.sees(text) or self.word(text)):
            raise self.fail(f"expected {text!r}")
        return self.take()

    def name(self, what: str = "a name") -> str:
        t = self.now
        if t.kind == "name":
            return self.take().text
        if t.kind == "typed" and t.value == "":
            return self.take().text
        if self.sees("[") and self.ahead().kind == "string" and self.ahead(2).is_("]"):
            value = self.ahead().value
            self.i += 3
            return value
        raise self.fail(f"expected {what}")

    def hyphenated(self) -> str:
        """A name with hyphens that touch its parts."""
        first = self.take()
        text, end = first.text, first.end
        while self.sees("-") and self.now.at == end and self.ahead().kind == "name" and self.ahead().at == self.now.end:
            self.i += 1
            part = self.take()
            text, end = f"{text}-{part.text}", part.end
        return text.lower()

    def pattern(self) -> Expr:
        """A column name, perhaps with wildcards."""
        if self.sees("["):
            return Name(self.name())
        start = self.now
        if not (start.kind == "name" or self.sees("*")):
            raise self.fail("expected a column")
        text, end = "", start.at
        while (self.now.kind == "name" or self.sees("*")) and self.now.at == end:
            t = self.take()
            text, end = text + t.text, t.end
        return Pattern(text) if "*" in text else Name(text)

    def listed(self, item: Callable, closing: tuple[str, ...] = ()) -> list:
        out = []
        if closing and self.sees(*closing):
            return out
        out.append(item())
        while self.accept(","):
            if closing and self.sees(*closing):
                break
            out.append(item())
        return out

    # ---- statements -------------------------------------------------------------------------------------------

    def script(self, closing: str = "") -> Script:
        out = []
        while self.now.kind != "end" and not (closing and self.sees(closing)):
            if self.accept(";"):
                continue
            out.append(self.statement())
            if not (self.now.kind == "end" or self.sees(";") or (closing and self.sees(closing))):
                raise self.fail("expected an operator or the end of the statement")
        return Script(out)

    def statement(self):
        if self.word("let") and self.ahead().kind == "name":
            self.take()
            name = self.name()
            self.need("=")
            return Let(name, self.let_value())
        if self.word("set") and self.ahead().kind == "name":
            self.take()
            name = self.name()
            value = self.expression() if self.accept("=") else True
            return SetOption(name, value)
        if self.word("declare"):
            self.take()
            if self.accept("query_parameters"):
                self.need("(")
                items = self.listed(self.parameter, (")",))
                self.need(")")
                return Parameters(items)
            return self.skip("declare")
        if self.word("alias", "restrict") and self.ahead().kind == "name":
            return self.skip(self.now.text)
        return self.pipeline()

    def skip(self, what: str) -> Ignored:
        depth = 0
        while self.now.kind != "end" and not (depth == 0 and self.sees(";")):
            depth += self.sees("(", "{") - self.sees(")", "}")
            self.take()
        return Ignored(what)

    def parameter(self) -> tuple[str, str, Expr | None]:
        name = self.name()
        kind = "dynamic"
        if self.accept(":"):
            if self.accept("("):
                depth = 1
                while depth:
                    depth += self.sees("(") - self.sees(")")
                    if self.take().kind == "end":
                        raise self.fail("expected ')'")
                kind = "table"
            else:
                kind = self.take().text.lower()
        return name, kind, self.expression() if self.accept("=") else None

    def let_value(self):
        if self.word("view") and self.ahead().is_("("):
            self.take()
        if self.sees("(") and (found := self.attempt(self.lambda_)) is not None:
            return found
        if self.sees("{"):
            return self.lambda_body([])
        return self.pipeline()

    def attempt(self, parse: Callable):
        at = self.i
        try:
            return parse()
        except QueryError:
            self.i = at
            return None

    def lambda_(self) -> Lambda:
        self.need("(")
        params = self.listed(self.parameter, (")",))
        self.need(")")
        if not self.sees("{"):
            raise self.fail("expected '{'")
        return self.lambda_body(params)

    def lambda_body(self, params: list) -> Lambda:
        self.need("{")
        body = self.script("}")
        self.need("}")
        return Lambda(params, body)

    # ---- pipelines --------------------------------------------------------------------------------------------

    def pipeline(self, closing: tuple[str, ...] = ()) -> Pipeline:
        if self.accept("|"):
            self.i -= 1
            return Pipeline(None, self.operators())
        if self.now.kind == "name" and self.now.text.lower() in HEADS and self.is_head():
            first = self.operator()
            return Pipeline(None, [first, *self.operators()])
        source = self.source()
        return Pipeline(source, self.operators())

    def is_head(self) -> bool:
        word, after = self.now.text.lower(), self.ahead()
        if word in ("externaldata", "evaluate", "find", "print", "search"):
            return not after.is_(".", "|", ";", "=", ")") or word == "print" and after.is_("(")
        return after.kind == "name" or after.is_("(", "*") and word == "union" or after.is_("[")

    def source(self) -> Expr:
        wild = self.ahead().is_("*") and self.ahead().at == self.now.end and (self.ahead(2).kind == "end" or self.ahead(2).is_("|", ";", ")", ","))
        if self.now.kind == "name" and wild or self.sees("*"):
            return self.pattern()
        return self.expression()

    def operators(self) -> list[Op]:
        out = []
        while self.accept("|"):
            out.append(self.operator())
        return out

    def operator(self) -> Op:
        at = self.now.at
        if self.now.kind != "name":
            raise self.fail("expected an operator")
        place = self.i
        name = self.hyphenated()
        parse = OPERATORS.get(name)
        if parse is None:
            raise self.fail(f"unknown operator {name!r}", self.tokens[place])
        op = Op(name, at=at)
        parse(self, op)
        return op

    def params(self, op: Op, known: set[str]) -> None:
        """kind=inner, hint.strategy=broadcast and the like."""
        while self.now.kind == "name":
            n, text = 1, self.now.text.lower()
            while self.ahead(n).is_(".") and self.ahead(n + 1).kind == "name":
                text += "." + self.ahead(n + 1).text.lower()
                n += 2
            if not self.ahead(n).is_("=") or text not in known and not text.startswith("hint."):
                return
            self.i += n + 1
            op.params[text] = self.value()

    def value(self):
        t = self.take()
        if t.kind == "name":
            low = t.text.lower()
            return {"true": True, "false": False}.get(low, t.text)
        return t.value

    def sub(self) -> Expr:
        """A table name, a parenthesised pipeline, or a call."""
        if self.accept("("):
            p = self.pipeline()
            self.need(")")
            return Sub(p)
        if self.now.kind == "name" and self.ahead().is_("*") and self.ahead().at == self.now.end or self.sees("*"):
            return self.pattern()
        return self.postfix()

    def named(self) -> Expr:
        """e, n = e or (a, b) = e."""
        if self.sees("(") and (names := self.attempt(self.tuple_names)):
            return Named(names, self.expression())
        if (self.now.kind == "name" or self.now.kind == "typed" and self.now.value == "") and self.ahead().is_("=") or self.sees("[") and self.ahead(2).is_("]") and self.ahead(3).is_("="):
            name = self.name()
            self.need("=")
            return Named([name], self.expression())
        return self.expression()

    def tuple_names(self) -> list[str]:
        self.need("(")
        names = self.listed(self.name, (")",))
        self.need(")")
        self.need("=")
        return names

    def column_types(self) -> list[tuple[str, str]]:
        self.need("(")

        def one() -> tuple[str, str]:
            name = self.name()
            self.need(":")
            return name, self.take().text.lower()

        out = self.listed(one, (")",))
        self.need(")")
        return out

    def sort_keys(self) -> list[tuple[Expr, str | None, str | None]]:
        def one():
            e = self.named()
            way = self.take().text.lower() if self.word("asc", "desc", "granny-asc", "granny-desc") else None
            nulls = None
            if self.accept("nulls"):
                nulls = self.take().text.lower()
            return e, way, nulls

        return self.listed(one)

    # ---- expressions, loosest first ---------------------------------------------------------------------------

    def expression(self) -> Expr:
        left = self.conjunction()
        while self.accept("or"):
            left = Binary("or", left, self.conjunction())
        return left

    def conjunction(self) -> Expr:
        left = self.equality()
        while self.accept("and"):
            left = Binary("and", left, self.equality())
        return left

    def equality(self) -> Expr:
        left = self.relation()
        while True:
            if self.sees("==", "!=", "<>"):
                op = self.take().text
                left = Binary("!=" if op == "<>" else op, left, self.relation())
            elif self.now.kind == "name" and self.now.text.lower() in AMONG:
                op = self.take().text.lower()
                left = Among(op, left, self.among_items())
            elif self.now.kind == "name" and self.now.text.lower() in ("between", "!between"):
                negated = self.take().text.startswith("!")
                self.need("(")
                low = self.additive()
                self.need("..")
                high = self.additive()
                self.need(")")
                left = Between(negated, left, low, high)
            else:
                return left

    def among_items(self) -> list[Expr]:
        if not self.sees("("):
            return [self.additive()]
        self.need("(")
        if self.sees(")"):
            self.take()
            return []
        first = self.pipeline_or_expression()
        out = [first]
        while self.accept(","):
            out.append(self.expression())
        self.need(")")
        return out

    def pipeline_or_expression(self) -> Expr:
        p = self.pipeline()
        return p.source if p.source is not None and not p.ops else Sub(p)

    def relation(self) -> Expr:
        left = self.additive()
        if self.sees("<", ">", "<=", ">="):
            op = self.take().text
            return Binary(op, left, self.additive())
        return left

    def additive(self) -> Expr:
        left = self.multiplicative()
        while self.sees("+", "-"):
            op = self.take().text
            left = Binary(op, left, self.multiplicative())
        return left

    def multiplicative(self) -> Expr:
        left = self.textual()
        while self.sees("*", "/", "%"):
            op = self.take().text
            left = Binary(op, left, self.textual())
        return left

    def textual(self) -> Expr:
        left = self.unary()
        if self.sees("=~", "!~", ":") or self.now.kind == "name" and self.now.text.lower() in STRING_OPS:
            op = self.take().text.lower()
            return Binary("=~" if op == ":" else op, left, self.unary())
        return left

    def unary(self) -> Expr:
        if self.sees("-", "+"):
            op = self.take().text
            return Unary(op, self.unary())
        return self.postfix()

    def postfix(self) -> Expr:
        e = self.primary()
        while True:
            if self.sees(".") and (self.ahead().kind in ("name", "typed") or self.ahead().is_("[")):
                self.take()
                if self.sees("["):
                    self.take()
                    e = Member(e, self.take().value)
                    self.need("]")
                elif self.ahead().is_("(") and self.now.kind == "name" and isinstance(e, Call | Member):
                    e = Call(self.take().text, [e, *self.call_args()])
                else:
                    e = Member(e, self.take().text)
            elif self.sees("[") and self.now.at == self.tokens[self.i - 1].end:
                self.take()
                e = Index(e, self.expression())
                self.need("]")
            else:
                return e

    def call_args(self) -> list[Expr]:
        self.need("(")

        def one() -> Expr:
            if self.sees("*") and self.ahead().is_(",", ")"):
                self.take()
                return Star()
            if self.now.kind == "name" and self.ahead().is_("=") or self.sees("("):
                if (found := self.attempt(self.named)) is not None and self.sees(",", ")"):
                    return found
                raise self.fail("expected ',' or ')'")
            return self.pipeline_or_expression()

        out = self.listed(one, (")",))
        self.need(")")
        return out

    def primary(self) -> Expr:
        t = self.now
        if t.kind in ("string", "long", "real", "timespan"):
            self.take()
            text = t.value
            if t.kind == "string":
                while self.now.kind == "string":  # neighbours are one string
                    text += self.take().value
            return Literal(t.kind, text)
        if t.kind == "typed":
            self.take()
            return typed(t)
        if self.sees("("):
            self.take()
            first = self.pipeline_or_expression()
            if self.accept(","):
                items = [first, *self.listed(self.expression, (")",))]
                self.need(")")
                return ListOf(items)
            self.need(")")
            return first
        if self.sees("["):
            if self.ahead().kind == "string" and self.ahead(2).is_("]"):
                return Name(self.name())
            self.take()
            items = self.listed(self.expression, ("]",))
            self.need("]")
            return ListOf(items)
        if self.sees("*"):
            self.take()
            return Star()
        if self.sees("@") or t.kind == "end":
            raise self.fail("expected an expression")
        if t.kind == "name":
            low = t.text.lower()
            if low in ("true", "false"):
                self.take()
                return Literal("bool", low == "true")
            if low == "null" and not self.ahead().is_("("):
                self.take()
                return Literal("null", None)
            if low == "datatable" and self.ahead().is_("("):
                self.take()
                schema = self.column_types()
                self.need("[")
                values = self.listed(self.expression, ("]",))
                self.need("]")
                return Datatable(schema, values)
            self.take()
            if self.sees("("):
                return Call(t.text, self.call_args())
            return Name(t.text)
        raise self.fail("expected an expression")


def typed(t: Token) -> Literal:
    kind = {"date": "datetime", "time": "timespan", "boolean": "bool", "int64": "long", "double": "real", "uuid": "guid", "uniqueid": "guid"}.get(t.text, t.text)
    raw = t.value
    if raw.lower() == "null" or raw == "" and kind not in ("datetime", "dynamic"):
        return Literal("null", None) if kind == "dynamic" else Literal(kind, None)
    if kind == "bool":
        return Literal(kind, raw.lower() in ("true", "1"))
    if kind in ("int", "long"):
        return Literal(kind, int(raw, 16) if "x" in raw.lower() else int(float(raw)))
    if kind == "real":
        return Literal(kind, float(raw))
    return Literal(kind, raw.strip("\"'") if kind in ("datetime", "timespan", "guid") else raw)


# ---- operators ------------------------------------------------------------------------------------------------------

OPERATORS: dict[str, Callable[[Parser, Op], None]] = {}


def operator(*names: str):
    def register(parse):
        for n in names:
            OPERATORS[n] = parse
        return parse

    return register


@operator("where", "filter")
def _(p: Parser, op: Op) -> None:
    op.parts["predicate"] = p.expression()


@operator("project", "extend", "print")
def _(p: Parser, op: Op) -> None:
    op.parts["columns"] = p.listed(p.named)


@operator("serialize")
def _(p: Parser, op: Op) -> None:
    op.parts["columns"] = [] if p.now.kind == "end" or p.sees("|", ")", ";") else p.listed(p.named)


@operator("project-away", "project-keep")
def _(p: Parser, op: Op) -> None:
    op.parts["columns"] = p.listed(p.pattern)


@operator("project-reorder", "project-smart")
def _(p: Parser, op: Op) -> None:
    def one():
        c = p.pattern()
        return c, p.hyphenated() if p.word("asc", "desc", "granny") else None

    op.parts["columns"] = p.listed(one)


@operator("project-rename")
def _(p: Parser, op: Op) -> None:
    def one():
        new = p.name()
        p.need("=")
        return new, p.name()

    op.parts["columns"] = p.listed(one)


@operator("take", "limit", "sample")
def _(p: Parser, op: Op) -> None:
    op.parts["count"] = p.expression()


@operator("sample-distinct")
def _(p: Parser, op: Op) -> None:
    op.parts["count"] = p.additive()
    p.need("of")
    op.parts["column"] = p.expression()


@operator("distinct")
def _(p: Parser, op: Op) -> None:
    op.parts["columns"] = p.listed(lambda: Star() if p.accept("*") else p.named())


@operator("sort", "order")
def _(p: Parser, op: Op) -> None:
    p.params(op, set())
    p.need("by")
    op.parts["keys"] = p.sort_keys()


@operator("top")
def _(p: Parser, op: Op) -> None:
    op.parts["count"] = p.additive()
    p.need("by")
    op.parts["keys"] = p.sort_keys()


@operator("top-hitters")
def _(p: Parser, op: Op) -> None:
    op.parts["count"] = p.additive()
    p.need("of")
    op.parts["column"] = p.named()
    op.parts["by"] = p.expression() if p.accept("by") else None


@operator("top-nested")
def _(p: Parser, op: Op) -> None:
    def level():
        count = None if p.word("of") else p.additive()
        p.need("of")
        column = p.named()
        others = None
        if p.accept("with"):
            p.need("others")
            p.need("=")
            others = p.expression()
        p.need("by")
        by = p.named()
        way = p.take().text.lower() if p.word("asc", "desc") else "desc"
        return {"count": count, "column": column, "others": others, "by": by, "way": way}

    levels = [level()]
    while p.accept(","):
        p.accept("top-nested")
        if p.word("top") and p.ahead().is_("-"):
            p.i += 3
        levels.append(level())
    op.parts["levels"] = levels


@operator("count", "consume", "getschema")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"decodeblocks", "kind"})
    if p.accept("as"):
        op.parts["as"] = p.name()


@operator("summarize")
def _(p: Parser, op: Op) -> None:
    p.params(op, set())
    op.parts["aggregates"] = [] if p.word("by") else p.listed(p.named)
    op.parts["by"] = p.listed(p.named) if p.accept("by") else []
    if p.word("bin") and p.ahead().is_("="):
        p.i += 2
        op.parts["bin"] = p.expression()


@operator("join")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind", "withsource"})
    op.parts["right"] = p.sub()
    op.parts["on"] = []
    if p.accept("on"):
        op.parts["on"] = p.listed(p.expression)
    elif p.accept("where"):
        op.parts["on"] = [p.expression()]


@operator("lookup")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind"})
    op.parts["right"] = p.sub()
    op.parts["on"] = p.listed(p.expression) if p.accept("on") else []


@operator("union")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind", "withsource", "isfuzzy"})
    op.parts["tables"] = p.listed(p.sub)


@operator("find")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"withsource", "datascope"})
    if p.accept("in"):
        p.need("(")
        op.parts["tables"] = p.listed(p.sub, (")",))
        p.need(")")
    p.accept("where")
    op.parts["predicate"] = p.expression()
    if p.accept("project"):
        def one():
            c = p.pattern()
            if p.accept(":"):
                p.take()
            return c

        op.parts["project"] = p.listed(one)


@operator("search")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind"})
    if p.accept("in"):
        p.need("(")
        op.parts["tables"] = p.listed(p.sub, (")",))
        p.need(")")
    op.parts["predicate"] = p.expression()


@operator("range")
def _(p: Parser, op: Op) -> None:
    op.parts["name"] = p.name()
    p.need("from")
    op.parts["from"] = p.expression()
    p.need("to")
    op.parts["to"] = p.expression()
    p.need("step")
    op.parts["step"] = p.expression()


@operator("externaldata")
def _(p: Parser, op: Op) -> None:
    op.parts["schema"] = p.column_types()
    p.need("[")
    op.parts["uris"] = p.listed(p.expression, ("]",))
    p.need("]")
    op.parts["with"] = with_options(p)


def with_options(p: Parser) -> dict:
    out = {}
    if p.accept("with"):
        p.need("(")

        def one():
            name = p.name()
            while p.accept("."):
                name += "." + p.name()
            p.need("=")
            out[name.lower()] = p.value()

        p.listed(one, (")",))
        p.need(")")
    return out


@operator("as")
def _(p: Parser, op: Op) -> None:
    p.params(op, set())
    op.parts["name"] = p.name()


@operator("invoke", "macro-expand")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"isfuzzy", "kind"})
    if op.name == "macro-expand" and (p.sees("[") or not p.ahead().is_("(")):
        if p.sees("["):
            p.take()
            op.parts["group"] = p.listed(p.sub, ("]",))
            p.need("]")
        else:
            op.parts["group"] = Name(p.name())
        p.need("as")
        op.parts["name"] = p.name()
        p.need("(")
        op.parts["body"] = p.pipeline()
        p.need(")")
        return
    op.parts["function"] = p.name()
    op.parts["args"] = p.call_args() if p.sees("(") else []


@operator("render")
def _(p: Parser, op: Op) -> None:
    op.parts["kind"] = p.name() if p.now.kind == "name" else None
    p.params(op, {"kind", "title", "xcolumn", "ycolumns", "series", "xtitle", "ytitle", "legend", "accumulate", "ysplit", "anomalycolumns", "xaxis", "yaxis", "ymin", "ymax", "xmin", "xmax"})
    op.parts["with"] = with_options(p)


@operator("assert-schema")
def _(p: Parser, op: Op) -> None:
    op.parts["schema"] = p.column_types()


@operator("execute-and-cache")
def _(p: Parser, op: Op) -> None:
    if p.sees("("):
        p.call_args()


@operator("parse", "parse-where")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind", "flags"})
    op.parts["operand"] = p.unary()
    p.need("with")
    items: list[tuple] = []
    while not (p.now.kind == "end" or p.sees("|", ";", ")")):
        if p.accept("*"):
            items.append(("skip",))
        elif p.now.kind == "string":
            items.append(("text", p.take().value))
        else:
            name = p.name("a column or a quoted text")
            kind = p.take().text.lower() if p.accept(":") else "string"
            items.append(("column", name, kind))
    op.parts["pattern"] = items


@operator("parse-kv")
def _(p: Parser, op: Op) -> None:
    op.parts["operand"] = p.unary()
    p.need("as")
    op.parts["keys"] = p.column_types()
    op.parts["with"] = with_options(p)


def _expanded(p: Parser):
    e = p.named()
    kind = None
    if p.accept("to"):
        p.need("typeof")
        p.need("(")
        kind = p.take().text.lower()
        p.need(")")
    return e, kind


@operator("mv-expand", "mvexpand")
def _(p: Parser, op: Op) -> None:
    op.name = "mv-expand"
    p.params(op, {"bagexpansion", "with_itemindex", "kind"})
    op.parts["columns"] = p.listed(lambda: _expanded(p))
    op.parts["limit"] = p.expression() if p.accept("limit") else None


@operator("mv-apply", "mvapply")
def _(p: Parser, op: Op) -> None:
    op.name = "mv-apply"
    p.params(op, {"with_itemindex"})
    op.parts["columns"] = p.listed(lambda: _expanded(p))
    op.parts["limit"] = p.expression() if p.accept("limit") else None
    p.need("on")
    p.need("(")
    op.parts["body"] = body(p)
    p.need(")")


def body(p: Parser) -> list[Op]:
    """Operators applied to what stands before; the first without a pipe."""
    if p.sees("|"):
        return p.operators()
    return [p.operator(), *p.operators()]


@operator("evaluate")
def _(p: Parser, op: Op) -> None:
    p.params(op, set())
    op.parts["plugin"] = p.name()
    op.parts["args"] = p.call_args()
    if p.accept(":"):
        op.parts["schema"] = p.column_types()


@operator("reduce")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind"})
    p.need("by")
    op.parts["column"] = p.named()
    op.parts["with"] = {}
    if p.accept("with"):
        while p.now.kind == "name":
            name = p.name().lower()
            p.need("=")
            op.parts["with"][name] = p.value()
            p.accept(",")


@operator("scan")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"with_match_id", "kind"})
    op.parts["order"] = []
    op.parts["partition"] = []
    if p.accept("order"):
        p.need("by")
        op.parts["order"] = p.sort_keys()
    if p.accept("partition"):
        p.need("by")
        op.parts["partition"] = p.listed(p.expression)
    op.parts["declare"] = []
    if p.accept("declare"):
        p.need("(")
        op.parts["declare"] = p.listed(p.parameter, (")",))
        p.need(")")
    p.need("with")
    p.need("(")
    steps = []
    while p.accept("step"):
        name = p.name()
        optional = p.accept("optional")
        output = "all"
        if p.accept("output"):
            p.need("=")
            output = p.take().text.lower()
        p.need(":")
        condition = p.expression()
        assigns = []
        if p.accept("=>"):
            assigns = p.listed(p.named)
        p.accept(";")
        steps.append({"name": name, "optional": optional, "output": output, "condition": condition, "assign": assigns})
    p.need(")")
    op.parts["steps"] = steps


@operator("fork")
def _(p: Parser, op: Op) -> None:
    branches = []
    while p.sees("(") or p.now.kind == "name" and p.ahead().is_("="):
        name = None
        if not p.sees("("):
            name = p.name()
            p.need("=")
        p.need("(")
        branches.append((name or f"branch{len(branches)}", body(p)))
        p.need(")")
    op.parts["branches"] = branches


@operator("facet")
def _(p: Parser, op: Op) -> None:
    p.need("by")
    op.parts["columns"] = p.listed(p.expression)
    op.parts["body"] = []
    if p.accept("with"):
        p.need("(")
        op.parts["body"] = body(p)
        p.need(")")


@operator("partition", "__partitionby")
def _(p: Parser, op: Op) -> None:
    p.params(op, set())
    p.accept("by")
    op.parts["column"] = Name(p.name()) if p.now.kind == "name" and p.ahead().is_("(", "{") else p.expression()
    if p.accept("{"):
        op.parts["body"] = body(p)
        p.need("}")
    else:
        p.need("(")
        op.parts["body"] = body(p)
        p.need(")")


@operator("make-series")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind"})

    def one():
        e = p.named()
        default = None
        if p.accept("default"):
            p.need("=")
            default = p.additive()
        return e, default

    op.parts["aggregates"] = p.listed(one)
    p.need("on")
    op.parts["axis"] = p.named()
    if p.accept("in"):
        call = p.postfix()
        if not isinstance(call, Call) or call.name.lower() != "range" or len(call.args) != 3:
            raise p.fail("expected range(start, stop, step)")
        op.parts["from"], op.parts["to"], op.parts["step"] = call.args
    else:
        op.parts["from"] = p.additive() if p.accept("from") else None
        op.parts["to"] = p.additive() if p.accept("to") else None
        p.need("step")
        op.parts["step"] = p.additive()
    op.parts["by"] = p.listed(p.named) if p.accept("by") else []


@operator("make-graph")
def _(p: Parser, op: Op) -> None:
    op.parts["source"] = p.name()
    p.need("-")
    p.need("-")
    p.need(">")
    op.parts["target"] = p.name()
    nodes = []
    if p.accept("with"):
        if p.word("partitioned-by"):
            raise p.fail("expected a node table")
        if p.accept("node_id"):
            p.need("=")
            op.parts["node_id"] = p.name()
        else:
            def one():
                t = p.sub()
                p.need("on")
                return t, p.name()

            nodes = p.listed(one)
    op.parts["nodes"] = nodes


@operator("graph-match", "graph-shortest-paths")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"cycles", "output"})
    op.parts["patterns"] = p.listed(lambda: _path(p))
    op.parts["where"] = p.expression() if p.accept("where") else None
    op.parts["project"] = p.listed(p.named) if p.accept("project") else []


def _path(p: Parser) -> list:
    """Nodes and edges in turn: ("node", name) and ("edge", name, direction, low, high)."""
    def node():
        p.need("(")
        name = p.name() if p.now.kind == "name" else None
        p.need(")")
        return "node", name

    out = [node()]
    while p.sees("-", "<"):
        left = p.accept("<")
        p.need("-")
        name, low, high = None, 1, 1
        if p.accept("["):
            name = p.name() if p.now.kind == "name" else None
            if p.accept("*"):
                low = p.take().value
                p.need("..")
                high = p.take().value
            p.need("]")
            p.need("-")
        elif p.sees("-"):
            p.take()
        right = p.accept(">")
        out += [("edge", name, "<" if left else ">" if right else "-", low, high), node()]
    return out


@operator("graph-to-table")
def _(p: Parser, op: Op) -> None:
    def one():
        what = p.name().lower()
        options = {}
        alias = None
        if p.accept("as"):
            alias = p.name()
        if p.accept("with"):
            p.accept("(")
            while p.now.kind == "name":
                k = p.name().lower()
                p.need("=")
                options[k] = p.name()
                p.accept(",")
            p.accept(")")
        return what, alias, options

    op.parts["outputs"] = p.listed(one) if p.now.kind == "name" else [("nodes", None, {})]


@operator("graph-mark-components")
def _(p: Parser, op: Op) -> None:
    p.params(op, {"kind", "with_component_id"})


@operator("graph-where-nodes", "graph-where-edges")
def _(p: Parser, op: Op) -> None:
    op.parts["predicate"] = p.expression()


def parse(text: str) -> Script:
    return Parser(text).script()
