import pytest

from sluice.lang import ast as A
from sluice.lang.diagnostics import QueryError
from sluice.lang.lexer import tokens
from sluice.lang.parser import parse


def kinds(text):
    return [(t.kind, t.value if t.value is not None else t.text) for t in tokens(text)][:-1]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ('"a\\nb"', "string", "a\nb"), ("'it\\'s'", "string", "it's"), ('@"a\\b""c"', "string", 'a\\b"c'), ('h"secret"', "string", "secret"), ("```x\ny```", "string", "x\ny"),
        ("0x1F", "long", 31), ("12", "long", 12), ("1.5", "real", 1.5), ("1e3", "real", 1000.0), ("2h", "timespan", 72_000_000_000), ("1.5d", "timespan", 1_296_000_000_000),
        ("100ms", "timespan", 1_000_000), ("3tick", "timespan", 3), ("datetime(2024-01-02)", "typed", "2024-01-02"), ("dynamic([1,(2)])", "typed", "[1,(2)]"), ("long(5)", "typed", "5"),
    ],
)
def test_literals(text, kind, value):
    assert kinds(text) == [(kind, value)]


def test_comments_blanks_and_stray_backslashes():
    assert kinds("﻿a // b\n\\ c") == [("name", "a"), ("name", "c")]


def test_two_word_and_negated_operators():
    assert [t.text for t in tokens("a matches   regex b !in~ c !has_cs d in~ e")][:-1] == ["a", "matches regex", "b", "!in~", "c", "!has_cs", "d", "in~", "e"]
    assert [t.kind for t in tokens("a !in~ b")][:-1] == ["name", "name", "name"]


@pytest.mark.parametrize("text", ['"open', "dynamic([1", "a § b"])
def test_lexer_errors(text):
    with pytest.raises(QueryError) as e:
        tokens(text)
    assert e.value.code == "KQL000"


def expression(text):
    return parse(f"T | where {text}").statements[0].ops[0].parts["predicate"]


def test_precedence():
    e = expression('a == 1 or b == 2 and c has "x"')
    assert e.op == "or" and e.right.op == "and"
    e = expression("a + b * c > d")
    assert e.op == ">" and e.left.op == "+" and e.left.right.op == "*"
    e = expression("x !between (1 .. 2)")
    assert isinstance(e, A.Between) and e.negated


@pytest.mark.parametrize(
    "text",
    [
        "T | wher x > 1", "T | where", "T | summarize by", "T | join kind=inner U on", "T | top 5", "T | where (a", "T || count", "let = 5; T", "T | extend a = ", "T | where a in (1",
    ],
)
def test_syntax_errors_have_a_code_and_a_place(text):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.code == "KQL005"
    assert e.value.diagnostic.line == 1


def test_keywords_as_names_and_wildcards():
    p = parse("t | where kind == 1 | project-away a*, *b | summarize count() by kind").statements[0]
    assert [op.name for op in p.ops] == ["where", "project-away", "summarize"]
    assert isinstance(p.ops[1].parts["columns"][0], A.Pattern)


def test_statements():
    s = parse("set x = 1; declare query_parameters(a:long = 5, b:string); let f = (x:long, T:(*)) { T | take 1 }; let y = 3; T | count; U").statements
    assert [type(x).__name__ for x in s] == ["SetOption", "Parameters", "Let", "Let", "Pipeline", "Pipeline"]


def test_parenthesised_sources_keep_their_operators():
    p = parse("(T | where a > 1) | count").statements[0]
    assert isinstance(p.source, A.Sub) and p.source.pipeline.ops[0].name == "where"


def test_every_operator_is_registered():
    import sluice.operators  # noqa: F401
    from sluice.lang.parser import OPERATORS as parsed
    from sluice.operators.core import OPERATORS as run

    assert {n for n in parsed if n not in ("mvexpand", "mvapply", "__partitionby")} <= set(run)
