"""Strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function
from sluice.lang.diagnostics import TRANSLATION, QueryError
from sluice.plans import types as K
from sluice.plans.expr import E, as_array, as_string, java_regex

STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()


def regex(e: E) -> Column:
    return F.lit(java_regex(e.constant)) if isinstance(e.constant, str) else e.column


def replacement(e: E) -> Column:
    """\\1 in Java's spelling."""
    if isinstance(e.constant, str):
        return F.lit(re.sub(r"\\(\d)", r"$\1", e.constant.replace("$", "\\$")))
    return F.regexp_replace(e.column, r"\\(\d)", r"\$$1")


def _simple(names: str, build, result=STRING):
    @function(names, 1, kind="B")
    def _(ctx, args):
        return E(build(as_string(ctx, args[0])), result)


_simple("tolower", F.lower)
_simple("toupper", F.upper)
_simple("reverse", F.reverse)
_simple("strlen", lambda c: F.char_length(c).cast("long"), LONG)
_simple("string_size", lambda c: F.octet_length(c).cast("long"), LONG)
_simple("isascii", lambda c: ~c.rlike(r"[^\x00-\x7F]"), BOOL)
_simple("isutf8", F.is_valid_utf8, BOOL)
_simple("regex_quote", lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))


def whole(e: E) -> Column:
    return e.column.cast("int")


@function("substring", 2, 3)
def _(ctx, args):
    text, start = as_string(ctx, args[0]), whole(args[1])
    start = F.when(start < 0, F.greatest(F.char_length(text) + start, F.lit(0))).otherwise(start)
    if len(args) > 2:
        return E(F.substring(text, start + 1, F.greatest(whole(args[2]), F.lit(0))), STRING)
    return E(F.substring(text, start + 1, F.char_length(text)), STRING)


@function("strcat", 1, None, kind="B")
def _(ctx, args):
    return E(F.concat(*[F.coalesce(as_string(ctx, a), F.lit("")) for a in args]), STRING)


@function("strcat_delim", 2, None, kind="B")
def _(ctx, args):
    joined = F.array(*[F.coalesce(as_string(ctx, a), F.lit("")) for a in args[1:]])
    return E(F.array_join(joined, args[0].constant) if isinstance(args[0].constant, str) else F.call_function("array_join", joined, as_string(ctx, args[0])), STRING)


@function("strcat_array array_strcat", 2, kind="B")
def _(ctx, args):
    array = as_array(ctx, args[0])
    texts = F.transform(array.column, lambda x: as_string(ctx, E(x, array.type.elementType)))
    return E(F.call_function("array_join", texts, as_string(ctx, args[1])), STRING)


@function("strcmp", 2)
def _(ctx, args):
    a, b = as_string(ctx, args[0]), as_string(ctx, args[1])
    return E(F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("long"), LONG)


@function("strrep repeat", 2, 3, kind="B")
def _(ctx, args):
    n = whole(args[1])
    if len(args) > 2:
        return E(F.call_function("array_join", F.array_repeat(as_string(ctx, args[0]), n), as_string(ctx, args[2])), STRING)
    return E(F.repeat(as_string(ctx, args[0]), n), STRING)


@function("indexof", 2, 5)
def _(ctx, args):
    text, part = as_string(ctx, args[0]), as_string(ctx, args[1])
    start = whole(args[2]) if len(args) > 2 else F.lit(0)
    if len(args) > 3:
        length = whole(args[3])
        text = F.when(length >= 0, F.substring(text, F.lit(1), start + length)).otherwise(text)
    if len(args) > 4:  # the n-th occurrence
        n = int(args[4].constant)
        at = start
        for _ in range(n):
            found = F.call_function("locate", part, text, at + 1)
            at = F.when(found > 0, found).otherwise(F.lit(1 << 30))
        return E(F.when(at < (1 << 30), at - 1).otherwise(-1).cast("long"), LONG)
    return E((F.call_function("locate", part, text, start + 1) - 1).cast("long"), LONG)


@function("indexof_regex", 2, 4)
def _(ctx, args):
    text = as_string(ctx, args[0])
    start = whole(args[2]) if len(args) > 2 else F.lit(0)
    part = F.substring(text, start + 1, F.char_length(text))
    at = F.regexp_instr(part, regex(args[1]))
    return E(F.when(at > 0, at - 1 + start).otherwise(-1).cast("long"), LONG)


@function("countof", 2, 3)
def _(ctx, args):
    text, part = as_string(ctx, args[0]), as_string(ctx, args[1])
    if len(args) > 2 and args[2].constant == "regex":
        return E(F.regexp_count(text, regex(args[1])).cast("long"), LONG)
    less = F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))
    return E(F.try_divide(less, F.char_length(part)).cast("long"), LONG)


@function("extract", 2, 4, kind="B")
def _(ctx, args):
    if len(args) == 2:
        group, source = 1, args[1]
    else:
        group, source = int(args[1].constant), args[2]
    text = as_string(ctx, source)
    out = F.when(F.regexp_like(text, regex(args[0])), F.regexp_extract(text, java_regex(args[0].constant), group))
    if len(args) == 4 and (kind := (args[3].constant or args[3].name)):
        return E(out.try_cast(K.spark_type(kind)), K.spark_type(kind))
    return E(out, STRING)


@function("extract_all", 2, 3, kind="B")
def _(ctx, args):
    pattern = java_regex(args[0].constant)
    groups = re.compile(args[0].constant.replace("(?<", "(?P<") if "(?<" in args[0].constant and "(?<=" not in args[0].constant and "(?<!" not in args[0].constant else args[0].constant).groups
    text = as_string(ctx, args[-1])
    if groups <= 1:
        return E(F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)), T.ArrayType(STRING))
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    return E(_zip_groups(each), T.ArrayType(T.ArrayType(STRING)))


def _zip_groups(each: list[Column]) -> Column:
    return F.transform(each[0], lambda first, i: F.array(first, *[F.get(x, i) for x in each[1:]]))


@function("replace_string replace", 3, kind="B")
def _(ctx, args):
    return E(F.replace(as_string(ctx, args[0]), as_string(ctx, args[1]), as_string(ctx, args[2])), STRING)


@function("replace_regex", 3, kind="B")
def _(ctx, args):
    return E(F.regexp_replace(as_string(ctx, args[0]), regex(args[1]), replacement(args[2])), STRING)


@function("replace_strings", 3)
def _(ctx, args):
    old, new = as_array(ctx, args[1]).column, as_array(ctx, args[2]).column
    pairs = F.arrays_zip(old.alias("o"), new.alias("n"))
    return E(F.aggregate(pairs, as_string(ctx, args[0]), lambda acc, p: F.replace(acc, p.getItem("o").cast("string"), p.getItem("n").cast("string"))), STRING)


@function("split", 2, 3)
def _(ctx, args):
    text = as_string(ctx, args[0])
    if isinstance(args[1].constant, str):
        parts = F.split(text, re.escape(args[1].constant)) if args[1].constant else F.array(text)
    else:
        parts = F.split(text, F.regexp_replace(as_string(ctx, args[1]), r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    if len(args) > 2:
        at = whole(args[2])
        one = F.try_element_at(parts, F.when(at < 0, at).otherwise(at + 1))
        return E(F.array_compact(F.array(one)), T.ArrayType(STRING))
    return E(parts, T.ArrayType(STRING))


@function("translate", 3, kind="B")
def _(ctx, args):
    if not (isinstance(args[0].constant, str) and isinstance(args[1].constant, str)):
        return E(F.call_function("translate", as_string(ctx, args[2]), as_string(ctx, args[0]), as_string(ctx, args[1])), STRING)
    old, new = args[0].constant, args[1].constant
    if new and len(new) < len(old):
        new += new[-1] * (len(old) - len(new))
    return E(F.translate(as_string(ctx, args[2]), old, new), STRING)


def _trim(names: str, start: bool, end: bool, build):
    @function(names, 1, 2)
    def _(ctx, args):
        text = as_string(ctx, args[-1])
        if len(args) == 1:
            return E(build(text), STRING)
        pattern = java_regex(args[0].constant)
        if start:
            text = F.regexp_replace(text, f"^(?:{pattern})", "")
        if end:
            text = F.regexp_replace(text, f"(?:{pattern})$", "")
        return E(text, STRING)


_trim("trim", True, True, F.trim)
_trim("trim_start", True, False, F.ltrim)
_trim("trim_end", False, True, F.rtrim)


@function("format_bytes", 1, 3)
def _(ctx, args):
    n = args[0].column.cast("double")
    digits = int(args[1].constant or 0) if len(args) > 1 else 0
    units = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB"]
    if len(args) > 2:
        chosen = args[2].constant
        if chosen not in units:
            raise QueryError(TRANSLATION, f"unknown unit {chosen!r}")
        return E(F.concat(_plain_number(n / 1024.0 ** units.index(chosen), digits), F.lit(" " + chosen)), STRING)
    out = None
    for k in reversed(range(len(units))):
        text = F.concat(_plain_number(n / 1024.0**k, digits), F.lit(" " + units[k]))
        test = F.abs(n) >= 1024.0**k
        out = F.when(test, text) if out is None else out.when(test, text) if k else out.otherwise(text)
    return E(out, STRING)


def _plain_number(c: Column, digits: int) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(F.format_number(c, digits), F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


@function("make_string unicode_codepoints_to_string", 1, None)
def _(ctx, args):
    arrays = [F.transform(a.column, lambda x: x.cast("long")) if isinstance(ctx.type_of(a), T.ArrayType) else F.array(a.column.cast("long")) for a in args]
    points = F.concat(*arrays)
    # each code point as four bytes of UTF-32
    one = lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")
    return E(F.array_join(F.transform(points, one), ""), STRING)


@function("has_any_index", 2)
def _(ctx, args):
    array = as_array(ctx, args[1])
    text = F.lower(as_string(ctx, args[0]))
    hits = F.transform(array.column, lambda x: F.contains(text, F.lower(x.cast("string"))))
    return E((F.array_position(hits, F.lit(True)) - 1).cast("long"), LONG)

