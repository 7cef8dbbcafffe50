"""Syntax trees of expressions to Spark columns.

A compiled expression is an E: the column, its Spark type where it is known at once, and a name for output columns. What
the type decides (integer division, dynamic access, text of variants) asks Catalyst through Context.type_of.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang import ast as A
from sluice.lang.diagnostics import (
    ARITY, SCOPE, TRANSLATION, TYPE_MISMATCH, UNKNOWN_COLUMN, UNKNOWN_FUNCTION, Diagnostic, QueryError, unsupported,
)
from sluice.plans import types as K


@dataclass
class E:
    column: Column
    type: T.DataType | None = None
    name: str | None = None
    constant: Any = None  # the value of a literal
    kind: str | None = None  # the literal's language type
    columns: list[tuple[str, Column]] | None = None  # several output columns (arg_max(x, *), percentiles)
    literal_list: list[E] | None = None


@dataclass
class Scope:
    """Names that let statements, parameters and `as` have bound."""

    parent: Scope | None = None
    names: dict[str, Any] = field(default_factory=dict)

    def find(self, name: str):
        low = name.lower()
        if low in self.names:
            return self.names[low]
        return self.parent.find(name) if self.parent else None

    def bind(self, name: str, value: Any) -> None:
        self.names[name.lower()] = value


@dataclass
class Context:
    """What an expression is compiled against."""

    engine: Any
    scope: Scope
    df: DataFrame | None = None
    order: list | None = None  # sort keys of the rows, for row-order functions
    hidden: list[str] = field(default_factory=list)  # key columns of an enclosing mv-apply or partition
    carried: list[str] = field(default_factory=list)  # columns kept with those keys
    aggregates: bool = False  # aggregate functions are allowed
    sides: dict[str, list[str]] | None = None  # $left and $right of a join
    options: dict[str, Any] = field(default_factory=dict)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    locals: dict[str, E] = field(default_factory=dict)

    def with_(self, **changes) -> Context:
        out = Context(self.engine, self.scope, self.df, self.order, self.hidden, self.carried, self.aggregates, self.sides, self.options, self.diagnostics, self.locals)
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    @property
    def sql(self) -> bool:
        """Whether the compatibility switch asks for plain SQL behaviour."""
        return self.options.get("compat") == "sql"

    def warn(self, code: str, message: str) -> None:
        self.diagnostics.append(Diagnostic(code, message))
        if self.options.get("strict"):
            raise QueryError(code, message)

    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.hidden and c not in self.carried] if self.df is not None else []

    def resolve(self, name: str) -> str | None:
        if self.df is None:
            return None
        if name in self.df.columns:
            return name
        low = name.lower()
        return next((c for c in self.df.columns if c.lower() == low), None)

    def type_of(self, e: E) -> T.DataType:
        if e.type is None:
            base = self.df if self.df is not None else self.engine.spark.range(1)
            try:
                e.type = base.select(e.column.alias("x")).schema[0].dataType
            except Exception as error:
                raise QueryError(TYPE_MISMATCH, str(error).split("\n")[0][:300]) from error
        return e.type


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---- coercions ------------------------------------------------------------------------------------------------------


def as_string(ctx: Context, e: E) -> Column:
    t = ctx.type_of(e)
    if isinstance(t, T.StringType):
        return e.column
    if K.is_variant(t):
        return F.coalesce(F.try_variant_get(e.column, "$", "string"), F.to_json(e.column))
    if K.is_collection(t):
        return F.to_json(e.column)
    if isinstance(t, T.BooleanType):
        return F.when(e.column, "true").when(~e.column, "false")
    if K.is_span(t):
        return span_text(e.column)
    if isinstance(t, T.BinaryType):
        return F.base64(e.column)
    return e.column.cast("string")


def span_text(c: Column) -> Column:
    """[-][d.]hh:mm:ss[.fffffff]"""
    us = (F.extract(F.lit("DAY"), c).cast("long") * 86_400_000_000 + F.extract(F.lit("HOUR"), c).cast("long") * 3_600_000_000 + F.extract(F.lit("MINUTE"), c).cast("long") * 60_000_000) + (
        F.extract(F.lit("SECOND"), c).cast("decimal(20,6)") * 1_000_000
    ).cast("long")
    a = F.abs(us)
    days, rest = F.floor(a / 86_400_000_000).cast("long"), a % 86_400_000_000
    two = lambda x: F.lpad(F.floor(x).cast("long").cast("string"), 2, "0")
    micros = rest % 1_000_000
    return F.when(
        c.isNotNull(),
        F.concat(
            F.when(us < 0, "-").otherwise(""),
            F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""),
            two(rest / 3_600_000_000), F.lit(":"), two(rest % 3_600_000_000 / 60_000_000), F.lit(":"), two(rest % 60_000_000 / 1_000_000),
            F.when(micros > 0, F.concat(F.lit("."), F.lpad((micros * 10).cast("string"), 7, "0"))).otherwise(""),
        ),
    )


def as_double(ctx: Context, e: E) -> Column:
    t = ctx.type_of(e)
    if K.is_variant(t):
        return F.try_variant_get(e.column, "$", "double")
    if isinstance(t, T.StringType | T.NumericType | T.BooleanType | T.NullType):
        return e.column if isinstance(t, T.DoubleType) else e.column.try_cast("double")
    return e.column


def as_numeric(ctx: Context, e: E) -> E:
    t = ctx.type_of(e)
    if K.is_variant(t) or isinstance(t, T.StringType):
        return E(as_double(ctx, e), T.DoubleType())
    return e


def as_key(ctx: Context, e: E) -> Column:
    """A column that can be grouped, compared and joined on."""
    t = ctx.type_of(e)
    return as_string(ctx, e) if K.is_variant(t) or isinstance(t, T.MapType) else e.column


def as_array(ctx: Context, e: E) -> E:
    """An array of what a dynamic value holds; texts are read as JSON."""
    t = ctx.type_of(e)
    if isinstance(t, T.ArrayType):
        return e
    if isinstance(t, T.StringType):
        return E(F.try_variant_get(F.try_parse_json(e.column), "$", "array<variant>"), T.ArrayType(T.VariantType()))
    if K.is_variant(t):
        return E(F.try_variant_get(e.column, "$", "array<variant>"), T.ArrayType(T.VariantType()))
    return E(F.array(e.column), T.ArrayType(t))


def as_variant(ctx: Context, e: E) -> Column:
    t = ctx.type_of(e)
    if K.is_variant(t):
        return e.column
    if isinstance(t, T.StringType):
        return F.try_parse_json(e.column)
    if isinstance(t, T.NullType):
        return e.column.cast("variant")
    if isinstance(t, T.StructType | T.MapType | T.ArrayType):
        return F.to_variant_object(e.column) if not isinstance(t, T.ArrayType) else F.parse_json(F.to_json(e.column)) if isinstance(t.elementType, T.VariantType) else F.to_variant_object(e.column)
    if isinstance(t, T.TimestampNTZType | T.DayTimeIntervalType):
        return as_string(ctx, e).cast("variant")
    return e.column.cast("variant")


def matched(ctx: Context, a: E, b: E) -> tuple[Column, Column]:
    """Both sides of a comparison in one type."""
    ta, tb = ctx.type_of(a), ctx.type_of(b)
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        return a.column, b.column
    va, vb = K.is_variant(ta), K.is_variant(tb)
    if va and vb:
        return as_string(ctx, a), as_string(ctx, b)
    if va or vb:
        v, other, t = (a, b, tb) if va else (b, a, ta)
        if K.is_numeric(t):
            left, right = F.try_variant_get(v.column, "$", "double"), other.column
        elif isinstance(t, T.BooleanType):
            left, right = F.try_variant_get(v.column, "$", "boolean"), other.column
        elif K.is_time(t):
            left, right = as_string(ctx, v).try_cast("timestamp_ntz"), other.column
        else:
            left, right = as_string(ctx, v), as_string(ctx, other)
        return (left, right) if va else (right, left)
    if isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
        return a.column, b.column
    for x, y, tx, ty, flip in ((a, b, ta, tb, False), (b, a, tb, ta, True)):
        if isinstance(tx, T.StringType) and not isinstance(ty, T.StringType):
            if K.is_time(ty):
                left = x.column.try_cast("timestamp_ntz")
            elif K.is_numeric(ty):
                left = x.column.try_cast("double")
            elif isinstance(ty, T.BooleanType):
                left = x.column.try_cast("boolean")
            else:
                left = x.column
            return (y.column, left) if flip else (left, y.column)
    if isinstance(ta, T.BooleanType) and K.is_numeric(tb):
        return a.column.cast("int"), b.column
    if isinstance(tb, T.BooleanType) and K.is_numeric(ta):
        return a.column, b.column.cast("int")
    return a.column, b.column


# ---- operators ------------------------------------------------------------------------------------------------------


def micros(c: Column) -> Column:
    """A timespan in microseconds."""
    return (F.extract(F.lit("DAY"), c).cast("long") * 86_400_000_000 + F.extract(F.lit("HOUR"), c).cast("long") * 3_600_000_000 + F.extract(F.lit("MINUTE"), c).cast("long") * 60_000_000) + (
        F.extract(F.lit("SECOND"), c).cast("decimal(20,6)") * 1_000_000
    ).cast("long")


def micros_span(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def epoch_micros(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c.cast("timestamp"))


def from_epoch_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def arithmetic(ctx: Context, op: str, a: E, b: E) -> E:
    ta, tb = ctx.type_of(a), ctx.type_of(b)
    if K.is_variant(ta) or isinstance(ta, T.StringType) and not (op == "+" and isinstance(tb, T.StringType)):
        if K.is_time(tb) or K.is_span(tb) and isinstance(ta, T.StringType):
            a = E(as_string(ctx, a).try_cast("timestamp_ntz"), K.TIMESTAMP)
        else:
            a = as_numeric(ctx, a)
        ta = ctx.type_of(a)
    if K.is_variant(tb) or isinstance(tb, T.StringType) and not isinstance(ta, T.StringType):
        b = E(as_string(ctx, b).try_cast("timestamp_ntz"), K.TIMESTAMP) if K.is_time(ta) else as_numeric(ctx, b)
        tb = ctx.type_of(b)
    x, y = a.column, b.column
    if isinstance(ta, T.BooleanType):
        x, ta = x.cast("long"), T.LongType()
    if isinstance(tb, T.BooleanType):
        y, tb = y.cast("long"), T.LongType()
    if op == "+":
        if isinstance(ta, T.StringType):
            return E(F.concat(x, y), T.StringType())
        if K.is_span(ta) and K.is_time(tb):
            return E(y.cast("timestamp_ntz") + x, K.TIMESTAMP)
        if K.is_time(ta) and K.is_span(tb):
            return E((x.cast("timestamp_ntz") if isinstance(ta, T.DateType) else x) + y, ta if not isinstance(ta, T.DateType) else K.TIMESTAMP)
        if K.is_span(ta) and K.is_span(tb):
            return E(x + y, K.INTERVAL)
        return E(F.try_add(x, y), None if not (K.is_integral(ta) and K.is_integral(tb)) else _wider(ta, tb))
    if op == "-":
        if K.is_time(ta) and K.is_time(tb):
            return E(micros_span(F.timestamp_diff("MICROSECOND", y, x)), K.INTERVAL)
        if K.is_time(ta) and K.is_span(tb):
            return E(x - y, ta)
        if K.is_span(ta) and K.is_span(tb):
            return E(x - y, K.INTERVAL)
        return E(F.try_subtract(x, y), None if not (K.is_integral(ta) and K.is_integral(tb)) else _wider(ta, tb))
    if op == "*":
        if K.is_span(ta) or K.is_span(tb):
            return E(F.try_multiply(x, y), K.INTERVAL)
        return E(F.try_multiply(x, y), None if not (K.is_integral(ta) and K.is_integral(tb)) else _wider(ta, tb))
    if op == "/":
        if K.is_span(ta) and K.is_span(tb):
            return E(F.try_divide(micros(x).cast("double"), micros(y).cast("double")), T.DoubleType())
        if K.is_span(ta):
            return E(F.try_divide(x, y), K.INTERVAL)
        if K.is_integral(ta) and K.is_integral(tb):
            # truncated toward zero; no value where the divisor is zero
            return E(F.call_function("div", x.cast("long"), F.when(y != 0, y.cast("long"))), T.LongType())
        return E(F.try_divide(x, y), None)
    if op == "%":
        if K.is_span(ta) and K.is_span(tb):
            return E(micros_span(F.try_mod(micros(x), micros(y))), K.INTERVAL)
        return E(F.try_mod(x, y), None)
    raise unsupported(f"operator {op}")


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(a, T.LongType) or isinstance(b, T.LongType) else T.IntegerType()


_TERM = r"[\p{L}\p{N}_]"


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&\-~\s])", r"\\$1")


def string_operator(ctx: Context, op: str, a: E, b: E) -> E:
    negated = op.startswith("!")
    op = op.lstrip("!")
    x, y = as_string(ctx, a), as_string(ctx, b)
    cs = op.endswith("_cs")
    base = op.removesuffix("_cs")
    text = b.constant if isinstance(b.constant, str) else None
    fold = (lambda c: c) if cs else F.lower
    if base in ("=~", "~"):
        out = F.lower(x) == F.lower(y)
    elif base == "contains" or base == "has" and not ctx.options.get("term_match"):
        out = F.contains(fold(x), fold(y))
    elif base == "has":
        out = F.regexp_like(x, F.concat(F.lit(("" if cs else "(?i)") + f"(?<!{_TERM})"), F.lit(re.escape(text)) if text is not None else _escaped(y), F.lit(f"(?!{_TERM})")))
    elif base == "startswith":
        out = F.startswith(fold(x), fold(y))
    elif base == "endswith":
        out = F.endswith(fold(x), fold(y))
    elif base in ("hasprefix", "hassuffix"):
        word = F.lit(re.escape(text)) if text is not None else _escaped(y)
        before, after = (f"(?<!{_TERM})", "") if base == "hasprefix" else ("", f"(?!{_TERM})")
        out = F.regexp_like(x, F.concat(F.lit(("" if cs else "(?i)") + before), word, F.lit(after)))
    elif base == "like":
        out = x.ilike(text) if text is not None else F.lower(x).like(F.lower(y))
    elif base == "likecs":
        out = x.like(text) if text is not None else F.call_function("like", x, y)
    elif base == "matches regex":
        out = F.regexp_like(x, F.lit(java_regex(text)) if text is not None else y)
    else:
        raise unsupported(f"operator {op}")
    return E(~out if negated else out, T.BooleanType())


def java_regex(pattern: str) -> str:
    """RE2's named groups in Java's spelling."""
    return pattern.replace("(?P<", "(?<")


# ---- the compiler ---------------------------------------------------------------------------------------------------


def compile_expr(ctx: Context, e: A.Expr) -> E:
    kind = type(e).__name__
    return _COMPILE[kind](ctx, e)


def constants(e: E) -> list:
    """The values of a constant argument: those of a list or of a dynamic array, or the one value."""
    if e.literal_list is not None:
        return [i.constant for i in e.literal_list]
    if e.kind == "dynamic" and isinstance(e.constant, str):
        value = K.dynamic_json(e.constant)
        return value if isinstance(value, list) else [value]
    return [e.constant]


def _literal(ctx: Context, e: A.Literal) -> E:
    column, t = K.literal(e.kind, e.value)
    return E(column, t, constant=e.value, kind=e.kind)


def _name(ctx: Context, e: A.Name) -> E:
    if e.name in ctx.locals:
        return ctx.locals[e.name]
    found = ctx.resolve(e.name)
    if found is not None:
        t = next(f.dataType for f in ctx.df.schema.fields if f.name == found)
        return E(q(found), t, name=found)
    bound = ctx.scope.find(e.name)
    if isinstance(bound, E):
        return E(bound.column, bound.type, name=e.name, constant=bound.constant, kind=bound.kind, literal_list=bound.literal_list)
    if bound is not None:
        raise QueryError(SCOPE, f"{e.name!r} is a table or function, not a value")
    raise QueryError(UNKNOWN_COLUMN, f"no column {e.name!r}")


def _member(ctx: Context, e: A.Member) -> E:
    if isinstance(e.object, A.Name) and e.object.name.lower() in ("$left", "$right") and ctx.sides is not None:
        return side_column(ctx, e.object.name.lower(), e.name)
    try:
        whole = compile_expr(ctx, e.object)
    except QueryError:
        if isinstance(e.object, A.Name) and (found := ctx.resolve(f"{e.object.name}.{e.name}")):
            return E(q(found), name=found)
        raise
    return access(ctx, whole, e.name, e.name)


def side_column(ctx: Context, side: str, name: str) -> E:
    for visible, inner in ctx.sides[side]:
        if visible.lower() == name.lower():
            return E(q(inner), name=name)
    raise QueryError(UNKNOWN_COLUMN, f"no column {name!r} in {side}")


def access(ctx: Context, whole: E, key: str, name: str | None = None) -> E:
    t = ctx.type_of(whole)
    if isinstance(t, T.StructType):
        found = next((f for f in t.fields if f.name.lower() == key.lower()), None)
        return E(whole.column[found.name], found.dataType, name) if found else E(F.lit(None).cast("variant"), T.VariantType(), name)
    if isinstance(t, T.MapType):
        return E(F.try_element_at(whole.column, F.lit(key)), t.valueType, name)
    if isinstance(t, T.StringType | T.VariantType):
        v = F.try_parse_json(whole.column) if isinstance(t, T.StringType) else whole.column
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" if not re.fullmatch(r"\w+", key) else "$." + key
        return E(F.try_variant_get(v, path, "variant"), T.VariantType(), name)
    return E(F.lit(None).cast("variant"), T.VariantType(), name)


def _index(ctx: Context, e: A.Index) -> E:
    whole, at = compile_expr(ctx, e.object), compile_expr(ctx, e.index)
    t = ctx.type_of(whole)
    if isinstance(at.constant, str):
        return access(ctx, whole, at.constant, at.constant)
    if isinstance(ctx.type_of(at), T.StringType):
        if isinstance(t, T.MapType):
            return E(F.try_element_at(whole.column, at.column), t.valueType)
        m = F.from_json(as_string(ctx, whole), T.MapType(T.StringType(), T.StringType()))
        return E(F.try_element_at(m, at.column), T.StringType())
    array = as_array(ctx, whole)
    place = at.column.cast("int")
    return E(F.try_element_at(array.column, F.when(place < 0, place).otherwise(place + 1)), ctx.type_of(array).elementType)


def _unary(ctx: Context, e: A.Unary) -> E:
    inner = compile_expr(ctx, e.operand)
    if e.op == "+":
        return inner
    if inner.constant is not None and isinstance(inner.constant, int | float) and not isinstance(inner.constant, bool):
        return _literal(ctx, A.Literal(inner.kind, -inner.constant))
    n = as_numeric(ctx, inner)
    return E(-n.column, n.type)


def truth(ctx: Context, e: E) -> Column:
    t = ctx.type_of(e)
    if isinstance(t, T.BooleanType):
        return e.column
    if K.is_variant(t):
        return F.try_variant_get(e.column, "$", "boolean")
    if K.is_numeric(t):
        return e.column != 0
    return e.column.try_cast("boolean")


def _binary(ctx: Context, e: A.Binary) -> E:
    from sluice.lang.parser import STRING_OPS

    a, b = compile_expr(ctx, e.left), compile_expr(ctx, e.right)
    if e.op in ("and", "or"):
        x, y = truth(ctx, a), truth(ctx, b)
        return E(x & y if e.op == "and" else x | y, T.BooleanType())
    if e.op in STRING_OPS:
        return string_operator(ctx, e.op, a, b)
    if e.op in ("==", "!=", "<", ">", "<=", ">="):
        x, y = matched(ctx, a, b)
        out = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[e.op]()
        return E(out, T.BooleanType())
    return arithmetic(ctx, e.op, a, b)


def _between(ctx: Context, e: A.Between) -> E:
    x, low, high = (compile_expr(ctx, p) for p in (e.operand, e.low, e.high))
    if K.is_time(ctx.type_of(low)) and K.is_span(ctx.type_of(high)):
        high = arithmetic(ctx, "+", low, high)
    a, b = matched(ctx, x, low)
    c, d = matched(ctx, x, high)
    out = (a >= b) & (c <= d)
    return E(~out if e.negated else out, T.BooleanType())


def _among(ctx: Context, e: A.Among) -> E:
    x = compile_expr(ctx, e.operand)
    items: list[E] = []
    for item in e.items:
        if isinstance(item, A.Sub) or isinstance(item, A.Name) and ctx.resolve(item.name) is None and isinstance(ctx.scope.find(item.name), DataFrame):
            return _in_table(ctx, e, x, item)
        v = compile_expr(ctx, item)
        if v.literal_list is not None:
            items += v.literal_list
        else:
            items.append(v)
    op, negated = e.op.lstrip("!"), e.op.startswith("!")
    if op in ("has_any", "has_all"):
        parts = []
        for v in items:
            if isinstance(ctx.type_of(v), T.ArrayType):
                test = lambda y: F.contains(F.lower(as_string(ctx, x)), F.lower(y.cast("string")))
                parts.append(F.exists(v.column, test) if op == "has_any" else F.forall(v.column, test))
            else:
                parts.append(string_operator(ctx, "has", x, v).column)
        out = F.lit(op == "has_all")
        for p in parts:
            out = out | p if op == "has_any" else out & p
        return E(out, T.BooleanType())
    fold = op == "in~"
    plain, arrays = [], []
    for v in items:
        (arrays if isinstance(ctx.type_of(v), T.ArrayType | T.VariantType) and v.constant is None or isinstance(v.type, T.ArrayType) else plain).append(v)
    out = F.lit(False)
    if plain:
        if fold:
            out = F.lower(as_string(ctx, x)).isin([F.lower(as_string(ctx, v)) for v in plain])
        else:
            pairs = [matched(ctx, x, v) for v in plain]
            out = pairs[0][0].isin([y for _, y in pairs])
    for v in arrays:
        a = as_array(ctx, v)
        hit = F.exists(a.column, lambda y: (F.lower(y.cast("string")) == F.lower(as_string(ctx, x))) if fold else y.cast("string") == as_string(ctx, x))
        out = out | hit
    return E(~out if negated else out, T.BooleanType())


def _in_table(ctx: Context, e: A.Among, x: E, item: A.Expr) -> E:
    """`x in (table)` where the operator does not turn it into a semi join: an uncorrelated IN subquery."""
    table = ctx.engine.table_of(ctx, item)
    first = table.columns[0]
    op = e.op.lstrip("!")
    left = as_key(ctx, x)
    values = table.select(q(first).alias("v"))
    if op == "in~":
        left, values = F.lower(left.cast("string")), values.select(F.lower(F.col("v").cast("string")).alias("v"))
    hit = left.isin(values)
    return E(~hit if e.op.startswith("!") else hit, T.BooleanType())


def _list(ctx: Context, e: A.ListOf) -> E:
    items = [compile_expr(ctx, i) for i in e.items]
    out = pack_array(ctx, items)
    out.literal_list = items
    return out


def pack_array(ctx: Context, items: list[E]) -> E:
    if not items:
        return E(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
    kinds = {ctx.type_of(i).simpleString() for i in items if not isinstance(ctx.type_of(i), T.NullType)}
    if len(kinds) <= 1:
        t = next((ctx.type_of(i) for i in items if not isinstance(ctx.type_of(i), T.NullType)), T.StringType())
        return E(F.array(*[i.column.cast(t) if isinstance(ctx.type_of(i), T.NullType) else i.column for i in items]), T.ArrayType(t))
    if all(K.is_numeric(ctx.type_of(i)) for i in items):
        return E(F.array(*[i.column.cast("double") for i in items]), T.ArrayType(T.DoubleType()))
    return E(F.array(*[E_variant(ctx, i) for i in items]), T.ArrayType(T.VariantType()))


def E_variant(ctx: Context, e: E) -> Column:
    """A value inside a dynamic: texts stay texts."""
    t = ctx.type_of(e)
    return e.column.cast("variant") if isinstance(t, T.StringType) else as_variant(ctx, e)


def _sub(ctx: Context, e: A.Sub) -> E:
    table = ctx.engine.table_of(ctx, e)
    return E(table.limit(1).select(q(table.columns[0])).scalar(), table.schema[0].dataType)


def _call(ctx: Context, e: A.Call) -> E:
    from sluice.functions import registry

    name = e.name.lower()
    bound = ctx.scope.find(e.name)
    if isinstance(bound, A.Lambda):
        return ctx.engine.call_scalar(ctx, bound, e)
    own = ctx.engine.scalars.get(name)
    if own is not None:
        args = [compile_expr(ctx, a) for a in e.args]
        return E(own(*[a.column for a in args]))
    spec = registry.find(name)
    if spec is None:
        ctx.warn(UNKNOWN_FUNCTION, f"unknown function {e.name!r}")
        raise QueryError(UNKNOWN_FUNCTION, f"unknown function {e.name!r}")
    count = len(e.args)
    if count < spec.least or spec.most is not None and count > spec.most:
        raise QueryError(ARITY, f"{e.name} takes {spec.least} to {spec.most if spec.most is not None else 'many'} arguments, found {count}")
    if spec.kind == "X":
        raise unsupported(f"function {e.name}")
    if spec.kind == "aggregate" and not ctx.aggregates:
        raise QueryError(TRANSLATION, f"{e.name} is an aggregate and stands outside of summarize")
    return spec.build(ctx, e)


def _named(ctx: Context, e: A.Named) -> E:
    out = compile_expr(ctx, e.value)
    out.name = e.names[0]
    return out


def _fail(what: str):
    def run(ctx: Context, e) -> E:
        raise QueryError(TRANSLATION, f"{what} cannot stand here")

    return run


_COMPILE = {
    "Literal": _literal, "Name": _name, "Member": _member, "Index": _index, "Unary": _unary, "Binary": _binary, "Between": _between, "Among": _among,
    "ListOf": _list, "Sub": _sub, "Call": _call, "Named": _named, "Star": _fail("*"), "Pattern": _fail("a wildcard"), "Datatable": _fail("datatable"),
}


def constant(ctx: Context, e: A.Expr, what: str = "a constant"):
    """The Python value of an expression that does not depend on rows."""
    found = compile_expr(ctx, e)
    if found.constant is not None:
        return found.constant
    try:
        return ctx.engine.spark.range(1).select(found.column.alias("x")).first()["x"]
    except Exception as error:
        raise QueryError(TRANSLATION, f"expected {what}") from error

