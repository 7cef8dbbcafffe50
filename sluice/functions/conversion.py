"""Conversion, conditions and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function, raw
from sluice.lang import ast as A
from sluice.plans import types as K
from sluice.plans.expr import E, as_string, as_variant, compile_expr, matched, q, truth

STRING, BOOL, LONG, DOUBLE = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


@raw("typeof", 1, kind="B")
def _(ctx, call):
    """A type's name, for functions that convert to it."""
    return E(F.lit(call.args[0].name), STRING, constant=call.args[0].name, kind="string")


def _cast(names: str, kind: str):
    spark = K.spark_type(kind)

    @function(names, 1, kind="B")
    def _(ctx, args):
        (a,) = args
        t = ctx.type_of(a)
        if K.is_variant(t):
            return E(F.try_variant_get(a.column, "$", spark.simpleString()), spark, a.name)
        if kind == "bool":
            text = F.lower(F.trim(as_string(ctx, a)))
            out = a.column.try_cast("boolean") if not isinstance(t, T.StringType) else F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(a.column.try_cast("double") != 0)
            return E(out, BOOL, a.name)
        if kind in ("int", "long"):
            if K.is_time(t):
                from sluice.plans.expr import epoch_micros

                return E((epoch_micros(a.column, t) * 10 + F.lit(621355968000000000)).cast(spark), spark, a.name)
            if K.is_span(t):
                from sluice.plans.expr import micros

                return E((micros(a.column) * 10).try_cast(spark), spark, a.name)
            if isinstance(t, T.StringType):
                hexed = F.lower(a.column).startswith("0x")
                return E(F.when(hexed, F.conv(F.substring(a.column, 3, 16), 16, 10).try_cast(spark)).otherwise(F.coalesce(a.column.try_cast(spark), a.column.try_cast("double").try_cast(spark))), spark, a.name)
        return E(a.column.try_cast(spark), spark, a.name)


_cast("tobool toboolean", "bool")
_cast("tobool_str", "bool")
_cast("toint", "int")
_cast("tolong", "long")
_cast("toreal todouble", "real")
_cast("todecimal decimal", "decimal")
_cast("to_bool", "bool")
_cast("to_int int", "int")
_cast("to_long long", "long")
_cast("to_real to_double real double", "real")
_cast("to_decimal", "decimal")


@function("tostring to_string", 1, kind="B")
def _(ctx, args):
    text = as_string(ctx, args[0])
    return E(F.coalesce(text, F.lit("")) if ctx.options.get("null_as_empty") else text, STRING, args[0].name)


@function("string", 1, kind="B")
def _(ctx, args):
    return E(as_string(ctx, args[0]), STRING)


@function("toguid guid", 1)
def _(ctx, args):
    text = F.lower(F.translate(as_string(ctx, args[0]), "{}", ""))
    return E(F.when(text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), text), STRING)


@function("new_guid", 0, kind="B")
def _(ctx, args):
    return E(F.uuid(), STRING)


@function("tohex", 1, 2, kind="B")
def _(ctx, args):
    text = F.lower(F.hex(args[0].column.cast("long")))
    return E(F.lpad(text, args[1].constant, "0") if len(args) > 1 else text, STRING)


@function("to_utf8 unicode_codepoints_from_string", 1)
def _(ctx, args):
    # four bytes of UTF-32 for each code point, read as a number
    text = as_string(ctx, args[0])
    data = F.hex(F.encode(text, "UTF-32"))  # big-endian
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.conv(F.substring(data, (i - 1) * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return E(F.when(F.char_length(text) == 0, F.array().cast("array<bigint>")).otherwise(each), T.ArrayType(LONG))


def _unify(ctx, items: list[E]) -> tuple[list, T.DataType | None]:
    """Branches of a condition in one type."""
    kinds = [ctx.type_of(i) for i in items]
    known = {k.simpleString(): k for k in kinds if not isinstance(k, T.NullType)}
    if len(known) <= 1:
        t = next(iter(known.values()), T.NullType())
        return [i.column.cast(t) if isinstance(k, T.NullType) and known else i.column for i, k in zip(items, kinds, strict=True)], t
    if all(K.is_numeric(k) for k in known.values()):
        if all(K.is_integral(k) for k in known.values()):
            return [i.column.cast("long") for i in items], LONG
        return [i.column.cast("double") for i in items], DOUBLE
    if any(K.is_variant(k) or K.is_collection(k) for k in known.values()):
        return [as_variant(ctx, i) if not isinstance(k, T.StringType) else i.column.cast("variant") for i, k in zip(items, kinds, strict=True)], T.VariantType()
    if all(K.is_time(k) for k in known.values()):
        return [i.column.cast("timestamp_ntz") for i in items], K.TIMESTAMP
    return [as_string(ctx, i) for i in items], STRING


@function("iff iif if", 3, kind="B")
def _(ctx, args):
    (a, b), t = _unify(ctx, args[1:])
    return E(F.when(truth(ctx, args[0]), a).otherwise(b), t)


@function("case", 3, None, kind="B")
def _(ctx, args):
    values, t = _unify(ctx, [*args[1:-1:2], args[-1]] if len(args) % 2 else args[1::2])
    out = None
    for k, test in enumerate(args[0 : len(args) - 1 : 2]):
        out = F.when(truth(ctx, test), values[k]) if out is None else out.when(truth(ctx, test), values[k])
    return E(out.otherwise(values[-1]) if len(args) % 2 else out, t)


@function("coalesce notnull", 1, None, kind="B")
def _(ctx, args):
    values, t = _unify(ctx, args)
    return E(F.coalesce(*values), t, args[0].name)


@function("isnull", 1, kind="B")
def _(ctx, args):
    (a,) = args
    if K.is_variant(ctx.type_of(a)):
        return E(a.column.isNull() | F.is_variant_null(a.column), BOOL)
    return E(a.column.isNull(), BOOL)


@function("isnotnull", 1, kind="B")
def _(ctx, args):
    (a,) = args
    if K.is_variant(ctx.type_of(a)):
        return E(a.column.isNotNull() & ~F.is_variant_null(a.column), BOOL)
    return E(a.column.isNotNull(), BOOL)


@function("isempty isempty_str", 1)
def _(ctx, args):
    text = as_string(ctx, args[0])
    return E(text.isNull() | (text == ""), BOOL)


@function("isnotempty notempty", 1)
def _(ctx, args):
    text = as_string(ctx, args[0])
    return E(text.isNotNull() & (text != ""), BOOL)


@function("not", 1, kind="B")
def _(ctx, args):
    return E(~truth(ctx, args[0]), BOOL)


@function("between isbetween", 3, kind="B")
def _(ctx, args):
    a, b = matched(ctx, args[0], args[1])
    c, d = matched(ctx, args[0], args[2])
    return E((a >= b) & (c <= d), BOOL)


@raw("column_ifexists columnifexists", 2)
def _(ctx, call):
    first = call.args[0]
    name = first.value if isinstance(first, A.Literal) else first.name
    found = ctx.resolve(name)
    if found is not None:
        return E(q(found), name=found)
    out = compile_expr(ctx, call.args[1])
    out.name = name
    return out


@function("gettype", 1)
def _(ctx, args):
    t = ctx.type_of(args[0])
    if K.is_variant(t):
        kind = F.schema_of_variant(args[0].column)
        return E(F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "dictionary").when(kind == "BIGINT", "long").when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "real").when(kind == "VOID", "null").otherwise(F.lower(kind)), STRING)
    name = "array" if isinstance(t, T.ArrayType) else "dictionary" if isinstance(t, T.StructType | T.MapType) else "null" if isinstance(t, T.NullType) else K.language_type(t)
    return E(F.lit(name), STRING)


@function("todynamic parse_json toobject dynamic parsejson", 1, kind="B")
def _(ctx, args):
    (a,) = args
    t = ctx.type_of(a)
    if K.is_collection(t) or K.is_variant(t):
        return a
    return E(as_variant(ctx, a), T.VariantType(), a.name)


@function("tojson dynamic_to_json", 1, kind="B")
def _(ctx, args):
    (a,) = args
    t = ctx.type_of(a)
    if K.is_collection(t) or K.is_variant(t):
        return E(F.to_json(a.column), STRING)
    if isinstance(t, T.StringType):
        return E(F.to_json(a.column.cast("variant")), STRING)
    return E(as_string(ctx, a), STRING)


@function("assert", 2, kind="B")
def _(ctx, args):
    return E(F.assert_true(truth(ctx, args[0]), args[1].column).isNull(), BOOL)

