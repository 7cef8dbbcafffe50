"""Arrays, sets and property bags."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function, raw
from sluice.plans import types as K
from sluice.plans.expr import E, E_variant, as_array, as_string, as_variant, compile_expr, pack_array, q, truth

STRING, LONG, BOOL, DOUBLE, VARIANT = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.VariantType()


def texts(ctx, e: E) -> Column:
    """An array as texts, in which variants can be compared."""
    a = as_array(ctx, e)
    t = a.type.elementType if isinstance(a.type, T.ArrayType) else STRING
    return F.transform(a.column, lambda x: as_string(ctx, E(x, t)))


def comparable(ctx, *arrays: E) -> tuple[list[Column], T.DataType]:
    """Arrays of one type that set operations can take."""
    found = [as_array(ctx, a) for a in arrays]
    kinds = {f.type.elementType.simpleString(): f.type.elementType for f in found}
    if len(kinds) == 1 and not K.is_variant(t := next(iter(kinds.values()))) and not isinstance(t, T.MapType):
        return [f.column for f in found], t
    if all(K.is_numeric(k) for k in kinds.values()):
        return [f.column.cast("array<double>") for f in found], DOUBLE
    return [texts(ctx, f) for f in found], STRING


@function("array_length", 1, kind="B")
def _(ctx, args):
    t = ctx.type_of(args[0])
    a = as_array(ctx, args[0]) if isinstance(t, T.ArrayType | T.StringType | T.VariantType) else args[0]
    return E(F.when(a.column.isNotNull(), F.size(a.column).cast("long")), LONG)


@function("array_concat", 1, None, kind="B")
def _(ctx, args):
    found = [as_array(ctx, a) for a in args]
    if len({f.type.simpleString() for f in found}) == 1:
        return E(F.concat(*[f.column for f in found]), found[0].type)
    return E(F.concat(*[_variants(ctx, f) for f in found]), T.ArrayType(VARIANT))


def _variants(ctx, f: E) -> Column:
    return F.transform(f.column, lambda x: E_variant(ctx, E(x, f.type.elementType)))


@function("array_contains set_has_element", 2, kind="B")
def _(ctx, args):
    (a,), t = comparable(ctx, args[0])
    x = args[1].column if not isinstance(t, T.StringType) else as_string(ctx, args[1])
    return E(F.array_contains(a, x.cast(t)), BOOL)


@function("array_iff array_iif", 3)
def _(ctx, args):
    test = as_array(ctx, args[0])
    sides = []
    for a in args[1:]:
        t = ctx.type_of(a)
        sides.append((as_array(ctx, a), True) if isinstance(t, T.ArrayType | T.VariantType) else (a, False))
    at = lambda s, i: F.get(s[0].column, i) if s[1] else s[0].column
    kind = test.type.elementType
    return E(F.transform(test.column, lambda x, i: F.when(truth(ctx, E(x, kind)), at(sides[0], i)).otherwise(at(sides[1], i))))


@function("array_index_of", 2, 5)
def _(ctx, args):
    (a,), t = comparable(ctx, args[0])
    x = args[1].column.cast(t) if not isinstance(t, T.StringType) else as_string(ctx, args[1])
    start = args[2].column.cast("int") if len(args) > 2 else F.lit(0)
    at = F.array_position(F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0))), x)
    return E(F.when(at > 0, at - 1 + start).otherwise(-1).cast("long"), LONG)


@function("array_reverse", 1, kind="B")
def _(ctx, args):
    a = as_array(ctx, args[0])
    return E(F.reverse(a.column), a.type)


def _rotate(a: Column, n: Column) -> Column:
    size = F.size(a)
    k = F.when(size > 0, F.pmod(n, size)).otherwise(F.lit(0))
    return F.concat(F.slice(a, k + 1, F.greatest(size - k, F.lit(0))), F.slice(a, F.lit(1), k))


@function("array_rotate_left", 2)
def _(ctx, args):
    a = as_array(ctx, args[0])
    return E(_rotate(a.column, args[1].column.cast("int")), a.type)


@function("array_rotate_right", 2)
def _(ctx, args):
    a = as_array(ctx, args[0])
    return E(_rotate(a.column, -args[1].column.cast("int")), a.type)


def _shift(ctx, args, sign: int) -> E:
    a = as_array(ctx, args[0])
    n = (args[1].column.cast("int") if len(args) > 1 else F.lit(1)) * sign
    fill = args[2].column.cast(a.type.elementType) if len(args) > 2 else F.lit("" if isinstance(a.type.elementType, T.StringType) else None).cast(a.type.elementType)
    return E(F.transform(a.column, lambda x, i: F.when((i + n >= 0) & (i + n < F.size(a.column)), F.get(a.column, i + n)).otherwise(fill)), a.type)


@function("array_shift_left", 1, 3)
def _(ctx, args):
    return _shift(ctx, args, 1)


@function("array_shift_right", 1, 3)
def _(ctx, args):
    return _shift(ctx, args, -1)


@function("array_slice", 3)
def _(ctx, args):
    a = as_array(ctx, args[0])
    size = F.size(a.column)
    place = lambda e: F.when(e.column.cast("int") < 0, e.column.cast("int") + size).otherwise(e.column.cast("int"))
    low, high = F.greatest(place(args[1]), F.lit(0)), F.least(place(args[2]), size - 1)
    return E(F.slice(a.column, low + 1, F.greatest(high - low + 1, F.lit(0))), a.type)


@function("array_split", 2)
def _(ctx, args):
    a = as_array(ctx, args[0])
    size = F.size(a.column)
    cuts = as_array(ctx, args[1]).column if isinstance(ctx.type_of(args[1]), T.ArrayType | T.VariantType) else F.array(args[1].column)
    cuts = F.array_sort(F.transform(cuts, lambda c: F.least(F.greatest(F.when(c.cast("int") < 0, c.cast("int") + size).otherwise(c.cast("int")), F.lit(0)), size)))
    bounds = F.concat(F.array(F.lit(0)), cuts)
    return E(F.transform(bounds, lambda b, i: F.slice(a.column, b + 1, F.greatest(F.coalesce(F.get(cuts, i), size) - b, F.lit(0)))), T.ArrayType(a.type))


def _sorted(ctx, args, ascending: bool) -> E:
    flags = [a for a in args if isinstance(ctx.type_of(a), T.BooleanType)]
    arrays = [a for a in args if a not in flags]
    nulls_last = not (flags and flags[0].constant is False)
    (a,), t = comparable(ctx, arrays[0])
    order = lambda x, y: (lambda less: F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1 if nulls_last else -1).when(y.isNull(), -1 if nulls_last else 1).when(x < y, -less).when(x > y, less).otherwise(0))(1 if ascending else -1)
    if len(arrays) == 1:
        return E(F.array_sort(a, order), T.ArrayType(t))
    zipped = F.transform(a, lambda x, i: F.struct(x.alias("k"), i.alias("i")))
    placed = F.array_sort(zipped, lambda x, y: order(x["k"], y["k"]))
    outs = [F.transform(placed, lambda r: r["k"])] + [_picked(placed, as_array(ctx, b).column) for b in arrays[1:]]
    first = E(outs[0], T.ArrayType(t))
    first.columns = [(f"array{k}_sorted", c) for k, c in enumerate(outs)]
    return first


def _picked(placed: Column, b: Column) -> Column:
    return F.transform(placed, lambda r: F.get(b, r["i"]))


@function("array_sort_asc", 1, None, kind="B")
def _(ctx, args):
    return _sorted(ctx, args, True)


@function("array_sort_desc", 1, None, kind="B")
def _(ctx, args):
    return _sorted(ctx, args, False)


@function("array_sum", 1)
def _(ctx, args):
    from sluice.functions.series import numbers

    return E(F.aggregate(numbers(ctx, args[0]), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))), DOUBLE)


def _set(names: str, build):
    @function(names, 2, None, kind="B")
    def _(ctx, args):
        arrays, t = comparable(ctx, *args)
        out = arrays[0]
        for b in arrays[1:]:
            out = build(out, b)
        return E(out, T.ArrayType(t))


_set("set_union", F.array_union)
_set("set_intersect", F.array_intersect)
_set("set_difference", F.array_except)


@function("set_equals", 2)
def _(ctx, args):
    (a, b), _ = comparable(ctx, *args)
    return E(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), BOOL)


@function("jaccard_index", 2)
def _(ctx, args):
    (a, b), _ = comparable(ctx, *args)
    return E(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), DOUBLE)


@function("pack_array", 1, None)
def _(ctx, args):
    return pack_array(ctx, args)


@function("zip", 2, None, kind="B")
def _(ctx, args):
    found = [as_array(ctx, a) for a in args]
    size = F.greatest(*[F.size(f.column) for f in found])
    one = {f.type.elementType.simpleString() for f in found}
    item = (lambda f, i: F.get(f.column, i)) if len(one) == 1 else (lambda f, i: E_variant(ctx, E(F.get(f.column, i), f.type.elementType)))
    t = found[0].type.elementType if len(one) == 1 else VARIANT
    rows = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.array(*[item(f, i) for f in found]))
    return E(F.when(size > 0, rows).otherwise(F.array().cast(T.ArrayType(T.ArrayType(t)))), T.ArrayType(T.ArrayType(t)))


@function("bag_zip", 2)
def _(ctx, args):
    keys, values = texts(ctx, args[0]), as_array(ctx, args[1])
    full = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values.column, i).alias("value")))
    return E(F.map_from_entries(full), T.MapType(STRING, values.type.elementType))


# ---- bags -----------------------------------------------------------------------------------------------------------


def bag(pairs: list[tuple[str, Column]]) -> E:
    if not pairs:
        return E(F.parse_json(F.lit("{}")), VARIANT)
    return E(F.to_variant_object(F.struct(*[c.alias(k) for k, c in pairs])), VARIANT)


def _packed(ctx, args: list[E]) -> E:
    if all(isinstance(a.constant, str) for a in args[::2]):
        return bag([(k.constant, E_variant(ctx, v)) for k, v in zip(args[::2], args[1::2], strict=False)])
    entries = F.map_from_arrays(F.array(*[as_string(ctx, a) for a in args[::2]]), F.array(*[E_variant(ctx, a) for a in args[1::2]]))
    return E(F.to_variant_object(entries), VARIANT)


@function("bag_pack pack pack_dictionary", 1, None)
def _(ctx, args):
    return _packed(ctx, args)


@raw("pack_all", 0, 1)
def _(ctx, call):
    return bag([(c, E_variant(ctx, E(q(c), next(f.dataType for f in ctx.df.schema.fields if f.name == c)))) for c in ctx.columns()])


@raw("bag_pack_columns", 1, None)
def _(ctx, call):
    return bag([(e.name, E_variant(ctx, e)) for e in (compile_expr(ctx, a) for a in call.args)])


def as_map(ctx, e: E, values: str = "variant") -> Column:
    """A bag as a map from texts."""
    t = ctx.type_of(e)
    if isinstance(t, T.MapType):
        return F.transform_values(e.column, lambda k, v: E_variant(ctx, E(v, t.valueType))) if values == "variant" else F.transform_values(e.column, lambda k, v: as_string(ctx, E(v, t.valueType)))
    return F.try_variant_get(as_variant(ctx, e), "$", f"map<string,{values}>")


@function("bag_keys", 1)
def _(ctx, args):
    return E(F.array_sort(F.map_keys(as_map(ctx, args[0]))), T.ArrayType(STRING))


@function("bag_has_key", 2)
def _(ctx, args):
    key = args[1].constant
    if isinstance(key, str) and key.startswith("$"):
        return E(F.try_variant_get(as_variant(ctx, args[0]), key, "variant").isNotNull(), BOOL)
    return E(F.map_contains_key(as_map(ctx, args[0]), as_string(ctx, args[1])), BOOL)


def _merged(maps: list[Column]) -> Column:
    """The first map with a key wins."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(out, _without(m, out))
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))


@function("bag_merge", 2, None)
def _(ctx, args):
    return E(F.to_variant_object(_merged([F.coalesce(as_map(ctx, a), F.create_map().cast("map<string,variant>")) for a in args])), VARIANT)


@function("bag_remove_keys", 2)
def _(ctx, args):
    gone = texts(ctx, args[1])
    return E(F.to_variant_object(F.map_filter(as_map(ctx, args[0]), lambda k, v: ~F.array_contains(gone, k))), VARIANT)


@function("bag_set_key", 3)
def _(ctx, args):
    one = F.map_from_arrays(F.array(as_string(ctx, args[1])), F.array(E_variant(ctx, args[2])))
    return E(F.to_variant_object(_merged([one, as_map(ctx, args[0])])), VARIANT)


@function("extract_json extractjson", 2, 3, kind="B")
def _(ctx, args):
    out = F.get_json_object(as_string(ctx, args[1]), args[0].constant)
    if len(args) > 2:
        kind = K.spark_type(args[2].constant or args[2].name or "string")
        return E(out.try_cast(kind), kind)
    return E(out, STRING)


def _json_udf(names: str, work, least: int = 1, most: int = 1):
    @function(names, least, most, kind="U")
    def _(ctx, args):
        @F.pandas_udf("string")
        def run(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns, strict=True):
                try:
                    out.append(None if row[0] is None else json.dumps(work(json.loads(row[0]), *row[1:])))
                except ValueError:
                    out.append(None)
            return pd.Series(out, dtype=object)

        return E(F.try_parse_json(run(as_string(ctx, args[0]), *[as_string(ctx, a) for a in args[1:]])), VARIANT)


def flatten(value, prefix: str = "", out: dict | None = None) -> dict:
    out = {} if out is None else out
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if items is None:
        out[prefix] = value
        return out
    for k, v in items:
        flatten(v, (f"{prefix}[{k}]" if isinstance(value, list) else f"{prefix}.{k}") if prefix else str(k), out)
    return out


def paths(value, prefix: str = "") -> list[str]:
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            out.append(f"{prefix}['{k}']")
            out += paths(v, f"{prefix}['{k}']")
    elif isinstance(value, list) and value:
        out.append(f"{prefix}[0]")
        out += [p for p in dict.fromkeys(p for v in value for p in paths(v, f"{prefix}[0]"))]
    return out


_json_udf("json_flatten", flatten)
_json_udf("extend_json", lambda v, more=None: {**v, **(json.loads(more) if more else {})} if isinstance(v, dict) else v, 2, 2)
_json_udf("treepath", lambda v: paths(v))
