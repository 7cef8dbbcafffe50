"""Aggregate functions. A builder may give several output columns (E.columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.arrays import as_map
from sluice.functions.registry import function, put
from sluice.lang import ast as A
from sluice.plans import types as K
from sluice.plans.expr import E, as_double, as_key, as_numeric, as_string, compile_expr, constants, q, truth

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()


def aggregate(names: str, least: int, most: int | None = -1, prefix: str | None = None):
    """Register build(ctx, args); unnamed outputs are prefix_column."""

    def register(build):
        for name in names.split():
            def run(ctx, call, name=name):
                args = [compile_expr(ctx, a) for a in call.args]
                out = build(ctx, args)
                first = args[0].name if args else None
                out.name = f"{prefix or name}_{first or ''}"
                return out

            put(name, least, least if most == -1 else most, "aggregate", run)
        return build

    return register


def only(ctx, args: list[E], at: int = 1) -> tuple[Column, Column]:
    """The value where the predicate holds."""
    p = truth(ctx, args[at])
    return p, F.when(p, args[0].column)


@aggregate("count", 0, 1)
def _(ctx, args):
    return E(F.count(args[0].column if args else F.lit(1)), LONG)


@aggregate("countif", 1)
def _(ctx, args):
    return E(F.count_if(truth(ctx, args[0])), LONG)


def _numeric(name: str, build, result=None, keep_integers: bool = False):
    @aggregate(name, 1)
    def _(ctx, args):
        n = as_numeric(ctx, args[0])
        if isinstance(ctx.type_of(n), T.BooleanType):
            n = E(n.column.cast("long"), LONG)
        return E(build(n.column), result)

    @aggregate(f"{name}if", 2)
    def _(ctx, args):
        n = as_numeric(ctx, args[0])
        other = F.lit(0) if name == "sum" and not K.is_span(ctx.type_of(n)) else None
        p = truth(ctx, args[1])
        return E(build(F.when(p, n.column).otherwise(other) if other is not None else F.when(p, n.column)), result)


_numeric("sum", F.sum)
_numeric("avg", F.avg)
_numeric("stdev", F.stddev_samp, DOUBLE)


for _name, _build in {"min": F.min, "max": F.max}.items():

    @aggregate(_name, 1)
    def _(ctx, args, build=_build):
        return E(build(as_key(ctx, args[0])))

    @aggregate(f"{_name}if", 2)
    def _(ctx, args, build=_build):
        return E(build(F.when(truth(ctx, args[1]), as_key(ctx, args[0]))))


for _name, _build in {"stdevp": F.stddev_pop, "variance": F.var_samp, "variancep": F.var_pop}.items():

    @aggregate(_name, 1)
    def _(ctx, args, build=_build):
        return E(build(as_double(ctx, args[0])), DOUBLE)

    @aggregate(f"{_name}if", 2)
    def _(ctx, args, build=_build):
        return E(build(F.when(truth(ctx, args[1]), as_double(ctx, args[0]))), DOUBLE)


def _distinct(ctx, column: Column, accuracy: E | None) -> E:
    if ctx.options.get("approximate") or accuracy is not None and ctx.options.get("dcount_accuracy"):
        return E(F.approx_count_distinct(column), LONG)
    return E(F.count_distinct(column), LONG)


@aggregate("dcount", 1, 2)
def _(ctx, args):
    return _distinct(ctx, as_key(ctx, args[0]), args[1] if len(args) > 1 else None)


@aggregate("count_distinct", 1)
def _(ctx, args):
    return E(F.count_distinct(as_key(ctx, args[0])), LONG)


@aggregate("dcountif", 2, 3)
def _(ctx, args):
    return _distinct(ctx, F.when(truth(ctx, args[1]), as_key(ctx, args[0])), args[2] if len(args) > 2 else None)


@aggregate("count_distinctif", 2)
def _(ctx, args):
    return E(F.count_distinct(F.when(truth(ctx, args[1]), as_key(ctx, args[0]))), LONG)


def _star_columns(ctx, but: str | None) -> list[tuple[str, E]]:
    return [(c, E(q(c), next(f.dataType for f in ctx.df.schema.fields if f.name == c))) for c in ctx.columns() if c != but]


def _take_any(names: str, conditional: bool):
    def build(ctx, call):
        p = truth(ctx, compile_expr(ctx, call.args[1])) if conditional else None
        items: list[tuple[str, E]] = []
        for a in call.args[:1] if conditional else call.args:
            if isinstance(a, A.Star):
                items += _star_columns(ctx, None)
            else:
                e = compile_expr(ctx, a)
                items.append((e.name or names.split()[0] + "_", e))
        if len(items) == 1:
            # the greatest, so that equal inputs give equal results
            c = as_key(ctx, items[0][1])
            return E(F.max(F.when(p, c) if conditional else c), items[0][1].type, items[0][0])
        one = F.max(F.struct(*[as_key(ctx, e).alias(f"c{k}") for k, (_, e) in enumerate(items)]))
        return E(one, None, columns=[(n, one[f"c{k}"]) for k, (n, _) in enumerate(items)])

    for n in names.split():
        put(n, 1, None if not conditional else 2, "aggregate", build)


_take_any("any take_any anyvalue", False)
_take_any("anyif take_anyif", True)


def _arg(name: str, build):
    def run(ctx, call):
        first = compile_expr(ctx, call.args[0])
        rest: list[tuple[str, E]] = []
        if ctx.sql:  # the value at the extreme of the second argument
            by = compile_expr(ctx, call.args[1])
            return E(build(first.column, as_key(ctx, by)), first.type, f"{name}_{first.name or ''}")
        for a in call.args[1:]:
            if isinstance(a, A.Star):
                rest += _star_columns(ctx, first.name)
            else:
                e = compile_expr(ctx, a)
                rest.append((e.name or f"{name}_", e))
        key = as_key(ctx, first)
        extreme = F.max(key) if name == "arg_max" else F.min(key)
        if not rest:
            return E(extreme, first.type, first.name or f"{name}_")
        # ties: the greatest of the other columns, so that equal inputs give equal results
        whole = F.struct(*[as_key(ctx, e).alias(f"c{k}") for k, (_, e) in enumerate(rest)])
        best = F.max(F.struct(key.alias("k"), whole.alias("v"))) if name == "arg_max" else F.min(F.when(key.isNotNull(), F.struct(key.alias("k"), whole.alias("v"))))
        columns = [(first.name or f"{'max' if name == 'arg_max' else 'min'}_", best["k"])]
        columns += [(n, best["v"][f"c{k}"]) for k, (n, _) in enumerate(rest)]
        return E(columns[-1][1], None, f"{name}_{first.name or ''}", columns=columns)

    put(f"{name} {name.replace('_', '')}", 2, None, "aggregate", run)


_arg("arg_max", F.max_by)
_arg("arg_min", F.min_by)


@aggregate("make_list makelist", 1, 2, prefix="list")
def _(ctx, args):
    out = F.collect_list(args[0].column)
    t = ctx.type_of(args[0])
    return E(F.slice(out, F.lit(1), args[1].column.cast("int")) if len(args) > 1 else out, T.ArrayType(t))


@aggregate("make_list_with_nulls", 1, prefix="list")
def _(ctx, args):
    t = ctx.type_of(args[0])
    return E(F.transform(F.collect_list(F.struct(args[0].column.alias("v"))), lambda s: s["v"]), T.ArrayType(t))


@aggregate("make_list_if", 2, 3, prefix="list")
def _(ctx, args):
    out = F.collect_list(only(ctx, args)[1])
    return E(F.slice(out, F.lit(1), args[2].column.cast("int")) if len(args) > 2 else out, T.ArrayType(ctx.type_of(args[0])))


def _set(ctx, column: Column, most: E | None) -> E:
    out = F.array_sort(F.collect_set(column))
    return E(F.slice(out, F.lit(1), most.column.cast("int")) if most is not None else out)


@aggregate("make_set makeset", 1, 2, prefix="set")
def _(ctx, args):
    return _set(ctx, as_key(ctx, args[0]), args[1] if len(args) > 1 else None)


@aggregate("make_set_if", 2, 3, prefix="set")
def _(ctx, args):
    return _set(ctx, F.when(truth(ctx, args[1]), as_key(ctx, args[0])), args[2] if len(args) > 2 else None)


def _bags(ctx, column: Column) -> E:
    # of a repeated key one value stays: the greatest as text
    entries = F.flatten(F.collect_list(F.map_entries(column)))
    plain = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    merged = F.aggregate(F.array_sort(plain), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return E(F.to_variant_object(F.transform_values(merged, lambda k, v: F.try_parse_json(v))), T.VariantType())


@aggregate("make_bag make_dictionary", 1, 2, prefix="bag")
def _(ctx, args):
    return _bags(ctx, as_map(ctx, args[0]))


@aggregate("make_bag_if", 2, 3, prefix="bag")
def _(ctx, args):
    return _bags(ctx, F.when(truth(ctx, args[1]), as_map(ctx, args[0])))


@aggregate("buildschema", 1, prefix="schema")
def _(ctx, args):
    from sluice.plans.expr import as_variant

    return E(F.schema_of_variant_agg(as_variant(ctx, args[0])), STRING)


for _name, _build in {"binary_all_and": F.bit_and, "binary_all_or": F.bit_or, "binary_all_xor": F.bit_xor}.items():

    @aggregate(_name, 1)
    def _(ctx, args, build=_build):
        return E(build(args[0].column.cast("long")), LONG)


def _shares(args: list[E]) -> list[float]:
    out: list[float] = []
    for a in args:
        out += constants(a)
    return out


def _label(p) -> str:
    return str(p).replace(".", "_")


def _quantile(ctx, column: Column, p, weight: Column | None = None) -> Column:
    if ctx.options.get("approximate") and weight is None:
        return F.percentile_approx(column, F.lit(p / 100))
    return F.percentile(column, F.lit(p / 100), weight) if weight is not None else F.percentile(column, F.lit(p / 100))


@aggregate("percentile", 2)
def _(ctx, args):
    out = E(_quantile(ctx, as_double(ctx, args[0]), args[1].constant), DOUBLE)
    out.columns = [(f"percentile_{args[0].name or ''}_{_label(args[1].constant)}", out.column)]
    return out


@aggregate("percentileif", 3)
def _(ctx, args):
    return E(_quantile(ctx, F.when(truth(ctx, args[2]), as_double(ctx, args[0])), args[1].constant), DOUBLE)


@aggregate("percentiles", 2, None)
def _(ctx, args):
    x = as_double(ctx, args[0])
    columns = [(f"percentile_{args[0].name or ''}_{_label(p)}", _quantile(ctx, x, p)) for p in _shares(args[1:])]
    return E(columns[0][1], DOUBLE, columns=columns)


@aggregate("percentiles_array", 2, None)
def _(ctx, args):
    x = as_double(ctx, args[0])
    return E(F.array(*[_quantile(ctx, x, p) for p in _shares(args[1:])]), T.ArrayType(DOUBLE))


@aggregate("percentilew", 3)
def _(ctx, args):
    return E(_quantile(ctx, as_double(ctx, args[0]), args[2].constant, args[1].column.cast("long")), DOUBLE)


@aggregate("percentilesw", 3, None)
def _(ctx, args):
    x, w = as_double(ctx, args[0]), args[1].column.cast("long")
    columns = [(f"percentile_{args[0].name or ''}_{_label(p)}", _quantile(ctx, x, p, w)) for p in _shares(args[2:])]
    return E(columns[0][1], DOUBLE, columns=columns)


@aggregate("percentilesw_array", 3, None)
def _(ctx, args):
    x, w = as_double(ctx, args[0]), args[1].column.cast("long")
    return E(F.array(*[_quantile(ctx, x, p, w) for p in _shares(args[2:])]), T.ArrayType(DOUBLE))


# ---- sketches: a different layout from other engines', the same use -------------------------------------------------


@aggregate("hll", 1, 2)
def _(ctx, args):
    return E(F.hll_sketch_agg(as_string(ctx, args[0])), T.BinaryType())


@aggregate("hll_merge", 1)
def _(ctx, args):
    return E(F.hll_union_agg(args[0].column), T.BinaryType())


@aggregate("tdigest", 1, 2)
def _(ctx, args):
    return E(F.kll_sketch_agg_double(as_double(ctx, args[0])), T.BinaryType())


@aggregate("tdigest_merge", 1)
def _(ctx, args):
    return E(F.kll_merge_agg_double(args[0].column), T.BinaryType())


@function("dcount_hll", 1, kind="B")
def _(ctx, args):
    return E(F.hll_sketch_estimate(args[0].column), LONG)


@function("hll_isvalid", 1)
def _(ctx, args):
    return E(F.octet_length(args[0].column) > 0, T.BooleanType())


@function("tdigest_isvalid", 1)
def _(ctx, args):
    return E(F.octet_length(args[0].column) > 0, T.BooleanType())


@function("merge_tdigest", 2, None, kind="B")
def _(ctx, args):
    out = args[0].column
    for a in args[1:]:
        out = F.kll_sketch_merge_double(out, a.column)
    return E(out, T.BinaryType())


@function("percentile_tdigest", 2, 3, kind="B")
def _(ctx, args):
    return E(F.kll_sketch_get_quantile_double(args[0].column, as_double(ctx, args[1]) / 100), DOUBLE)


@function("percentiles_array_tdigest", 2, None, kind="B")
def _(ctx, args):
    return E(F.array(*[F.kll_sketch_get_quantile_double(args[0].column, F.lit(float(p) / 100)) for p in _shares(args[1:])]), T.ArrayType(DOUBLE))


@function("percentrank_tdigest", 2, kind="B")
def _(ctx, args):
    return E(F.kll_sketch_get_rank_double(args[0].column, as_double(ctx, args[1])) * 100, DOUBLE)


@function("rank_tdigest", 2, kind="B")
def _(ctx, args):
    return E(F.round(F.kll_sketch_get_rank_double(args[0].column, as_double(ctx, args[1])) * F.kll_sketch_get_n_double(args[0].column)), DOUBLE)
