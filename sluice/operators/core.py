"""Tabular operators over one table: each is a function (ctx, op) -> Context."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang import ast as A
from sluice.lang.diagnostics import PARAMETER, TRANSLATION, TYPE_MISMATCH, UNKNOWN_COLUMN, QueryError
from sluice.plans import types as K
from sluice.plans.expr import Context, E, as_key, as_string, compile_expr, constant, q, truth

OPERATORS: dict[str, Callable[[Context, A.Op], Context]] = {}


def operator(*names: str):
    def register(run):
        for n in names:
            OPERATORS[n] = run
        return run

    return register


def apply(ctx: Context, op: A.Op) -> Context:
    if op.name not in OPERATORS:
        raise QueryError(TRANSLATION, f"operator {op.name} has no meaning here")
    if ctx.df is None and op.name not in ("print", "range", "union", "find", "search", "externaldata", "evaluate"):
        raise QueryError(TRANSLATION, f"{op.name} needs a table before it")
    return OPERATORS[op.name](ctx, op)


# ---- helpers --------------------------------------------------------------------------------------------------------


def kept(ctx: Context) -> list[Column]:
    """The hidden and carried columns, which every projection keeps."""
    return [q(c) for c in (*ctx.hidden, *ctx.carried) if c in ctx.df.columns]


def wildcard(text: str) -> re.Pattern:
    return re.compile("".join(".*" if c == "*" else re.escape(c) for c in text), re.I)


def expand(ctx: Context, e: A.Expr, strict: bool = True) -> list[str]:
    """The columns that a name or a pattern means."""
    if isinstance(e, A.Pattern):
        return [c for c in ctx.columns() if wildcard(e.text).fullmatch(c)]
    found = ctx.resolve(e.name)
    if found is None:
        if strict:
            raise QueryError(UNKNOWN_COLUMN, f"no column {e.name!r}")
        return []
    return [found]


def fresh(base: str, taken: list[str]) -> str:
    low = {t.lower() for t in taken}
    if base.lower() not in low:
        return base
    k = 1
    while f"{base}{k}".lower() in low:
        k += 1
    return f"{base}{k}"


def outputs(ctx: Context, items: list[A.Expr], prefix: str = "Column") -> list[tuple[str, Column]]:
    """Names and columns of a projection's items."""
    out: list[tuple[str, Column]] = []
    taken = lambda: [n for n, _ in out]
    for k, item in enumerate(items):
        if isinstance(item, A.Pattern | A.Star):
            out += [(c, q(c)) for c in (ctx.columns() if isinstance(item, A.Star) else expand(ctx, item))]
            continue
        names = item.names if isinstance(item, A.Named) else None
        e = compile_expr(ctx, item.value if names else item)
        if names and len(names) > 1:
            out += spread(ctx, names, e)
        elif e.columns and not names:
            out += [(fresh(n, taken()), c) for n, c in e.columns]
        else:
            out.append((names[0] if names else fresh(e.name or f"{prefix}{k + 1}", taken()), e.column))
    return out


def spread(ctx: Context, names: list[str], e: E) -> list[tuple[str, Column]]:
    """(a, b) = e: several outputs of a function, fields of a struct, elements of an array."""
    if e.columns:
        return [(n, c) for n, (_, c) in zip(names, e.columns, strict=False)]
    t = ctx.type_of(e)
    if isinstance(t, T.StructType):
        return [(n, e.column[f.name]) for n, f in zip(names, t.fields, strict=False)]
    if isinstance(t, T.ArrayType):
        return [(n, F.get(e.column, F.lit(k))) for k, n in enumerate(names)]
    return [(n, F.try_variant_get(e.column, f"$[{k}]", "variant")) for k, n in enumerate(names)]


def with_columns(ctx: Context, items: list[tuple[str, Column]]) -> DataFrame:
    """Replaced in place where the name is there, else appended."""
    df = ctx.df
    present = {c.lower(): c for c in df.columns}
    new = {n.lower(): (n, c) for n, c in items}
    columns = [new[c.lower()][1].alias(c) if c.lower() in new and c not in ctx.hidden else q(c) for c in df.columns]
    columns += [c.alias(n) for low, (n, c) in new.items() if low not in present]
    return df.select(*columns)


def project(ctx: Context, items: list[tuple[str, Column]]) -> Context:
    return ctx.with_(df=ctx.df.select(*[c.alias(n) for n, c in items], *kept(ctx)))


def whole_number(ctx: Context, e: A.Expr, what: str) -> int:
    n = constant(ctx, e, f"a number of rows for {what}")
    if not isinstance(n, int | float):
        raise QueryError(PARAMETER, f"{what} needs a number")
    return int(n)


def sort_columns(ctx: Context, keys: list[tuple]) -> list[Column]:
    out = []
    for e, way, nulls in keys:
        c = as_key(ctx, compile_expr(ctx, e))
        down = way in (None, "desc", "granny-desc") if not ctx.sql else way == "desc"
        first = nulls == "first" if nulls else not down
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def limited(ctx: Context, n: int, order: list[Column] | None) -> DataFrame:
    """The first n rows; of each hidden key, if there are any."""
    if not ctx.hidden:
        return (ctx.df.orderBy(*order) if order else ctx.df).limit(n)
    w = Window.partitionBy(*[q(h) for h in ctx.hidden]).orderBy(*(order or [F.lit(1)]))
    return ctx.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


# ---- rows and columns -----------------------------------------------------------------------------------------------


@operator("where", "filter")
def _(ctx: Context, op: A.Op) -> Context:
    """Membership in a table that is and-ed becomes a semi or anti join, all else a filter."""
    df = ctx.df
    for part in conjuncts(op.parts["predicate"]):
        here = ctx.with_(df=df)
        joined = membership(here, part)
        df = joined if joined is not None else _filtered(here, part)
    return ctx.with_(df=df)


def _filtered(ctx: Context, predicate: A.Expr) -> DataFrame:
    before = set(ctx.df.columns)
    test = truth(ctx, compile_expr(ctx, predicate))
    added = [c for c in ctx.df.columns if c not in before]
    if added or "OVER" in str(test) or "Window" in str(test):  # windows cannot stand in a filter
        return ctx.df.withColumn("__p", test).where(F.col("__p")).drop("__p", *added)
    return ctx.df.where(test)


def conjuncts(e: A.Expr) -> list[A.Expr]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Binary) and e.op == "and" else [e]


def membership(ctx: Context, e: A.Expr) -> DataFrame | None:
    if not (isinstance(e, A.Among) and len(e.items) == 1 and e.op in ("in", "!in", "in~", "!in~")):
        return None
    item = e.items[0]
    if not isinstance(item, A.Sub) and not (isinstance(item, A.Name) and ctx.resolve(item.name) is None and ctx.engine.is_table(ctx, item.name)):
        return None
    table = ctx.engine.table_of(ctx, item)
    value = as_key(ctx, compile_expr(ctx, e.operand))
    other = ctx.with_(df=table, hidden=[], carried=[])
    key = as_key(other, E(q(table.columns[0]), table.schema[0].dataType))
    if "~" in e.op:
        value, key = F.lower(value.cast("string")), F.lower(key.cast("string"))
    right = table.select(key.alias("__v"))
    left = ctx.df.withColumn("__k", value)
    if e.op.startswith("!"):
        return left.join(right, F.col("__k") == F.col("__v"), "left_anti").drop("__k")
    return left.join(right, F.col("__k") == F.col("__v"), "left_semi").drop("__k")


@operator("project")
def _(ctx: Context, op: A.Op) -> Context:
    here = ctx.with_()
    items = outputs(here, op.parts["columns"])
    return project(here, items)


@operator("extend")
def _(ctx: Context, op: A.Op) -> Context:
    for item in op.parts["columns"]:
        here = ctx.with_()
        items = outputs(here, [item])
        ctx = here.with_(df=with_columns(here, items))
    return ctx


@operator("serialize")
def _(ctx: Context, op: A.Op) -> Context:
    if not ctx.order:
        ctx = ctx.with_(order=[F.col("__serial").asc()], df=ctx.df.withColumn("__serial", F.monotonically_increasing_id()), carried=[*ctx.carried, "__serial"])
    return OPERATORS["extend"](ctx, op)


@operator("project-away")
def _(ctx: Context, op: A.Op) -> Context:
    gone = {c for e in op.parts["columns"] for c in expand(ctx, e)}
    return ctx.with_(df=ctx.df.drop(*gone))


@operator("project-keep")
def _(ctx: Context, op: A.Op) -> Context:
    stay = {c for e in op.parts["columns"] for c in expand(ctx, e)}
    return project(ctx, [(c, q(c)) for c in ctx.columns() if c in stay])


@operator("project-rename")
def _(ctx: Context, op: A.Op) -> Context:
    renamed = {expand(ctx, A.Name(old))[0]: new for new, old in op.parts["columns"]}
    return project(ctx, [(renamed.get(c, c), q(c)) for c in ctx.columns()])


@operator("project-reorder", "project-smart")
def _(ctx: Context, op: A.Op) -> Context:
    first: list[str] = []
    for e, way in op.parts["columns"]:
        found = [c for c in expand(ctx, e) if c not in first]
        if way:
            number = lambda c: [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", c)] if "granny" in way else c.lower()  # noqa: B023, E731
            found.sort(key=number, reverse=way.endswith("desc"))
        first += found
    return project(ctx, [(c, q(c)) for c in first + [c for c in ctx.columns() if c not in first]])


@operator("take", "limit")
def _(ctx: Context, op: A.Op) -> Context:
    return ctx.with_(df=limited(ctx, whole_number(ctx, op.parts["count"], op.name), ctx.order if ctx.hidden else None))


@operator("sample")
def _(ctx: Context, op: A.Op) -> Context:
    n = whole_number(ctx, op.parts["count"], "sample")
    return ctx.with_(df=limited(ctx, n, [F.rand(ctx.options.get("seed"))]))


@operator("sample-distinct")
def _(ctx: Context, op: A.Op) -> Context:
    n = whole_number(ctx, op.parts["count"], "sample-distinct")
    ((name, c),) = outputs(ctx, [op.parts["column"]])
    here = project(ctx, [(name, c)])
    return ctx.with_(df=limited(ctx.with_(df=here.df.distinct()), n, None), order=None)


@operator("distinct")
def _(ctx: Context, op: A.Op) -> Context:
    items = [(n, c) for n, c in outputs(ctx, op.parts["columns"])]
    here = ctx.with_(df=ctx.df.select(*[as_key(ctx, E(c)).alias(n) for n, c in items], *[q(h) for h in ctx.hidden]))
    if ctx.carried:
        names = [n for n, _ in items] + ctx.hidden
        full = project(ctx, items).df
        return ctx.with_(df=full.groupBy(*[q(n) for n in names]).agg(*[F.any_value(q(c)).alias(c) for c in ctx.carried]), order=None)
    return here.with_(df=here.df.distinct(), order=None)


@operator("as")
def _(ctx: Context, op: A.Op) -> Context:
    ctx.scope.bind(op.parts["name"], ctx.df)
    ctx.df.createOrReplaceTempView(op.parts["name"])
    return ctx


@operator("invoke")
def _(ctx: Context, op: A.Op) -> Context:
    return ctx.with_(df=ctx.engine.call_table(ctx, op.parts["function"], op.parts["args"], ctx.df), order=None)


@operator("consume")
def _(ctx: Context, op: A.Op) -> Context:
    return ctx.with_(df=ctx.df.limit(0))


@operator("getschema")
def _(ctx: Context, op: A.Op) -> Context:
    fields = [f for f in ctx.df.schema.fields if f.name in ctx.columns()]
    rows = [(f.name, k, f.dataType.simpleString(), K.language_type(f.dataType)) for k, f in enumerate(fields)]
    return ctx.with_(df=ctx.engine.spark.createDataFrame(rows, "ColumnName string, ColumnOrdinal long, DataType string, ColumnType string"), order=None)


@operator("render")
def _(ctx: Context, op: A.Op) -> Context:
    ctx.engine.last_render = {"kind": op.parts["kind"], **op.params, **op.parts["with"]}
    return ctx


@operator("assert-schema")
def _(ctx: Context, op: A.Op) -> Context:
    have = {f.name.lower(): f.dataType for f in ctx.df.schema.fields}
    for name, kind in op.parts["schema"]:
        if name.lower() not in have:
            raise QueryError(UNKNOWN_COLUMN, f"the schema lacks column {name!r}")
        if (found := K.language_type(have[name.lower()])) != K.language_type(K.spark_type(kind)):
            raise QueryError(TYPE_MISMATCH, f"column {name!r} is {found}, not {kind}")
    return ctx


@operator("execute-and-cache")
def _(ctx: Context, op: A.Op) -> Context:
    # nothing is persisted: what a session keeps in memory would outlive the query, and Spark reuses equal parts of a plan
    return ctx


@operator("macro-expand")
def _(ctx: Context, op: A.Op) -> Context:
    if "function" in op.parts:
        return OPERATORS["invoke"](ctx, op)
    group = op.parts["group"]
    members = ctx.engine.entity_group(ctx, group) if isinstance(group, A.Name) else group
    parts = []
    for m in members:
        inner = ctx.engine.scope_with(ctx, {op.parts["name"]: ctx.engine.table_of(ctx, m)})
        parts.append(ctx.engine.pipeline(inner, op.parts["body"]))
    return ctx.with_(df=union_all(parts), order=None)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---- order ----------------------------------------------------------------------------------------------------------


@operator("sort", "order")
def _(ctx: Context, op: A.Op) -> Context:
    order = sort_columns(ctx, op.parts["keys"])
    if ctx.hidden:
        return ctx.with_(order=order)
    return ctx.with_(df=ctx.df.orderBy(*order), order=order)


@operator("top")
def _(ctx: Context, op: A.Op) -> Context:
    keys = [(e, way or "desc", nulls or ("last" if (way or "desc") == "desc" else None)) for e, way, nulls in op.parts["keys"]]
    order = sort_columns(ctx, keys)
    return ctx.with_(df=limited(ctx, whole_number(ctx, op.parts["count"], "top"), order), order=order)


@operator("count")
def _(ctx: Context, op: A.Op) -> Context:
    name = op.parts.get("as") or ("Count_" if ctx.sql else "Count")
    if ctx.hidden:
        return ctx.with_(df=ctx.df.groupBy(*[q(h) for h in ctx.hidden]).agg(F.count(F.lit(1)).alias(name), *[F.any_value(q(c)).alias(c) for c in ctx.carried]), order=None)
    return ctx.with_(df=ctx.df.agg(F.count(F.lit(1)).alias(name)), order=None)


# ---- aggregation ----------------------------------------------------------------------------------------------------


def aggregate_outputs(ctx: Context, items: list[A.Expr], taken: list[str]) -> list[tuple[str, Column]]:
    inner = ctx.with_(aggregates=True)
    out: list[tuple[str, Column]] = []
    names = lambda: taken + [n for n, _ in out]
    for k, item in enumerate(items):
        given = item.names if isinstance(item, A.Named) else None
        e = compile_expr(inner, item.value if given else item)
        if e.columns and (given is None or len(given) > 1):
            for j, (n, c) in enumerate(e.columns):
                out.append((given[j] if given and j < len(given) else fresh(n, names()), c))
        elif e.columns and given and len(e.columns) > 1:  # n = arg_max(x, y): the first gets the name
            for j, (n, c) in enumerate(e.columns):
                out.append((given[0] if j == 0 else fresh(n, names()), c))
        else:
            name = given[0] if given else (f"agg{k}" if ctx.sql else fresh(e.name or f"Column{k + 1}", names()))
            out.append((name, e.column))
    return out


def group_keys(ctx: Context, items: list[A.Expr], legacy: E | None = None) -> list[tuple[str, Column]]:
    out = []
    for k, item in enumerate(items):
        e = compile_expr(ctx, item)
        if legacy is not None and k == len(items) - 1:
            from sluice.functions.datetimes import binned

            e = binned(ctx, e, legacy)
        name = item.names[0] if isinstance(item, A.Named) else e.name or (f"key{k}" if ctx.sql else f"Column{k + 1}")
        out.append((fresh(name, [n for n, _ in out]), as_key(ctx, e)))
    return out


@operator("summarize")
def _(ctx: Context, op: A.Op) -> Context:
    here = ctx.with_()
    legacy = compile_expr(here, op.parts["bin"]) if "bin" in op.parts else None
    keys = group_keys(here, op.parts["by"], legacy)
    aggregates = aggregate_outputs(here, op.parts["aggregates"], [n for n, _ in keys])
    by = [c.alias(n) for n, c in keys] + [q(h) for h in here.hidden]
    aggregates += [(c, F.any_value(q(c))) for c in ctx.carried]
    if not aggregates:
        return ctx.with_(df=here.df.select(*by).distinct(), order=None)
    columns = [c.alias(n) for n, c in aggregates]
    df = here.df.groupBy(*by).agg(*columns) if by else here.df.agg(*columns)
    return ctx.with_(df=df, order=None)


@operator("top-hitters")
def _(ctx: Context, op: A.Op) -> Context:
    n = whole_number(ctx, op.parts["count"], "top-hitters")
    ((name, c),) = outputs(ctx, [op.parts["column"]])
    by = op.parts["by"]
    weight = F.sum(compile_expr(ctx, by).column) if by is not None else F.count(F.lit(1))
    label = "approximate_sum_" + (compile_expr(ctx, by).name or "") if by is not None else f"approximate_count_{name}"
    df = ctx.df.groupBy(as_key(ctx, E(c)).alias(name)).agg(weight.alias(label)).orderBy(q(label).desc(), q(name).asc()).limit(n)
    return ctx.with_(df=df, order=[q(label).desc(), q(name).asc()])


@operator("top-nested")
def _(ctx: Context, op: A.Op) -> Context:
    """Level by level: the n best values within each value above, by a window over the grouped rows."""
    base, keys, out = ctx.df, [], None
    for level in op.parts["levels"]:
        here = ctx.with_(df=base)
        ((name, c),) = outputs(here, [level["column"]])
        ((agg, a),) = aggregate_outputs(here, [level["by"]], [])
        agg = agg if isinstance(level["by"], A.Named) else f"aggregated_{name}"
        base = base.withColumn(f"__{name}", as_key(here, E(c)))
        here = ctx.with_(df=base)
        ((_, a),) = aggregate_outputs(here, [level["by"]], [])
        grouped = base.groupBy(*[q(f"__{k}") for k in keys], q(f"__{name}")).agg(a.alias(agg))
        if level["count"] is not None:
            n = whole_number(here, level["count"], "top-nested")
            order = q(agg).asc_nulls_last() if level["way"] == "asc" else q(agg).desc_nulls_last()
            w = Window.partitionBy(*[q(f"__{k}") for k in keys]).orderBy(order, q(f"__{name}")) if keys else Window.orderBy(order, q(f"__{name}"))
            best = grouped.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n") if keys else grouped.orderBy(order, q(f"__{name}")).limit(n)
        else:
            best = grouped
        chosen = [f"__{k}" for k in (*keys, name)]
        if level["others"] is not None:
            label = compile_expr(here, level["others"]).column
            stay = best.select(*[q(k).alias(f"{k}s") for k in chosen])
            same = F.lit(True)
            for k in chosen:
                same = same & q(k).eqNullSafe(q(f"{k}s"))
            other = base.join(stay, same, "left_anti")
            if out is not None:
                other = other.join(out.select(*[q(f"__{k}") for k in keys]).distinct(), [f"__{k}" for k in keys], "left_semi") if keys else other
            rest = other.groupBy(*[q(f"__{k}") for k in keys]).agg(a.alias(agg)) if keys else other.agg(a.alias(agg))
            best = best.unionByName(rest.withColumn(f"__{name}", label.cast(best.schema[f"__{name}"].dataType)))
        out = best if out is None else out.join(best, [f"__{k}" for k in keys])
        base = base.join(best.select(*[q(k) for k in chosen]).distinct(), chosen, "left_semi")
        keys.append(name)
        out = out.withColumnRenamed(agg, fresh(agg, [c for c in out.columns if c != agg]))
    renamed = [q(c).alias(c.removeprefix("__")) for c in out.columns]
    ordered: list[Column] = []
    for name in keys:
        ordered.append(q(f"__{name}").alias(name))
    rest = [r for r, c in zip(renamed, out.columns, strict=True) if c.removeprefix("__") not in keys]
    return ctx.with_(df=out.select(*[x for pair in zip(ordered, rest, strict=False) for x in pair]), order=None)


@operator("reduce")
def _(ctx: Context, op: A.Op) -> Context:
    """Texts whose varying words (those with digits) are masked fall into patterns."""
    e = compile_expr(ctx, op.parts["column"])
    text = as_string(ctx, e)
    mask = op.parts["with"].get("characters", "")
    pattern = F.regexp_replace(text, rf"[^\s{re.escape(str(mask))}]*\d[^\s{re.escape(str(mask))}]*", "*")
    grouped = ctx.df.select(pattern.alias("Pattern"), text.alias("t")).groupBy("Pattern").agg(F.count(F.lit(1)).alias("Count"), F.min("t").alias("Representative"))
    return ctx.with_(df=grouped.orderBy(F.desc("Count"), "Pattern"), order=[F.desc("Count")])


# ---- several results ------------------------------------------------------------------------------------------------


@operator("fork")
def _(ctx: Context, op: A.Op) -> Context:
    results = {name: run_ops(ctx.with_(), ops).df for name, ops in op.parts["branches"]}
    ctx.engine.results = results
    return ctx.with_(df=next(iter(results.values())), order=None)


@operator("facet")
def _(ctx: Context, op: A.Op) -> Context:
    results = {}
    for e in op.parts["columns"]:
        ((name, c),) = outputs(ctx, [e])
        results[name] = ctx.df.groupBy(as_key(ctx, E(c)).alias(name)).agg(F.count(F.lit(1)).alias(f"count_{name}"))
    if op.parts["body"]:
        results["with"] = run_ops(ctx.with_(), op.parts["body"]).df
    ctx.engine.results = results
    return ctx.with_(df=next(iter(results.values())), order=None)


def run_ops(ctx: Context, ops: list[A.Op]) -> Context:
    for op in ops:
        ctx = apply(ctx, op)
    return ctx


@operator("partition")
def _(ctx: Context, op: A.Op) -> Context:
    """The operators run for each key at once: the key is a hidden column of every grouping and window."""
    key = as_key(ctx, compile_expr(ctx, op.parts["column"]))
    here = ctx.with_(df=ctx.df.withColumn("__key", key), hidden=[*ctx.hidden, "__key"])
    out = run_ops(here, op.parts["body"])
    df = out.df.drop("__key", *[c for c in out.carried if c not in ctx.carried])
    return ctx.with_(df=df, order=None)

