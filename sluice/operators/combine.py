"""Operators that make rows or bring tables together: join, lookup, union, find, search, range, print, externaldata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang import ast as A
from sluice.lang.diagnostics import PARAMETER, QueryError
from sluice.operators.core import fresh, operator, outputs, union_all
from sluice.plans import types as K
from sluice.plans.expr import Context, E, arithmetic, as_key, compile_expr, constant, q, truth
from sluice.sources import readers

#: The spellings of join kinds.
KINDS = {
    "innerunique": "innerunique", "inner": "inner", "left": "left", "leftouter": "left", "right": "right", "rightouter": "right", "full": "full", "fullouter": "full", "outer": "full",
    "leftsemi": "left_semi", "rightsemi": "right_semi", "leftanti": "left_anti", "leftantisemi": "left_anti", "anti": "left_anti", "rightanti": "right_anti", "rightantisemi": "right_anti",
    "cross": "cross",
}
HINTS = {"broadcast": "broadcast", "shuffle": "shuffle_hash", "hash": "shuffle_hash", "merge": "merge", "nestloop": "shuffle_replicate_nl"}


def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list, list]:
    """Both tables with columns that cannot clash: (visible, inner) names."""
    ls = [(c, f"__l{k}") for k, c in enumerate(left.columns)]
    rs = [(c, f"__r{k}") for k, c in enumerate(right.columns)]
    return left.select(*[q(c).alias(i) for c, i in ls]), right.select(*[q(c).alias(i) for c, i in rs]), ls, rs


def inner_name(names: list, name: str, side: str) -> str:
    for visible, inner in names:
        if visible.lower() == name.lower():
            return inner
    raise QueryError("KQL001", f"no column {name!r} on the {side} side of the join")


def conditions(ctx: Context, on: list[A.Expr], both: DataFrame, ls: list, rs: list) -> tuple[Column | None, list[tuple[str, str]]]:
    """The join condition and the pairs of columns that it equates."""
    out, pairs = None, []
    here = ctx.with_(df=both, sides={"$left": ls, "$right": rs}, hidden=[], carried=[])
    for e in on:
        if isinstance(e, A.Name):
            a, b = inner_name(ls, e.name, "left"), inner_name(rs, e.name, "right")
            pairs.append((a, b))
            test = as_key(here, E(q(a))) == as_key(here, E(q(b)))
        else:
            test = truth(here, compile_expr(here, _lifted(e, ls, rs)))
            if isinstance(e, A.Binary) and e.op == "==" and all(isinstance(x, A.Member) and isinstance(x.object, A.Name) for x in (e.left, e.right)):
                by = {x.object.name.lower(): x.name for x in (e.left, e.right)}
                if set(by) == {"$left", "$right"}:
                    pairs.append((inner_name(ls, by["$left"], "left"), inner_name(rs, by["$right"], "right")))
        out = test if out is None else out & test
    return out, pairs


def _lifted(e: A.Expr, ls: list, rs: list) -> A.Expr:
    """Bare names in a condition mean the left table's column, else the right one's."""
    if isinstance(e, A.Name):
        for names in (ls, rs):
            for visible, inner in names:
                if visible.lower() == e.name.lower():
                    return A.Name(inner)
        return e
    if isinstance(e, A.Binary):
        return A.Binary(e.op, _lifted(e.left, ls, rs), _lifted(e.right, ls, rs))
    if isinstance(e, A.Unary):
        return A.Unary(e.op, _lifted(e.operand, ls, rs))
    if isinstance(e, A.Call):
        return A.Call(e.name, [_lifted(a, ls, rs) for a in e.args])
    if isinstance(e, A.Between):
        return A.Between(e.negated, _lifted(e.operand, ls, rs), _lifted(e.low, ls, rs), _lifted(e.high, ls, rs))
    return e


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key: the least in the order of the other columns, so that equal tables give equal results."""
    rest = [c for c in df.columns if c not in keys]
    plain = all(not isinstance(f.dataType, T.MapType | T.VariantType) for f in df.schema.fields)
    if not rest or not plain:
        return df.dropDuplicates(keys)
    best = df.groupBy(*[q(k) for k in keys]).agg(F.min(F.struct(*[q(c) for c in rest])).alias("__best"))
    return best.select(*[q(c) if c in keys else F.col("__best")[c].alias(c) for c in df.columns])


@operator("join")
def _(ctx: Context, op: A.Op) -> Context:
    kind = KINDS.get(str(op.params.get("kind", "innerunique")).lower())
    if kind is None:
        raise QueryError(PARAMETER, f"unknown join kind {op.params['kind']!r}")
    right_table = ctx.engine.table_of(ctx, op.parts["right"])
    left, right, ls, rs = sides(ctx.df, right_table)
    test, pairs = conditions(ctx, op.parts["on"], left.limit(0).crossJoin(right.limit(0)), ls, rs)
    if kind == "innerunique":
        if pairs and not ctx.sql:
            left = one_of_each(left, list(dict.fromkeys(a for a, _ in pairs)))
        kind = "inner"
    if (hint := HINTS.get(str(op.params.get("hint.strategy", "")).lower())) and kind != "cross":
        right = right.hint(hint)
    if kind == "cross" or test is None:
        joined = left.crossJoin(right)
        kind = "inner"
    elif kind in ("right_semi", "right_anti"):
        joined = right.join(left, test, "left_" + kind[6:])
    else:
        joined = left.join(right, test, kind)
    if kind.endswith(("_semi", "_anti")):
        names = rs if kind.startswith("right") else ls
        return ctx.with_(df=joined.select(*[q(i).alias(c) for c, i in names]), order=None)
    taken = [c for c, _ in ls]
    columns = [q(i).alias(c) for c, i in ls]
    for c, i in rs:
        name = fresh(c, taken)
        taken.append(name)
        columns.append(q(i).alias(name))
    return ctx.with_(df=joined.select(*columns), order=None)


@operator("lookup")
def _(ctx: Context, op: A.Op) -> Context:
    """A join that keeps the left rows and drops the right keys; Spark broadcasts the right side if its size allows."""
    kind = KINDS.get(str(op.params.get("kind", "leftouter")).lower())
    if kind not in ("left", "inner"):
        raise QueryError(PARAMETER, "lookup takes kind=leftouter or kind=inner")
    right_table = ctx.engine.table_of(ctx, op.parts["right"])
    on = op.parts["on"] or [A.Name(c) for c in ctx.columns() if c.lower() in {r.lower() for r in right_table.columns}]
    left, right, ls, rs = sides(ctx.df, right_table)
    test, pairs = conditions(ctx, on, left.limit(0).crossJoin(right.limit(0)), ls, rs)
    joined = left.join(right, test, kind)
    keys = {b for _, b in pairs}
    taken, columns = [c for c, _ in ls], [q(i).alias(c) for c, i in ls]
    for c, i in rs:
        if i not in keys:
            name = fresh(c, taken)
            taken.append(name)
            columns.append(q(i).alias(name))
    return ctx.with_(df=joined.select(*columns), order=None)


# ---- union, find, search ------------------------------------------------------------------------------------------


def members(ctx: Context, items: list[A.Expr], fuzzy: bool) -> list[tuple[str, DataFrame]]:
    """Tables by name; a wildcard means every table that it matches, in the order of names."""
    out: list[tuple[str, DataFrame]] = []
    for k, e in enumerate(items):
        if isinstance(e, A.Pattern | A.Star):
            out += ctx.engine.matching_tables(ctx, e.text if isinstance(e, A.Pattern) else "*")
            continue
        try:
            out.append((e.name if isinstance(e, A.Name) else f"union_arg{k}", ctx.engine.table_of(ctx, e)))
        except QueryError:
            if not fuzzy:
                raise
    return out


def reconciled(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns that differ in type between tables: numbers widen, all else becomes text."""
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)
    target = {}
    for name, found in kinds.items():
        if len({t.simpleString() for t in found}) > 1:
            if all(K.is_integral(t) for t in found):
                target[name] = "long"
            elif all(K.is_numeric(t) for t in found):
                target[name] = "double"
            elif all(K.is_time(t) for t in found):
                target[name] = "timestamp_ntz"
            else:
                target[name] = "string"
    return [f.select(*[q(c).cast(target[c]).alias(c) if c in target else q(c) for c in f.columns]) for f in frames] if target else frames


@operator("union")
def _(ctx: Context, op: A.Op) -> Context:
    found = members(ctx, op.parts["tables"], bool(op.params.get("isfuzzy")))
    if ctx.df is not None:
        found = [("union_arg0", ctx.df), *found]
    if not found:
        raise QueryError("KQL008", "union has no table")
    frames = reconciled([f for _, f in found])
    if source := op.params.get("withsource"):
        frames = [f.select(F.lit(name).alias(source), *[q(c) for c in f.columns]) for (name, _), f in zip(found, frames, strict=True)]
    if str(op.params.get("kind", "outer")).lower() == "inner":
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*[q(c) for c in common]) for f in frames]
    out = union_all(frames)
    return ctx.with_(df=out.distinct() if ctx.sql else out, order=None)


def _tables(ctx: Context, op: A.Op) -> list[tuple[str, DataFrame]]:
    if "tables" in op.parts:
        return members(ctx, op.parts["tables"], True)
    return [("source", ctx.df)] if ctx.df is not None else ctx.engine.matching_tables(ctx, "*")


@operator("find")
def _(ctx: Context, op: A.Op) -> Context:
    """Rows of all tables for which the predicate holds; tables that lack one of its columns have none."""
    parts = []
    for name, table in _tables(ctx, op):
        here = ctx.with_(df=table, hidden=[], carried=[])
        try:
            rows = table.where(truth(here, compile_expr(here, op.parts["predicate"])))
        except QueryError:
            continue
        if wanted := op.parts.get("project"):
            names = [c for e in wanted for c in table.columns if isinstance(e, A.Name) and c.lower() == e.name.lower()]
            rows = rows.select(*[q(c) for c in names])
        parts.append(rows.select(F.lit(name).alias(op.params.get("withsource", "source_")), *[q(c) for c in rows.columns]))
    if not parts:
        raise QueryError("KQL008", "no table has the columns that find asks for")
    return ctx.with_(df=union_all(reconciled(parts)), order=None)


def anywhere(ctx: Context, e: A.Expr) -> Column:
    """A search predicate: a bare text is looked for in all text columns."""
    if isinstance(e, A.Binary) and e.op in ("and", "or"):
        a, b = anywhere(ctx, e.left), anywhere(ctx, e.right)
        return a & b if e.op == "and" else a | b
    if isinstance(e, A.Call) and e.name.lower() == "not":
        return ~anywhere(ctx, e.args[0])
    if isinstance(e, A.Literal) and e.kind == "string":
        hit = F.lit(False)
        term = e.value.strip("*").lower()
        for f in ctx.df.schema.fields:
            if isinstance(f.dataType, T.StringType):
                hit = hit | F.coalesce(F.contains(F.lower(q(f.name)), F.lit(term)), F.lit(False))
        return hit
    if isinstance(e, A.Binary) and isinstance(e.left, A.Star):
        hit = F.lit(False)
        for f in ctx.df.schema.fields:
            if isinstance(f.dataType, T.StringType):
                hit = hit | F.coalesce(truth(ctx, compile_expr(ctx, A.Binary(e.op, A.Name(f.name), e.right))), F.lit(False))
        return hit
    return truth(ctx, compile_expr(ctx, e))


@operator("search")
def _(ctx: Context, op: A.Op) -> Context:
    parts = []
    for name, table in _tables(ctx, op):
        here = ctx.with_(df=table, hidden=[], carried=[])
        try:
            rows = table.where(anywhere(here, op.parts["predicate"]))
        except QueryError:
            continue
        parts.append(rows.select(F.lit(name).alias("$table"), *[q(c) for c in rows.columns]))
    if not parts:
        raise QueryError("KQL008", "no table can be searched for this")
    return ctx.with_(df=union_all(reconciled(parts)), order=None)


# ---- rows from nothing ----------------------------------------------------------------------------------------------


@operator("print")
def _(ctx: Context, op: A.Op) -> Context:
    here = ctx.with_(df=ctx.engine.spark.range(1).select())
    items = []
    for k, (n, c) in enumerate(outputs(here, op.parts["columns"], "print_")):
        given = isinstance(op.parts["columns"][k], A.Named) if k < len(op.parts["columns"]) else False
        items.append((n if given or not n.startswith("print_") else f"print_{k}", c))
    return ctx.with_(df=ctx.engine.spark.range(1).select(*[c.alias(n) for n, c in items]), order=None)


@operator("range")
def _(ctx: Context, op: A.Op) -> Context:
    """Whole numbers come from Spark's own range, which is spread over tasks; other kinds are counted from it too."""
    here = ctx.with_(df=None)
    low, high, step = (compile_expr(here, op.parts[k]) for k in ("from", "to", "step"))
    name, spark = op.parts["name"], ctx.engine.spark
    if all(isinstance(x.constant, int) and x.kind in ("int", "long") for x in (low, high, step)):
        if step.constant == 0:
            raise QueryError(PARAMETER, "the step of range is zero")
        end = high.constant + (1 if step.constant > 0 else -1)
        return ctx.with_(df=spark.range(low.constant, end, step.constant).select(F.col("id").alias(name)), order=None)
    base = here.with_(df=spark.range(1))
    times = K.is_time(base.type_of(low)) or K.is_span(base.type_of(low))
    if times:
        from sluice.plans.expr import micros

        gap = micros(arithmetic(base, "-", high, low).column)
        count = spark.range(1).select(F.floor(gap / micros(step.column)).alias("n")).first()["n"]
        rows = spark.range(max(0, int(count) + 1)) if count is not None else spark.range(0)
        at = base.with_(df=rows)
        return ctx.with_(df=rows.select(arithmetic(at, "+", low, E(step.column * F.col("id"), K.INTERVAL)).column.alias(name)), order=None)
    a, b, s = (float(constant(base, op.parts[k])) for k in ("from", "to", "step"))
    n = int((b - a) / s + 1e-9) + 1
    return ctx.with_(df=spark.range(max(0, n)).select((F.lit(a) + F.col("id") * F.lit(s)).alias(name)), order=None)


@operator("externaldata")
def _(ctx: Context, op: A.Op) -> Context:
    uris = [constant(ctx.with_(df=None), u) for u in op.parts["uris"]]
    schema = T.StructType([T.StructField(n, K.spark_type(t)) for n, t in op.parts["schema"]])
    options = op.parts["with"]
    return ctx.with_(df=readers.read(ctx.engine.spark, uris, options.get("format"), schema, header=bool(options.get("ignorefirstrecord"))), order=None)
