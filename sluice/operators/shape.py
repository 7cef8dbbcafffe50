"""Operators that change the shape of rows: parse, mv-expand, mv-apply, make-series, evaluate, scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang import ast as A
from sluice.lang.diagnostics import unsupported
from sluice.operators.core import aggregate_outputs, fresh, group_keys, operator, project, run_ops, whole_number, with_columns
from sluice.plans import types as K
from sluice.plans.expr import Context, E, as_array, as_key, as_string, as_variant, compile_expr, epoch_micros, from_epoch_micros, java_regex, micros, q

# ---- parse ----------------------------------------------------------------------------------------------------------


def parse_regex(items: list[tuple], kind: str, flags: str) -> tuple[str, list[tuple[str, str, int]]]:
    """A Java regex for a parse pattern, and the captured columns: name, type, group."""
    out, columns, group = "", [], 0
    for k, item in enumerate(items):
        if item[0] == "skip":
            out += ".*?" if k < len(items) - 1 else ".*"
        elif item[0] == "text":
            if kind == "regex":
                pattern = java_regex(item[1])
                group += re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern)).groups
                out += f"(?:{pattern})"
            else:
                out += re.escape(item[1])
        else:
            _, name, t = item
            group += 1
            columns.append((name, t, group))
            number = {"long": r"\s*[-+]?\d+", "int": r"\s*[-+]?\d+", "real": r"\s*[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", "double": r"\s*[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"}.get(t)
            last = all(i[0] != "text" for i in items[k + 1 :]) and not any(i[0] == "skip" for i in items[k + 1 :])
            body = number if number and kind == "simple" else (".*" if last else ".*?")
            out += f"({body})"
    mode = "".join(dict.fromkeys("s" + "".join(c for c in flags.replace("U", "") if c in "imsx")))
    return f"(?{mode})^{out}$" if not (kind == "regex" and items and items[-1][0] == "text") else f"(?{mode})^{out}", columns


@operator("parse", "parse-where")
def _(ctx: Context, op: A.Op) -> Context:
    """One regular expression for the pattern, one extraction for each column. kind=relaxed keeps a row whose typed
    column cannot be read and gives null there; in kind=simple such a row does not match."""
    kind = str(op.params.get("kind", "simple")).lower()
    pattern, columns = parse_regex(op.parts["pattern"], kind, str(op.params.get("flags", "")))
    text = as_string(ctx, compile_expr(ctx, op.parts["operand"]))
    hit = F.coalesce(text.rlike(pattern), F.lit(False))
    if op.name == "parse-where":
        ctx = ctx.with_(df=ctx.df.where(hit))
    items = []
    for name, t, group in columns:
        value = F.when(hit, F.regexp_extract(text, pattern, group))
        spark = K.spark_type(t)
        if isinstance(spark, T.VariantType):
            value = F.try_parse_json(value)
        elif not isinstance(spark, T.StringType):
            value = F.trim(value).try_cast(spark)
        items.append((name, value))
    return ctx.with_(df=with_columns(ctx, items))


@operator("parse-kv")
def _(ctx: Context, op: A.Op) -> Context:
    options = op.parts["with"]
    pair, kv, quote = options.get("pair_delimiter", " "), options.get("kv_delimiter", "="), options.get("quote", "")
    text = as_string(ctx, compile_expr(ctx, op.parts["operand"]))
    items = []
    for name, t in op.parts["keys"]:
        spark = K.spark_type(t)
        if "regex" in options:
            # two groups, a key and its value; the first match with the key counts
            pattern = F.lit(java_regex(options["regex"]))
            at = F.array_position(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(name))
            found = F.when(at > 0, F.get(F.regexp_extract_all(text, pattern, F.lit(2)), at.cast("int") - 1))
            items.append((name, found if isinstance(spark, T.StringType) else F.try_parse_json(found) if isinstance(spark, T.VariantType) else F.trim(found).try_cast(spark)))
            continue
        one, two = (quote[0], quote[-1]) if quote else ("", "")
        value = f"{re.escape(one)}([^{re.escape(two)}]*){re.escape(two)}|([^{re.escape(pair[:1])}]*)" if quote else f"()([^{re.escape(pair[:1])}]*)"
        pattern = f"(?:^|{re.escape(pair)})\\s*{re.escape(name)}{re.escape(kv)}(?:{value})"
        found = F.when(text.rlike(pattern), F.concat(F.coalesce(F.regexp_extract(text, pattern, 1), F.lit("")), F.coalesce(F.regexp_extract(text, pattern, 2), F.lit(""))))
        items.append((name, found if isinstance(spark, T.StringType) else F.try_parse_json(found) if isinstance(spark, T.VariantType) else F.trim(found).try_cast(spark)))
    return ctx.with_(df=with_columns(ctx, items))


# ---- expansion ------------------------------------------------------------------------------------------------------


def typed_elements(ctx: Context, e: E, kind: str | None, bags: bool = True) -> tuple[Column, T.DataType]:
    """An array to expand; a bag becomes an array of one-key bags."""
    t = ctx.type_of(e)
    if isinstance(t, T.MapType):
        a = F.transform(F.map_entries(e.column), lambda x: F.to_variant_object(F.map_from_entries(F.array(x))))
        element = T.VariantType()
    elif isinstance(t, T.VariantType | T.StringType):
        v = F.try_parse_json(e.column) if isinstance(t, T.StringType) else e.column
        listed = F.try_variant_get(v, "$", "array<variant>")
        entries = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.to_variant_object(F.map_from_entries(F.array(x))))
        single = F.array(v) if isinstance(t, T.VariantType) else F.array(e.column.cast("variant"))
        a = F.coalesce(listed, entries, F.when(v.isNotNull() & ~F.is_variant_null(v) if isinstance(t, T.VariantType) else e.column.isNotNull(), single))
        element = T.VariantType()
    else:
        found = as_array(ctx, e)
        a, element = found.column, found.type.elementType
    if kind:
        spark = K.spark_type(kind)
        a = F.transform(a, lambda x: F.try_variant_get(x, "$", spark.simpleString()) if isinstance(element, T.VariantType) and not isinstance(spark, T.VariantType) else x.try_cast(spark) if not isinstance(spark, T.VariantType) else as_variant(ctx, E(x, element)))
        element = spark
    return a, element


def expanded(ctx: Context, op: A.Op, outer: bool) -> Context:
    """One row for each element; several columns go in step. outer: a row without elements stays with nulls."""
    columns, names = [], []
    for item, kind in op.parts["columns"]:
        given = item.names[0] if isinstance(item, A.Named) else None
        e = compile_expr(ctx, item.value if given else item)
        name = given or e.name or fresh("Column1", ctx.df.columns)
        a, _ = typed_elements(ctx, e, kind)
        if op.parts.get("limit") is not None:
            a = F.slice(a, 1, whole_number(ctx, op.parts["limit"], op.name))
        columns.append(a)
        names.append(name)
    index = op.params.get("with_itemindex")
    df = ctx.df
    arrays = [f"__a{k}" for k in range(len(columns))]
    df = df.select("*", *[c.alias(n) for c, n in zip(columns, arrays, strict=True)])
    size = F.greatest(*[F.coalesce(F.size(q(a)), F.lit(0)) for a in arrays]) if len(arrays) > 1 else F.coalesce(F.size(q(arrays[0])), F.lit(0))
    if len(arrays) == 1:
        gen = (F.posexplode_outer if outer else F.posexplode)(q(arrays[0])).alias("__at", "__v0")
        df = df.select("*", gen)
        values = [q("__v0")]
    else:
        places = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))))
        df = df.select("*", (F.explode_outer if outer else F.explode)(places).alias("__at"))
        values = [F.get(q(a), q("__at")) for a in arrays]
    items = list(zip(names, values, strict=True))
    if index:
        items.append((index, q("__at").cast("long")))
    df = with_columns(ctx.with_(df=df), items)
    return ctx.with_(df=df.drop(*arrays, "__at", "__v0"))


@operator("mv-expand")
def _(ctx: Context, op: A.Op) -> Context:
    return expanded(ctx, op, outer=True)


@operator("mv-apply")
def _(ctx: Context, op: A.Op) -> Context:
    """The operators run for each row's elements: the row's number is a hidden column of every grouping and window, and
    its other columns are carried along."""
    before = ctx.columns()
    rid, orig = fresh("__rid", ctx.df.columns), fresh("__orig", ctx.df.columns)
    df = ctx.df.withColumn(rid, F.monotonically_increasing_id()).withColumn(orig, F.struct(*[q(c) for c in ctx.df.columns]))
    inner = ctx.with_(df=df, hidden=[*ctx.hidden, rid], carried=[*ctx.carried, orig], order=None)
    out = run_ops(expanded(inner, op, outer=False), op.parts["body"])
    made = [c for c in out.df.columns if c not in out.hidden and c not in out.carried]
    columns = [F.col(orig)[c].alias(c) for c in before if c not in made] + [q(c) for c in made]
    columns += [q(c) for c in (*ctx.hidden, *ctx.carried)]
    return ctx.with_(df=out.df.select(*columns), order=None)


# ---- series ---------------------------------------------------------------------------------------------------------


@operator("make-series")
def _(ctx: Context, op: A.Op) -> Context:
    """Two groupings: aggregates for each key and bin, then one row a key whose arrays are laid out along the axis. The
    axis comes from sequence(), so gaps are filled without a join."""
    axis_item = op.parts["axis"]
    axis = compile_expr(ctx, axis_item.value if isinstance(axis_item, A.Named) else axis_item)
    axis_name = axis_item.names[0] if isinstance(axis_item, A.Named) else axis.name or "axis"
    t = ctx.type_of(axis)
    step = compile_expr(ctx, op.parts["step"])
    timed = K.is_time(t) or K.is_span(t)
    whole = not timed and K.is_integral(t) and K.is_integral(ctx.type_of(step))

    def number(e: E) -> Column:
        kind = ctx.type_of(e)
        if K.is_time(kind):
            return epoch_micros(e.column, kind)
        if K.is_span(kind):
            return micros(e.column)
        return e.column.cast("long") if whole else e.column.cast("double")

    x, width = number(axis), number(step)
    low = number(compile_expr(ctx, op.parts["from"])) if op.parts["from"] is not None else None
    high = number(compile_expr(ctx, op.parts["to"])) if op.parts["to"] is not None else None
    df = ctx.df.withColumn("__x", x)
    if low is not None:
        df = df.where(F.col("__x") >= low)
    if high is not None:
        df = df.where(F.col("__x") < high)
    base = low if low is not None else F.lit(0)
    place = F.floor((F.col("__x") - base) / width).cast("long")  # the bin's number from the base
    df = df.withColumn("__bin", place)
    here = ctx.with_(df=df)
    keys = group_keys(here, op.parts["by"])
    items = [a for a, _ in op.parts["aggregates"]]
    aggregates = aggregate_outputs(here, items, [n for n, _ in keys])
    hidden = [q(h) for h in ctx.hidden]
    cells = df.groupBy(*[c.alias(n) for n, c in keys], *hidden, "__bin").agg(*[c.alias(f"__g{k}") for k, (_, c) in enumerate(aggregates)], *[F.any_value(q(c)).alias(c) for c in ctx.carried])
    packed = F.map_from_entries(F.collect_list(F.struct(F.col("__bin"), F.struct(*[F.col(f"__g{k}") for k in range(len(aggregates))]))))
    by = [q(n) for n, _ in keys] + hidden
    extra = [F.any_value(q(c)).alias(c) for c in ctx.carried]
    agg = [packed.alias("__cells"), F.min("__bin").alias("__first"), F.max("__bin").alias("__last"), *extra]
    series = cells.where("__bin is not null").groupBy(*by).agg(*agg) if by else cells.where("__bin is not null").agg(*agg)
    first = F.lit(0).cast("long") if low is not None else F.col("__first")
    last = F.ceil((high - base) / width).cast("long") - 1 if high is not None else F.col("__last")
    axis_numbers = F.when((first <= last), F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    at = lambda b: base + b * width
    shown = (lambda b: from_epoch_micros(at(b))) if K.is_time(t) else (lambda b: at(b))
    if K.is_span(t):
        from sluice.plans.expr import micros_span

        shown = lambda b: micros_span(at(b))
    out = series.withColumn("__axis", axis_numbers)
    columns = [q(n) for n, _ in keys]
    for k, ((n, _), (_, default)) in enumerate(zip(aggregates, op.parts["aggregates"], strict=True)):
        fill = compile_expr(ctx, default).column if default is not None else F.lit(0)
        kind = cells.schema[f"__g{k}"].dataType
        fill = fill.cast(kind) if K.is_numeric(kind) or default is None and isinstance(kind, T.StringType | T.BooleanType) else F.lit(None).cast(kind) if default is None else fill.cast(kind)
        columns.append(_laid_out(f"__g{k}", fill).alias(n))
    columns.append(F.transform("__axis", shown).alias(axis_name))
    return ctx.with_(df=out.select(*columns, *hidden, *[q(c) for c in ctx.carried]), order=None)


def _laid_out(cell: str, fill: Column) -> Column:
    return F.transform("__axis", lambda b: F.coalesce(F.try_element_at(F.col("__cells"), b)[cell], fill))


# ---- plugins --------------------------------------------------------------------------------------------------------


@operator("evaluate")
def _(ctx: Context, op: A.Op) -> Context:
    name = op.parts["plugin"].lower()
    own = ctx.engine.plugins.get(name)
    if own is not None:
        return ctx.with_(df=own(ctx.df, *op.parts["args"]), order=None)
    plugin = PLUGINS.get(name)
    if plugin is None:
        raise unsupported(f"plugin {name}")
    return plugin(ctx, op)


def argument(op: A.Op, k: int, name: str):
    for a in op.parts["args"]:
        if isinstance(a, A.Named) and a.names[0].lower() == name.lower():
            return a.value
    return op.parts["args"][k] if k < len(op.parts["args"]) and not isinstance(op.parts["args"][k], A.Named) else None


def bag_unpack(ctx: Context, op: A.Op) -> Context:
    """A column for each key. Without an output schema one job looks for the keys; a key's type is that of its values,
    or text."""
    column = argument(op, 0, "column")
    e = compile_expr(ctx, column)
    prefix = argument(op, 1, "OutputColumnPrefix")
    prefix = prefix.value if prefix is not None else ""
    v = as_variant(ctx, e)
    keep = [c for c in ctx.columns() if c != e.name]
    if "schema" in op.parts:
        wanted = [(n, K.spark_type(t)) for n, t in op.parts["schema"] if n not in keep]
    else:
        found = ctx.df.select(F.explode(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))).alias("e"))
        kinds = found.select(F.col("e.key").alias("k"), F.schema_of_variant(F.col("e.value")).alias("t")).where("t != 'VOID'").groupBy("k").agg(F.collect_set("t").alias("t")).collect()
        wanted = []
        for row in sorted(kinds, key=lambda r: r["k"]):
            ts = set(row["t"])
            t = T.LongType() if ts <= {"BIGINT"} else T.DoubleType() if all(x in ("BIGINT", "DOUBLE", "FLOAT") or x.startswith("DECIMAL") for x in ts) else T.BooleanType() if ts == {"BOOLEAN"} else T.StringType() if ts == {"STRING"} else T.VariantType() if any(x.startswith(("OBJECT", "ARRAY")) for x in ts) else T.StringType()
            wanted.append((row["k"], t))
    items = [(c, q(c)) for c in keep]
    for k, t in wanted:
        path = "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
        items.append((fresh(prefix + k, keep), F.try_variant_get(v, path, t.simpleString())))
    return project(ctx, items)


def pivot(ctx: Context, op: A.Op) -> Context:
    """Spark's pivot; without an output schema one job lists the values."""
    args = op.parts["args"]
    e = compile_expr(ctx, args[0])
    aggregate = args[1] if len(args) > 1 else A.Call("count", [])
    used = {n.lower() for n in names_in(aggregate)} | {(e.name or "").lower()}
    by = [compile_expr(ctx, a).name for a in args[2:]] or [c for c in ctx.columns() if c.lower() not in used]
    df = ctx.df.withColumn("__p", as_string(ctx, e))
    ((_, value),) = aggregate_outputs(ctx.with_(df=df), [aggregate], [])
    values = None
    if "schema" in op.parts:
        values = [n for n, _ in op.parts["schema"] if n not in by]
    grouped = df.groupBy(*[q(c) for c in by])
    out = (grouped.pivot("__p", values) if values is not None else grouped.pivot("__p")).agg(value.alias("v"))
    zero = isinstance(aggregate, A.Call) and aggregate.name.lower() in ("count", "countif", "dcount", "sum")
    return ctx.with_(df=out.na.fill(0, [c for c in out.columns if c not in by]) if zero else out, order=None)


def names_in(e) -> list[str]:
    if isinstance(e, A.Name):
        return [e.name]
    out = []
    for v in vars(e).values() if hasattr(e, "__dict__") else []:
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, A.Expr):
                out += names_in(x)
    return out


def narrow(ctx: Context, op: A.Op) -> Context:
    """A row for each cell: row number, column, value as text."""
    df = ctx.df.withColumn("__row", F.monotonically_increasing_id())
    cells = [F.struct(F.lit(f.name).alias("Column"), as_string(ctx, E(q(f.name), f.dataType)).alias("Value")) for f in ctx.df.schema.fields if f.name in ctx.columns()]
    out = df.select(F.col("__row").alias("Row"), F.explode(F.array(*cells)).alias("c")).select("Row", "c.Column", "c.Value")
    return ctx.with_(df=out, order=None)


PLUGINS = {"bag_unpack": bag_unpack, "pivot": pivot, "narrow": narrow}

# ---- scan -----------------------------------------------------------------------------------------------------------


@operator("scan")
def _(ctx: Context, op: A.Op) -> Context:
    """A machine of steps over ordered rows, run for each partition in Arrow batches (an own class of state for each
    group). Conditions and assignments see the row's columns, the declared values and step.column of earlier matches."""
    from sluice.operators.machine import Machine

    declared = [(n, K.spark_type(t), None if d is None else compile_expr(ctx.with_(df=None), d).constant) for n, t, d in op.parts["declare"]]
    fields = [f for f in ctx.df.schema.fields if f.name in ctx.columns()]
    for f in fields:
        if isinstance(f.dataType, T.VariantType | T.MapType):
            raise unsupported("scan over dynamic columns")
    order = [(e, way) for e, way, _ in op.parts["order"]]
    df = ctx.df
    keys = []
    for k, e in enumerate(op.parts["partition"]):
        df = df.withColumn(f"__p{k}", as_key(ctx.with_(df=df), compile_expr(ctx.with_(df=df), e)))
        keys.append(f"__p{k}")
    from sluice.functions.rowwise import order_of
    from sluice.operators.core import sort_columns

    sort = sort_columns(ctx, op.parts["order"]) if order else order_of(ctx)
    match_id = op.params.get("with_match_id")
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t, _ in declared], *([T.StructField(match_id, T.LongType())] if match_id else [])])
    machine = Machine([f.name for f in fields], [(n, d) for n, _, d in declared], op.parts["steps"], bool(match_id))
    width = len(fields)

    def run(batches):
        import pyarrow as pa

        state, last = machine.start(), None
        out: list[tuple] = []
        for batch in batches:
            data = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*data, strict=True):
                key = row[width:]
                if key != last:
                    state, last = machine.start(), key
                out += machine.feed(state, row[:width])
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    source = df.select(*[q(f.name) for f in fields], *[q(k) for k in keys])
    if keys:
        source = df.repartition(*[q(k) for k in keys]).sortWithinPartitions(*[q(k) for k in keys], *sort).select(*[q(f.name) for f in fields], *[q(k) for k in keys])
    else:  # one machine over all rows: the operator's meaning without partition by
        source = df.coalesce(1).sortWithinPartitions(*sort).select(*[q(f.name) for f in fields])
    return ctx.with_(df=source.mapInArrow(run, schema), order=None)
