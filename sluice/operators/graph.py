"""Graphs as a pair of tables: edges (with __source and __target) and nodes (with __id).

A graph travels through the pipeline on the context's engine; fixed paths are joins, paths of varying length a bounded
union of joins, components an alternation of star steps.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.lang import ast as A
from sluice.lang.diagnostics import PARAMETER, TRANSLATION, QueryError
from sluice.operators.core import operator, outputs
from sluice.plans.expr import Context, E, as_string, compile_expr, q, truth

MOST_HOPS = 16


@dataclass
class Graph:
    edges: DataFrame
    nodes: DataFrame


def graph_of(ctx: Context) -> Graph:
    g = ctx.engine.graphs.get(id(ctx.df))
    if g is None:
        raise QueryError(TRANSLATION, "a graph is needed here; make-graph makes one")
    return g


def carrying(ctx: Context, g: Graph) -> Context:
    ctx.engine.graphs[id(g.edges)] = g
    return ctx.with_(df=g.edges, order=None, carried=[], hidden=[])


@operator("make-graph")
def _(ctx: Context, op: A.Op) -> Context:
    source, target = ctx.resolve(op.parts["source"]), ctx.resolve(op.parts["target"])
    if source is None or target is None:
        raise QueryError("KQL001", "make-graph names a column that is not there")
    key = lambda c: as_string(ctx, E(q(c)))
    edges = ctx.df.withColumn("__source", key(source)).withColumn("__target", key(target))
    ids = edges.select(F.col("__source").alias("__id")).union(edges.select(F.col("__target").alias("__id"))).where("__id is not null").distinct()
    tables = op.parts["nodes"]
    if tables:
        nodes = ids
        for expr, on in tables:
            table = ctx.engine.table_of(ctx, expr)
            here = ctx.with_(df=table)
            named = table.withColumn("__id", as_string(here, E(q(here.resolve(on))))).dropDuplicates(["__id"])
            fresh = [c for c in named.columns if c == "__id" or c not in nodes.columns]
            nodes = nodes.join(named.select(*[q(c) for c in fresh]), "__id", "full")
    else:
        nodes = ids.withColumn(op.parts.get("node_id", "node_id"), F.col("__id"))
    return carrying(ctx, Graph(edges, nodes))


@operator("graph-where-nodes")
def _(ctx: Context, op: A.Op) -> Context:
    g = graph_of(ctx)
    here = ctx.with_(df=g.nodes)
    nodes = g.nodes.where(truth(here, compile_expr(here, op.parts["predicate"])))
    keep = nodes.select("__id")
    edges = g.edges.join(keep, F.col("__source") == F.col("__id"), "left_semi").join(keep, F.col("__target") == F.col("__id"), "left_semi")
    return carrying(ctx, Graph(edges, nodes))


@operator("graph-where-edges")
def _(ctx: Context, op: A.Op) -> Context:
    g = graph_of(ctx)
    here = ctx.with_(df=g.edges)
    return carrying(ctx, Graph(g.edges.where(truth(here, compile_expr(here, op.parts["predicate"]))), g.nodes))


@operator("graph-to-table")
def _(ctx: Context, op: A.Op) -> Context:
    g = graph_of(ctx)
    results = {}
    for what, alias, options in op.parts["outputs"]:
        if what == "nodes":
            df = g.nodes
            df = df.withColumnRenamed("__id", options["node_id"]) if "node_id" in options else df.drop("__id")
        else:
            df = g.edges
            for inner, name in (("__source", "source_id"), ("__target", "target_id")):
                df = df.withColumnRenamed(inner, options[name]) if name in options else df.drop(inner)
        results[alias or what] = df
        if alias:
            ctx.scope.bind(alias, df)
    if len(results) > 1:
        ctx.engine.results = results
    return ctx.with_(df=next(iter(results.values())), order=None)


@operator("graph-mark-components")
def _(ctx: Context, op: A.Op) -> Context:
    """Weakly connected components; the number is a hash of the component's least node."""
    g = graph_of(ctx)
    name = op.params.get("with_component_id", "ComponentId")
    labels = connected(ctx, g)
    nodes = g.nodes.join(labels, "__id", "left").withColumn(name, F.xxhash64(F.coalesce("component", "__id"))).drop("component")
    return carrying(ctx, Graph(g.edges, nodes))


def connected(ctx: Context, g: Graph) -> DataFrame:
    """(__id, component) by star steps, each cut off by a checkpoint."""
    spark = ctx.engine.spark
    if spark.sparkContext.getCheckpointDir() is None:
        # a cluster's machines do not share their temporary folders
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        scratch = tempfile.mkdtemp(prefix="sluice-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/sluice-scratch"
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch)
    now = g.edges.select(F.greatest("__source", "__target").alias("u"), F.least("__source", "__target").alias("v")).where("u != v").distinct().checkpoint()
    before = None
    while (mark := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())) != before:
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct().checkpoint()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = down.join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = small.where("u != v").distinct().checkpoint()
    children = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("__id"), "component")
    return children.union(now.select(F.col("v").alias("__id")).distinct().select("__id", F.col("__id").alias("component"))).dropDuplicates(["__id"])


def hops(edges: DataFrame, low: int, high: int, direction: str) -> DataFrame:
    """(a, b, path, e): paths of low to high edges; e holds a single edge's columns as a struct."""
    if high > MOST_HOPS:
        raise QueryError(PARAMETER, f"paths are limited to {MOST_HOPS} edges")
    columns = F.struct(*[q(c) for c in edges.columns])
    forward = edges.select(F.col("__source").alias("a"), F.col("__target").alias("b"), columns.alias("e"))
    back = edges.select(F.col("__target").alias("a"), F.col("__source").alias("b"), columns.alias("e"))
    one = back if direction == "<" else forward.union(back) if direction == "-" else forward
    if low == high == 1:
        return one.select("a", "b", F.array("a", "b").alias("path"), "e")
    now = one.select("a", "b", F.array("a", "b").alias("path"), "e")
    found = [now] if low <= 1 else []
    step = one.select(F.col("a").alias("b"), F.col("b").alias("c"))
    for length in range(2, high + 1):
        now = now.join(step, "b").where(~F.array_contains("path", F.col("c"))).select("a", F.col("c").alias("b"), F.concat("path", F.array("c")).alias("path"), "e")
        if length >= low:
            found.append(now)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@operator("graph-match", "graph-shortest-paths")
def _(ctx: Context, op: A.Op) -> Context:
    g = graph_of(ctx)
    if len(op.parts["patterns"]) != 1:
        raise QueryError(PARAMETER, "one path pattern at a time")
    pattern = op.parts["patterns"][0]
    node_names = [p[1] or f"__n{k}" for k, p in enumerate(pattern[::2])]
    node = F.struct(*[q(c) for c in g.nodes.columns])
    nodes = g.nodes.select(F.col("__id"), node.alias("n"))
    df = nodes.select(F.col("__id").alias("__at0"), F.col("n").alias(node_names[0]))
    lengths = []
    for k, edge in enumerate(pattern[1::2]):
        _, name, direction, low, high = edge
        path = hops(g.edges, low, high, direction).toDF("__from", "__to", "__path", "__edge")
        alias = name or f"__e{k}"
        df = df.join(path, F.col(f"__at{k}") == F.col("__from")).drop("__from")
        df = df.withColumnRenamed("__to", f"__at{k + 1}").withColumnRenamed("__path", f"__path{k}").withColumnRenamed("__edge", alias)
        end = nodes.select(F.col("__id").alias("__idx"), F.col("n").alias(f"__x{k}"))
        df = df.join(end, F.col(f"__at{k + 1}") == F.col("__idx")).drop("__idx")
        if node_names[k + 1] in df.columns:  # the same node again
            first = node_names.index(node_names[k + 1])
            df = df.where(F.col(f"__at{k + 1}") == F.col(f"__at{first}")).drop(f"__x{k}")
        else:
            df = df.withColumnRenamed(f"__x{k}", node_names[k + 1])
        lengths.append(F.size(f"__path{k}"))
    if str(op.params.get("cycles", "all")).lower() == "none":
        ends = F.array(*[f"__at{k}" for k in range(len(pattern[::2]))])
        df = df.where(F.size(F.array_distinct(ends)) == F.size(ends))
    here = ctx.with_(df=df, hidden=[], carried=[])
    if op.parts["where"] is not None:
        df = df.where(truth(here, compile_expr(here, op.parts["where"])))
        here = here.with_(df=df)
    if op.name == "graph-shortest-paths":
        total = lengths[0]
        for length in lengths[1:]:
            total = total + length
        last = f"__at{len(pattern[1::2])}"
        best = df.withColumn("__len", total)
        least = best.groupBy("__at0", last).agg(F.min("__len").alias("__least"))
        df = best.join(least, ["__at0", last]).where("__len = __least")
        if str(op.params.get("output", "any")).lower() == "any":
            df = df.dropDuplicates(["__at0", last])
        here = here.with_(df=df)
    if op.parts["project"]:
        items = outputs(here, op.parts["project"])
        return ctx.with_(df=df.select(*[c.alias(n) for n, c in items]), order=None)
    return ctx.with_(df=df.select(*[q(c) for c in df.columns if not c.startswith("__")]), order=None)
