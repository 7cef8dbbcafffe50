"""Connected components of an edge table that may hold stars with a large share of all nodes.

Alternating large-star and small-star steps, each written to the shared folder. The join's sides are both read from
files, so that Spark broadcasts the smaller one only by its exact size and else can split a hot centre's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import durable, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large star) or smaller (small star) neighbours on its least neighbour."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = durable(sides.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = sides.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = durable(new.where(F.col("u") != F.col("v")).distinct(), "star")
    release(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    # decimals: sums of hashes must not overflow
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (u, v); component is the least node that it reaches.

    Both columns long and never null; repeated edges and self-loops do no harm; no edges give no rows. The number of
    rounds grows with the logarithm of the number of nodes.
    """
    nodes = edges.where(F.col("u") != F.col("v")).select("u", "v").distinct()
    now = durable(nodes, "edges")
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        star = _star(now, large=True)
        release(now)
        now = _star(star, large=False)
        release(star)
    children = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return children.union(roots)
