"""Sharding by a k-d tree: weighted medians along the widest metadata dimension until leaves reach the target bytes.

Native: only DataFrame functions. One pass over the documents leaves a small durable table of sizes and dimensions; the
tree works on that. A node that stands for k shards splits its bytes at floor(k/2)/k along the dimension that is widest
in it, for all nodes of a level at once. The weighted quantile is found by histograms of BINS bins a node, refined
within the bin that holds it, so the driver sees at most shards x BINS counts, however many rows there are. Then one row
a node may change sides to even out the cut.

Each dimension is a long: 31 bits of the value's place between its least and greatest, then 32 bits of a hash of the
row's place in the table. So rows that are equal in a dimension (a hot source, a group of copies) are split like others.

Law `bytes`: the shards' sizes differ by little more than single documents. Defined results: null texts have size 8 and
crc32 0; null dimensions count as least; ties go by the hash; repeated rows are rows of their own; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable

BINS = 1024
ROWS_PER_SLOT_BUCKET = 50_000
OVERHEAD = 8
_PLACE, _HASH = 31, 32


@dataclass
class Node:
    """Rows of a subtree that becomes the shards first .. first + count - 1."""

    first: int
    count: int
    axis: int = 0
    low: int = 0  # the quantile lies in [low, high]
    high: int = 0
    target: int = 0  # bytes that go left of the cut
    before: int = 0  # bytes below low
    cut: int | None = None
    left: int = 0  # bytes up to the cut
    spread: list = field(default_factory=list)


def _dimensions(docs: DataFrame, numeric: dict[str, Column]) -> DataFrame:
    """Adds d0, d1, ...: the dimensions as longs."""
    bounds = docs.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(numeric.values()) for n, f in (("low", F.min), ("high", F.max))]).first()
    tie = F.shiftrightunsigned(F.xxhash64("rid"), 64 - _HASH)
    out = []
    for i, c in enumerate(numeric.values()):
        low, high = bounds[f"low{i}"], bounds[f"high{i}"]
        span = float(high - low) if low is not None else 0.0
        place = F.when(c.isNull(), F.lit(0.0)).otherwise((c.cast("double") - F.lit(float(low or 0))) / F.lit(span)) if span > 0 else F.lit(0.0)
        place = F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))
        out.append((F.shiftleft((place * F.lit(float((1 << _PLACE) - 1))).cast("long"), _HASH) + tie).alias(f"d{i}"))
    return docs.select("rid", "doc_id", "size", "text_crc32", *out)


def _chain(nodes: list[Node], value, otherwise) -> Column:
    """value(node) by the row's node, as a balanced tree of comparisons on its first shard."""

    def pick(part: list[Node]):
        if len(part) == 1:
            return value(part[0])
        half = len(part) // 2
        return F.when(F.col("node") < part[half].first, pick(part[:half])).otherwise(pick(part[half:]))

    return pick(nodes) if nodes else otherwise


def _split_level(rows: DataFrame, nodes: list[Node], axes: int) -> DataFrame:
    """Move the rows right of each open node's cut to its right half."""
    mine = rows.where(F.col("node").isin([n.first for n in nodes]))
    stats = mine.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"d{i}").alias(f"{k}{i}") for i in range(axes) for k, f in (("low", F.min), ("high", F.max))]).collect()
    found = {r["node"]: r for r in stats}
    live = []
    for n in nodes:
        if (r := found.get(n.first)) is None:
            continue
        n.spread = [r[f"high{i}"] - r[f"low{i}"] for i in range(axes)]
        n.axis = max(range(axes), key=lambda i: (n.spread[i], -i))
        n.low, n.high = r[f"low{n.axis}"], r[f"high{n.axis}"]
        n.target = round(r["bytes"] * (n.count // 2) / n.count)
        live.append(n)
    key = _chain(live, lambda n: F.col(f"d{n.axis}"), F.lit(0))
    open_ = live
    while open_:
        width = {n.first: max(1, -(-(n.high - n.low + 1) // BINS)) for n in open_}
        part = mine.where(F.col("node").isin([n.first for n in open_])).withColumn("key", key)
        low = _chain(open_, lambda n: F.lit(n.low), F.lit(0))
        high = _chain(open_, lambda n: F.lit(n.high), F.lit(0))
        wide = _chain(open_, lambda n: F.lit(width[n.first]), F.lit(1))
        counts = part.where(F.col("key").between(low, high)).withColumn("bin", F.round(((F.col("key") - low) - F.pmod(F.col("key") - low, wide)) / wide).cast("long"))
        bins: dict[int, list] = {}
        for r in counts.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["bytes"], r["n"]))
        still = []
        for n in open_:
            at = n.before
            for b, size, count in sorted(bins[n.first]):
                if at + size >= n.target:
                    begin, end = n.low + b * width[n.first], n.low + (b + 1) * width[n.first] - 1
                    if width[n.first] == 1 or count == 1:
                        # keys up to the cut go left: with this bin, or without it where that is nearer
                        with_bin = at + size - n.target <= n.target - at
                        n.cut, n.left = (end, at + size) if with_bin else (begin - 1, at)
                    else:
                        n.low, n.high, n.before = begin, min(end, n.high), at
                        still.append(n)
                    break
                at += size
            else:
                n.cut, n.left = n.high, at
        open_ = still
    cut = _chain(live, lambda n: F.lit(n.cut), F.lit(0))
    right = _chain(live, lambda n: F.lit(n.first + n.count // 2), F.lit(0))
    inside = F.col("node").isin([n.first for n in live])
    # evening: one row on the side with too much whose size is nearest to the difference changes sides, if that helps
    gap = _chain(live, lambda n: F.lit(n.target - n.left), F.lit(0))
    donors = mine.where(inside & (gap != 0) & ((key > cut) == (gap > 0)))
    off = F.abs(F.col("size") - F.abs(gap))
    moved = [r["best"]["rid"] for r in donors.where(off < F.abs(gap)).groupBy("node").agg(F.min(F.struct(off.alias("off"), "rid")).alias("best")).collect()]
    goes_right = (key > cut) != F.col("rid").isin(moved) if moved else key > cut
    return rows.withColumn("node", F.when(inside & goes_right, right).otherwise(F.col("node")))


def kd_shards(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    shards: how many; or target_bytes: split until a leaf has no more. dimensions: numeric columns of docs by name; by
    default the id, source and lang.
    """
    text, key = F.col(text_column), F.col(id_column).cast("long")
    if dimensions is None:
        # not the size: shards of a few huge documents could not be evened out
        dimensions = {"id": key} | {c: F.when(F.col(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(c), 33)) for c in ("source", "lang") if c in docs.columns}
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        *[c.alias(f"m{i}") for i, c in enumerate(dimensions.values())],
    )
    base = durable(base, "sizes")
    axes = len(dimensions)
    rows = durable(_dimensions(base, {n: F.col(f"m{i}") for i, n in enumerate(dimensions)}), "places").withColumn("node", F.lit(0))
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes)))
    level = [Node(0, shards)]
    while any(n.count > 1 for n in level):
        rows = _split_level(rows, [n for n in level if n.count > 1], axes)
        level = [m for n in level for m in ([Node(n.first, n.count // 2), Node(n.first + n.count // 2, n.count - n.count // 2)] if n.count > 1 else [n])]
        if len(level) % 8 == 0:
            rows = durable(rows, "level")
    return _slots(durable(rows.select("rid", "doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard")), "leaves"))


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers within each shard: places within hashed buckets of bounded size, plus the counts of the buckets before."""
    total = rows.count()
    buckets = max(8, -(-total // ROWS_PER_SLOT_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each bucket: a fraction 1 / ROWS_PER_SLOT_BUCKET of the rows, or a few hundred
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid"))
    placed = rows.withColumn("place", place)
    return placed.join(starts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
