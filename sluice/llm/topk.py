"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; with segment means m and deviations s (both scaled by the root of the segment's length),
the inner product of q and x is at most the sum over segments of mq * mx + sq * sx. That is the lower bound on their
distance, as the squared distance falls by twice the inner product. Levels of 8, 16, 32 and 48 segments (of unequal length
where they do not divide the dimensions; each level's cuts are among the next one's) bound it coarse to fine; only pairs
whose bound reaches the query's k-th best so far go on, and those left are scored exactly, in integers. The first SEEDS
candidates of a task are scored to have a k-th best at all, then come slices that double, so that it rises early. While
most pairs of a slice are open, a level's bounds (never the scores) are found for the whole slice in one product.

Queries come in blocks of at most QUERY_BLOCK rows and BLOCK_BYTES, each broadcast against all candidates in place and
given up before the next one; a task hands on at most k candidates a query and these are merged and written.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; only vectors of equal
length are compared; ties go to the smaller vec_id; rows without a vec_id take no part; rows that share a vec_id are
candidates each, none for their own id, and as query the one with the least vector counts; fewer than k candidates are
all returned; an empty table gives an empty table; further columns are ignored. Scores beyond the longs are held at
their ends and there go by vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable, durable_parts

SCALE = 64
K = 20
LEVELS = (8, 16, 32, 48)
QUERY_BLOCK, BLOCK_BYTES = 16384, 16 << 20
SEEDS, TILE = 64, 2048
QUERIES_AT_ONCE = 256
#: Pairs that are scored together.
PAIRS_AT_ONCE = 1 << 15
#: Share of a slice's pairs above which bounds are found for the whole slice.
MOSTLY = 0.1
NONE = np.iinfo(np.int64).min


def segment_edges(d: int, segments: int) -> list[int]:
    return [d * k // segments for k in range(segments + 1)]


class Statistics:
    """The segments' scaled means and deviations of the rows of a matrix, level by level; segments of one component have
    no deviation."""

    def __init__(self, x: np.ndarray, kind=np.float64):
        n, d = x.shape
        self.levels = []
        for segments in LEVELS:
            if segments > d:
                continue
            edges = np.array(segment_edges(d, segments))
            size = np.diff(edges)
            mean = np.add.reduceat(x, edges[:-1], axis=1) / size
            rest = x - np.repeat(mean, size, axis=1)
            devs = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))
            self.levels.append(np.concatenate([mean * np.sqrt(size), devs[:, size > 1]], 1).astype(kind))


class BestOf:
    """The k best (score, least id) of each query so far; NONE where there are fewer."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def least(self, rows: slice) -> np.ndarray:
        last = self.scores[rows, -1]
        return np.where(last == NONE, -np.inf, last.astype(np.float64))

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates as flat lists; q: the queries' numbers. ~score falls as the score rises and cannot overflow."""
        if not len(q):
            return
        order = np.lexsort((ids, ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        q, ids, scores, rank = q[keep], ids[keep], scores[keep], rank[keep]
        who = np.unique(q)
        row = np.searchsorted(who, q)
        s = np.full((len(who), 2 * self.k), NONE)
        i = np.full((len(who), 2 * self.k), np.iinfo(np.int64).max)
        s[:, : self.k], i[:, : self.k] = self.scores[who], self.ids[who]
        s[row, self.k + rank], i[row, self.k + rank] = scores, ids
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def exact_type(q: np.ndarray, x: np.ndarray):
    """The fastest type in which all inner products are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two equally long matrices in one of the exact types, as longs."""
    if q.dtype != object:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([max(ends.min + 1, min(ends.max, sum(a * b for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


def _as(x: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


class Search:
    """The best candidates of queries of one length, over the tiles that a task meets."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.best = ids, vectors, BestOf(len(ids), k)
        self.small = float(np.abs(vectors).max(initial=0)) < 1 << 15
        self.kind = np.float32 if self.small else np.float64
        self.stats, self.norms = Statistics(vectors, self.kind), np.sqrt((vectors * vectors).sum(1))
        #: Pairs met and pairs scored.
        self.met, self.scored = 0, 0

    def tile(self, ids: np.ndarray, x: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            step = SEEDS if not self.met else min(TILE, max(SEEDS, self.met // max(1, len(self.ids))))
            self.slice(ids[at : at + step], x[at : at + step])
            at += step

    def slice(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.met += len(ids) * len(self.ids)
        kind = exact_type(self.vectors, x)
        exact_x, stats = _as(x, kind), Statistics(x, self.kind)
        # what rounding may take from a bound
        slack = (1e-5 if self.small else 1e-9) * float(np.sqrt((x * x).sum(1)).max(initial=0))
        for at in range(0, len(self.ids), QUERIES_AT_ONCE):
            rows = slice(at, at + QUERIES_AT_ONCE)
            part = _as(self.vectors[rows], kind)
            floor = (self.best.least(rows) - slack * self.norms[rows] - 1e-6).astype(self.kind)
            qs, cs = np.divmod(np.arange(len(floor) * len(ids)), len(ids))
            for a, b in zip(self.stats.levels, stats.levels, strict=True):
                if np.isneginf(floor).all():
                    break
                if len(qs) > MOSTLY * len(floor) * len(ids):
                    bound = (a[rows] @ b.T)[qs, cs]
                else:
                    bound = np.einsum("ij,ij->i", a[at + qs], b[cs])
                keep = bound >= floor[qs]
                qs, cs = qs[keep], cs[keep]
            self.scored += len(qs)
            scores = [exact_scores(part[qs[k : k + PAIRS_AT_ONCE]], exact_x[cs[k : k + PAIRS_AT_ONCE]]) for k in range(0, len(qs), PAIRS_AT_ONCE)]
            scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
            wanted = (self.ids[at + qs] != ids[cs]) & (scores >= self.best.scores[at + qs, -1])
            self.best.offer(at + qs[wanted], ids[cs[wanted]], scores[wanted])


def vectors(table: DataFrame, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double> of integers) of the rows that take part."""
    x = F.col(column)
    out = table.select(F.col(id_column).cast("long").alias("vec_id"), x.cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    out = out.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))))
    # floor() in doubles, as the product may exceed the longs
    return out.select("vec_id", F.transform("x", lambda e: F.when(e * scale >= F.lit(2.0**62), e * scale).when(e * scale <= F.lit(-(2.0**62)), e * scale).otherwise(F.floor(e * scale).cast("double"))).alias("v"))


def _merge(per_task: DataFrame, k: int) -> DataFrame:
    """The k best of the tasks' rows of each query, ranked. A sort that can spill; Spark limits the groups before and
    after the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = per_task.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both tables are (vec_id, v) as vectors() makes them."""
    spark = candidates.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    total = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-total["n"] // max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * (total["d"] or 1))))))
    dealt = durable(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")
    # few tasks hand on fewer candidates
    dense = candidates.coalesce(4 * spark.sparkContext.defaultParallelism)

    def parts() -> Iterator[DataFrame]:
        for block in range(blocks):
            found = dealt.where(F.col("block") == block).select("vec_id", "v").toArrow()
            by_size: dict[int, tuple] = {}
            sizes = np.array([len(v) for v in found.column("v")]) if found.num_rows else np.zeros(0, int)
            ids = found.column("vec_id").to_numpy()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                flat = found.take(rows).column("v").combine_chunks().flatten().to_numpy()
                by_size[int(d)] = (ids[rows], flat.reshape(len(rows), int(d)))
            shared = spark.sparkContext.broadcast(by_size)

            def run(batches, shared=shared) -> Iterator[pa.RecordBatch]:
                searches = {d: Search(q, x, k) for d, (q, x) in shared.value.items()}
                for batch in batches:
                    own = batch.column(0).to_numpy(zero_copy_only=False)
                    lists = batch.column(1)
                    start = lists.offsets.to_numpy()
                    sizes, flat = np.diff(start), lists.values.to_numpy(zero_copy_only=False)
                    for d, search in searches.items():
                        rows = np.flatnonzero(sizes == d)
                        for at in range(0, len(rows), TILE):
                            pick = rows[at : at + TILE]
                            search.tile(own[pick], flat[start[pick][:, None] + np.arange(d)])
                for search in searches.values():
                    for at in range(0, len(search.ids), 1024):
                        scores, found = search.best.scores[at : at + 1024], search.best.ids[at : at + 1024]
                        q, place = np.nonzero(scores != NONE)
                        yield pa.RecordBatch.from_arrays([pa.array(search.ids[at + q], pa.int64()), pa.array(found[q, place], pa.int64()), pa.array(scores[q, place], pa.int64())], names=["query_id", "vec_id", "score"])

            yield _merge(dense.mapInArrow(run, "query_id long, vec_id long, score long"), k)
            shared.destroy()

    return durable_parts(parts(), "top")


def nearest(table: DataFrame, divisor: int = 20, k: int = K, scale: int = SCALE) -> DataFrame:
    """The top k of every row whose id is divisible by the divisor, among all other rows."""
    v = vectors(table, scale)
    return top_k(v, v.where(F.col("vec_id") % divisor == 0), k)
