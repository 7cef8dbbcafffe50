"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most `radius` bits agree in one of radius + 1 bands of neighbouring bits, so candidates
are the distinct fingerprints that share a band (more bands, of which several must agree, serve larger tables: see
`bands`). The rows of a task, sorted by band, are kept as 64 vertical bit planes; the pairs at one distance d in that order
are all compared at once: plane after plane is XORed with itself shifted by d rows and added to carry-save counters
(ones, twos, fours and more), and blocks of words in which every pair is already beyond the radius are abandoned. Links
are reduced to a forest within the task, so a group of n copies leaves n - 1 links. Buckets above BUCKET_ROWS are
cut into chunks, and each pair of chunks is a task of its own.

Defined results: null texts are empty ones; a text without a word has fingerprint 0 and is linked like any other;
documents with equal fingerprints are linked; repeated rows share a component; an empty table gives an empty table;
rows without an id have the component of their fingerprint where a row with an id has it too, else none (null); further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable, few, release, rows
from sluice.llm.components import components

#: The bytes that separate words, the hash's seed.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BUCKET_ROWS = 16384
#: Blocks of 64 pairs that are compared together.
BLOCKS_AT_ONCE = 16384
#: Shingles whose bits are counted at a time.
SLICE = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it set."""
    words = WORDS.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[:-1]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]  # noqa: B905
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), SLICE):
        counts += np.unpackbits(h[k : k + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = [], []
            for key, text in rows([batch], "doc_id", "text"):
                keys.append(key)
                prints.append(fingerprint(text, shingle))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64))], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- bit-sliced comparison ------------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit b of row i is bit i mod 64 of word i // 64 of plane b; one word of zeros follows."""
    n = -(-len(values) // 64)
    padded = np.zeros(n * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    return np.concatenate([packed, np.zeros((64, 1), "<u8")], 1)


def near_at(bits: np.ndarray, valid: np.ndarray, words: np.ndarray, d: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within the radius. Block k holds the 64 pairs of the rows in word words[k] with the rows d[k] below
    them, of which those set in valid[k] are compared."""
    left = valid.copy()  # pairs that are not beyond the radius yet
    bound = radius + 1
    depth = bound.bit_length()
    counter = np.zeros((depth, len(words)), "<u8")
    last = bits.shape[1] - 1
    down, high = (d & 63).astype(np.uint64), np.minimum(words + (d >> 6) + 1, last)
    low, up, whole = np.minimum(words + (d >> 6), last), (np.uint64(64) - down) & np.uint64(63), down == 0
    for b in range(64):
        plane = bits[b]
        carry = plane[words] ^ ((plane[low] >> down) | np.where(whole, np.uint64(0), plane[high] << up))
        for k in range(depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        # the counters stand at radius + 1 where all bits of the bound are set; such pairs are out for good
        over = ~np.uint64(0)
        for k in range(depth):
            over = over & (counter[k] if bound >> k & 1 else ~counter[k])
        left &= ~over
        if b & 3 == 3:
            open_ = left != 0
            if not open_.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if open_.sum() < 0.7 * len(open_):
                words, d, left, counter = words[open_], d[open_], left[open_], counter[:, open_]
                down, high, low, up, whole = down[open_], high[open_], low[open_], up[open_], whole[open_]
    found = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(words), 64)
    w, i = np.nonzero(found)
    rows_ = words[w] * 64 + i
    return rows_, rows_ + d[w]


class Forest:
    """Union-find over the rows of a task, many links at once; the root is the row of the least node. Trees are kept in
    the order of the nodes, one level deep between calls."""

    def __init__(self, nodes: np.ndarray):
        self.order = np.argsort(nodes, kind="stable")
        self.place = np.empty(len(nodes), np.int64)
        self.place[self.order] = np.arange(len(nodes))
        self.parent = np.arange(len(nodes))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b, parent = self.place[i], self.place[j], self.parent
        while len(a):
            x, y = parent[a], parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up

    def roots(self) -> np.ndarray:
        """The root's row for each row."""
        return self.order[self.parent[self.place]]


def compare_sorted(bucket: np.ndarray, side: np.ndarray, node: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Forest edges (node, root) among rows sorted by bucket. side 0: compared with all of the bucket; in buckets with
    sides 1 and 2 only rows of different sides are compared."""
    n = len(bucket)
    if n < 2:
        return []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size_of = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + size_of, size_of)  # for each row the end of its bucket
    bits = planes(values)
    forest = Forest(node)
    room = ends - np.arange(n) - 1  # rows of the bucket that follow
    rows_left = np.flatnonzero(room > 0)
    blocks: list[tuple] = []
    held, mixed = 0, bool(side.any())
    for d in range(1, int(size_of.max()) + 1):
        rows_left = rows_left[room[rows_left] >= d]
        mine = rows_left
        if mixed:
            a, b = side[mine], side[mine + d]
            mine = mine[(a == 0) | (a != b)]
        if len(mine):
            word = mine // 64
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            valid = np.bitwise_or.reduceat(np.uint64(1) << (mine % 64).astype(np.uint64), first)
            blocks.append((valid, word[first], np.full(len(first), d)))
            held += len(first)
        if blocks and (held >= BLOCKS_AT_ONCE or not len(rows_left)):
            i, j = near_at(bits, *(np.concatenate(x) for x in zip(*blocks, strict=True)), radius)
            forest.link(i, j)
            blocks, held = [], 0
        if not len(rows_left):
            break
    root = node[forest.roots()]
    apart = root != node
    return list(zip(node[apart].tolist(), root[apart].tolist(), strict=True))


def bands(distinct: int, radius: int) -> list[tuple[int, int]]:
    """(mask, shift-free key id) of the bit groups that must agree: enough of them that a bucket stays small on average."""
    pieces, agree = radius + 1, 1
    while pieces < radius + 4 and distinct > (1 << (64 * agree // pieces)) * 64:
        pieces, agree = pieces + 1, agree + 1
    edges = [64 * k // pieces for k in range(pieces + 1)]
    blocks = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(pieces)]
    return [(sum(blocks[k] for k in chosen), number) for number, chosen in enumerate(combinations(range(pieces), agree))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Forest edges (u, v) between the nodes of a table (fp, node) of distinct fingerprints."""
    total = distinct.count()
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m, k in bands(total, radius)])
    banded = distinct.select("fp", "node", F.explode(keys).alias("key")).select("fp", "node", F.xxhash64("key.band", "key.part").alias("bucket"))
    # buckets too large for one task: chunks by a hash, and a task for each pair of chunks
    large = durable(banded.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS).select("bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("chunks")), "large")
    if large.isEmpty():
        dealt = banded.select("bucket", F.lit(0).alias("side"), "node", "fp")
    else:
        split = banded.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        split = split.withColumn("c", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("chunks")).cast("int"))
        other = split.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
        dealt = other.select(
            F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o"))).alias("bucket"),
            F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"),
            "node",
            "fp",
        )
    spread = dealt.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            col = [table.column(k).to_numpy() for k in range(4)]
            found = compare_sorted(col[0], col[1], col[2], col[3].view(np.uint64), radius)
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= 4 * BUCKET_ROWS:
                table = pa.Table.from_batches(held)
                bucket = table.column(0).to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield from done(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).to_batches()
                count -= cut
        if held:
            yield from done(pa.Table.from_batches(held))

    return spread.mapInArrow(run, "u long, v long")


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a durable table (doc_id, fp)."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "prints")
    # a fingerprint of rows without an id takes no part in links and has no component of its own
    joined = components(links(distinct.where(F.col("node").isNotNull()), radius))
    out = distinct.join(durable(joined, "components"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return durable(out, "classes")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id (the least doc_id reachable over links) for every row."""
    prints = durable(fingerprints(docs, shingle), "fingerprints")
    out = prints.join(classes(prints, radius), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, one of each; rows without an id all stay."""
    found = near_duplicates(docs, radius, shingle)
    others = durable(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "others")
    kept = docs.join(few(others), "doc_id", "left_anti")
    repeated = durable(kept.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # the same row each time this is evaluated
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))
    single = kept.join(repeated, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(single)
