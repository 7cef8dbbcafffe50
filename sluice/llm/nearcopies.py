"""Near copies by the Jaccard similarity of word shingles: an exact set-similarity join over whole texts.

A text is the set of its runs of `shingle` lower-cased words, as 64-bit hashes, of which 40 bits and the rarity are compared; one of no
more words is one shingle, one without words has none and resembles nothing. A row goes if a row of smaller doc_id, kept or not, has a Jaccard similarity
of at least `threshold` with it, so no two similar rows stay.

Defined results: null texts are empty ones; rows without an id all stay and take no part; other ids must not repeat; an
empty table gives an empty table; further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Collector, durable, few, release, rows
from sluice.llm.setjoin import with_earlier
from sluice.llm.simhash import LOWER, SEED, WORDS

THRESHOLD, SHINGLE = 0.8, 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Shingles are counted in 2^RARITY_BITS buckets by the high bits of their hash: a table of fixed size, 4 MB. It must tell
#: the shingles of many texts from those of one: where it cannot, texts that are not alike meet by them.
RARITY_BITS = 22
#: Buckets whose counts travel in one row.
TOGETHER = 1 << 14
#: The bits of a hash that are kept in a set, as shingles do not compress.
_LOW = np.uint64((1 << 40) - 1)


def keys_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles."""
    words = WORDS.findall((text or "").encode().translate(LOWER))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    else:
        each = np.array([digest(w, SEED) for w in words], np.uint64)
        n = len(words) - shingle + 1
        hashes = each[:n]
        for k in range(1, shingle):
            hashes = (hashes ^ (hashes >> np.uint64(29))) * _FACTOR + each[k : k + n]
    return np.unique(hashes * _FACTOR)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")


def levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """For each bucket of shingles a number that rises with the documents' different shingles in it: a table of fixed size."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(1 << RARITY_BITS, np.uint32), [], 0

        def add() -> None:
            met, n = np.unique(np.concatenate(held), return_counts=True)
            counts[met] += n.astype(np.uint32)

        for _, text in rows(batches, "id", "text"):
            held.append((keys_of(text, shingle) >> np.uint64(64 - RARITY_BITS)).astype(np.int32))
            waiting += len(held[-1])
            if waiting > 1 << 20:
                add()
                held, waiting = [], 0
        if held:
            add()
        for k in range(0, len(counts), TOGETHER):
            if (part := counts[k : k + TOGETHER]).any():
                # the bytes of one weight side by side, as most are 0
                packed = np.ascontiguousarray(part.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=["k", "counts"])

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for k, packed in rows(batches, "k", "counts"):
            part = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
            sums[k] = sums.get(k, 0) + part.astype(np.int64)
        for k, total in sums.items():
            level = np.minimum(127, 3 * np.log2(total + 1.0)).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level], pa.binary())], names=["k", "level"])

    # a byte for each bucket comes to the driver, whatever the input
    found = _keyed(docs).mapInArrow(count, "k int, counts binary").repartition("k").mapInArrow(add_up, "k int, level binary").toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int8)
    for k, level in zip(found.column("k").to_pylist(), found.column("level").to_pylist(), strict=True):
        out[k : k + len(level)] = np.frombuffer(level, np.int8)
    return out


def sets(docs: DataFrame, level: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """id, n, keys, bits of every row with an id, rare shingles first: the level stands in a key's highest byte."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("bits", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        out = Collector(schema)
        for key, text in rows(batches, "id", "text"):
            hashes = keys_of(text, shingle)
            high = level[(hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
            keys = np.unique(high | hashes & _LOW)
            bits = np.bitwise_xor.reduce(np.left_shift(np.uint64(1), keys & np.uint64(63)), initial=np.uint64(0))
            yield from out.add(key, len(keys), keys.view(np.int64), int(bits.astype(np.int64)), weight=8 * len(keys))
        yield from out.flush()

    return _keyed(docs).mapInArrow(run, "id long, n int, keys array<long>, bits long")


def without_later(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows that resemble an earlier one."""
    # the shingles are made twice, so that they are written once: they do not compress
    found = durable(sets(docs, levels(docs, shingle), shingle), "shingles", "zstd")
    later = durable(with_earlier(found, threshold).select(F.col("id").alias("__later")).distinct(), "later")
    release(found)
    return docs.join(few(later), F.col("doc_id").cast("long") == F.col("__later"), "left_anti")
