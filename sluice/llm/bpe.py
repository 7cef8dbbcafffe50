"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A byte string's encoding is the one token sequence in which every neighbouring pair (a, b) is *stable*: encoding the
bytes of a and b together gives a, b again. (Take the first merge over the whole string that crosses a boundary of a
stable sequence: limited to the two tokens beside that boundary, the merges so far are those of a run over that pair
alone, so that run would cross the boundary too.) Two encoded halves are therefore joined by encoding the bytes of a
small window around their seam anew and growing it until the pairs at both of its edges are stable; all else stands.

Defined results: null and empty texts have no tokens; any other text, however long, is encoded whole; equal texts have
equal ids; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Collector, rows

#: The characters of Unicode's White_Space property, as a character class.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Halves of no more bytes are not halved again; windows of more bytes are merged with a heap.
LEAF_BYTES, WINDOW_BYTES = 6, 64
MEMO_ENTRIES = 300_000
MEMO_TEXT = 48
NO_RANK = 1 << 30


class BytePairCodec:
    """Encoder and decoder for a file of ranks; every method is exact for inputs of any length."""

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}

        white = WHITE_SPACE
        if pattern in (None, public_tokenizers.PATTERN):
            #: No match of this pattern crosses an end of these units, so they are encoded and remembered one by one.
            self.units = re.compile(f" ?[^{white}]+|[{white}]+(?![^{white}])|[{white}]+").findall
            self.matches = regex.compile(public_tokenizers.PATTERN.replace(r"\s", f"[{white}]").replace(f"[^[{white}]", f"[^{white}")).findall
        else:
            #: Nothing is known of another pattern: the unit is the text.
            self.units, found = (lambda text: [text]), regex.compile(pattern).finditer
            self.matches = lambda text: [m.group() for m in found(text)]
        #: How often two halves were joined.
        self.joins = 0
        self.leaf_memo: dict[bytes, tuple[bytes, ...]] = {}
        #: Two generations each: when the younger is full it becomes the older, whose entries come back as they are met.
        self.unit_memo: dict[str, bytes] = {}
        self.unit_older: dict[str, bytes] = {}
        self.match_memo: dict[str, bytes] = {}
        self.match_older: dict[str, bytes] = {}
        self.pair_memo: dict[tuple[bytes, bytes], bool] = {}

    # ---- the monoid -------------------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding of a leaf or window, by merging neighbours of lowest rank first."""
        if len(data) > WINDOW_BYTES:
            return self.merge_long(data)
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return parts

    def merge_long(self, data: bytes) -> list[bytes]:
        """The same with a heap, for windows that had to grow."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            a = parts[i]
            j = after[i]
            if a is None or j >= n or ranks.get(a + parts[j]) != r:
                continue
            parts[i], parts[j] = a + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (s, h))
        return [p for p in parts if p is not None]

    def stable(self, a: bytes, b: bytes) -> bool:
        known = self.pair_memo.get((a, b))
        if known is None:
            if len(self.pair_memo) > MEMO_ENTRIES:
                self.pair_memo.clear()
            known = self.pair_memo[a, b] = self.merge(a + b) == [a, b]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the two halves' bytes together."""
        if not left or not right:
            return left or right
        self.joins += 1
        width = 2
        if len(left) <= width and len(right) <= width:  # the window is the whole
            return self.merge(b"".join(left) + b"".join(right))
        if self.stable(left[-1], right[0]):
            left.extend(right)
            return left
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(left[i:]) + b"".join(right[:j]))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                del left[i:]
                left.extend(window)
                left.extend(right[j:])
                return left
            width *= 2

    def leaf(self, data: bytes) -> list[bytes]:
        if (known := self.leaf_memo.get(data)) is None:
            if len(self.leaf_memo) >= MEMO_ENTRIES:
                self.leaf_memo.clear()
            known = self.leaf_memo[data] = tuple(self.merge(data))
        return list(known)

    def tree(self, data: bytes) -> list[bytes]:
        """Halves are encoded by themselves, recursively, and joined."""
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    # ---- texts ------------------------------------------------------------------------------------------------

    def match(self, text: str) -> bytes:
        if (packed := self.match_memo.get(text)) is not None:
            return packed
        if (packed := self.match_older.get(text)) is None:
            ranks, data = self.ranks, text.encode()
            # a match that is a token is not encoded, whether merges lead to it or not; the tiktoken library does so too
            packed = array("I", [ranks[data]] if data in ranks else [ranks[t] for t in self.tree(data)]).tobytes()
        if len(text) <= MEMO_TEXT:
            if len(self.match_memo) >= MEMO_ENTRIES:
                self.match_memo, self.match_older = {}, self.match_memo
            self.match_memo[text] = packed
        return packed

    def unit(self, text: str) -> bytes:
        if (packed := self.unit_older.get(text)) is None:
            packed = b"".join([self.match(m) for m in self.matches(text)])
        if len(text) <= MEMO_TEXT:
            if len(self.unit_memo) >= MEMO_ENTRIES:
                self.unit_memo, self.unit_older = {}, self.unit_memo
            self.unit_memo[text] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, unit = self.unit_memo.get, self.unit
        return b"".join([known(u) or unit(u) for u in self.units(text)])

    def encode(self, text: str) -> list[int]:
        return list(array("I", self.encode_packed(text)))

    def decode_bytes(self, ids) -> bytes:
        """Concatenates the tokens' bytes up the tree."""
        tokens = self.tokens
        level = [b"".join([tokens[i] for i in ids[at : at + 4096]]) for at in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_CODECS: dict[tuple, BytePairCodec] = {}


def codec(path: str, pattern: str | None = None) -> BytePairCodec:
    """One codec for each Python worker and file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; vocabulary names a file of ranks on every executor."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        c, out = codec(vocabulary, pattern), Collector(pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), most=256)
        for key, text in rows(batches, "doc_id", "text"):
            ids = c.encode(text or "")
            yield from out.add(key, ids, weight=4 * len(ids))
        yield from out.flush()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); null ids give empty data."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        c, out = codec(vocabulary), Collector(pa.schema([("doc_id", pa.int64()), ("data", pa.binary())]), most=256)
        for key, ids in rows(batches, "doc_id", "ids"):
            data = c.decode_bytes(ids or [])
            yield from out.add(key, data, weight=len(data))
        yield from out.flush()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass; digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        c, out = codec(vocabulary, pattern), Collector(schema)
        for key, text in rows(batches, "doc_id", "text"):
            packed = c.encode_packed(text or "")
            data = c.decode_bytes(array("I", packed))
            yield from out.add(key, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest())
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
