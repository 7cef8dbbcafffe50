"""WARC archives as a chunked record table.

A record is a run of rows (archive, record_id, chunk, data): chunk 0 opens with the record's header, the last chunk ends
with its closing line breaks, and the chunks of an archive's records one after another are a WARC/1.1 file (see
`export`). Payloads above CHUNK_BYTES are cut by Spark before Python sees them, so no Python worker holds a whole
payload: digests() and the reader carry a SHA-1 that is updated chunk by chunk. The JVM does hold each whole payload, and
records() hashes it there for the headers. Only records of several chunks are shuffled when archives are read back.

Of records with equal payloads of at least `least_bytes` bytes, that with the largest page_id is `response` and holds
the payload; the others are `revisit` records that refer to it.

Defined results: null html is an empty payload; rows that repeat both page_id and payload are all of the type that the
page_id has; a null page_id counts as least and, where all are null, the records are responses; null urls are written as
about:blank; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Collector, durable, rows

CHUNK_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"

ROW = pa.schema([("archive", pa.string()), ("record_id", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("data", pa.binary())])
ROW_DDL = "archive string, record_id long, chunk long, chunks long, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, bytes, chunk, chunks, data: a row for each chunk of a payload, in order."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    cut = pages.select("*", body.alias("body")).withColumn("bytes", F.octet_length("body").cast("long"))
    count = F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk_bytes).cast("int"))
    out = cut.select(*[c for c in cut.columns if c != "html"], count.alias("chunks"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return out.withColumn("data", F.expr(f"substring(body, chunk * {chunk_bytes} + 1, {chunk_bytes})")).drop("body")


def digests(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, bytes, sha1 (base32) of every payload."""
    schema = pa.schema([("page_id", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, state = Collector(schema), None
        for key, size, chunk, chunks, data in rows(batches, "page_id", "bytes", "chunk", "chunks", "data"):
            if chunk == 0:
                state = hashlib.sha1(usedforsecurity=False)
            state.update(data)
            if chunk == chunks - 1:
                yield from out.add(key, size, base32(state.digest()))
        yield from out.flush()

    return chunked(pages.select("page_id", "html"), chunk_bytes).select("page_id", "bytes", "chunk", "chunks", "data").mapInArrow(run, "page_id long, bytes long, sha1 string")


def _clean(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "about:blank"


def header(page_id, url, size: int, sha1: str, refers_to) -> bytes:
    """The record's header, up to where the payload begins."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    kind = "response" if refers_to is None else "revisit"
    length = len(http) + (size if kind == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def decisions(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the revisits; found: a durable table as digests() makes it."""
    groups = found.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # read from files on both sides, so that Spark can split the rows of a payload with very many copies
    repeated = durable(groups.where("n > 1 and last is not null").select("sha1", "bytes", "last"), "repeated")
    joined = found.join(repeated, ["sha1", "bytes"])
    return durable(joined.where(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", "sha1", F.col("last").alias("refers_to")).distinct(), "revisits")


def records(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives' chunk rows for a table of page_id, url, html."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = durable(digests(pages, chunk_bytes), "digests")
    revisits = decisions(found, least_bytes).withColumnsRenamed({"page_id": "r_page", "sha1": "r_sha1"})
    # the digest besides the id: a page_id may come with several payloads
    sha1 = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    if revisits.isEmpty():
        typed = pages.withColumn("hex", sha1).withColumn("refers_to", F.lit(None).cast("long"))
    else:
        told = hexed(revisits)
        typed = pages.withColumn("hex", sha1).join(told, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("hex") == F.col("r_hex")), "left")
    typed = typed.select("page_id", "url", "hex", "refers_to", "html")
    cut = chunked(typed, chunk_bytes)
    cut = cut.where(F.col("refers_to").isNull() | (F.col("chunk") == 0))

    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out, number, archive, written = Collector(ROW, most=1024), 0, 0, 0
        for key, url, digest, refers, size, chunk, chunks, data in rows(batches, "page_id", "url", "hex", "refers_to", "bytes", "chunk", "chunks", "data"):
            if chunk == 0:
                if written >= archive_bytes:
                    archive, written = archive + 1, 0
                number += 1
                data = header(key, url, size, base32(bytes.fromhex(digest)), refers) + (data if refers is None else b"")
                chunks = chunks if refers is None else 1
            if chunk == chunks - 1 or refers is not None:
                data += b"\r\n\r\n"
            written += len(data)
            yield from out.add(f"{task:06d}-{archive:06d}", (task << 36) + number, chunk, chunks, data, weight=len(data))
        yield from out.flush()

    return cut.select("page_id", "url", "hex", "refers_to", "bytes", "chunk", "chunks", "data").mapInArrow(run, ROW_DDL)


def hexed(revisits: DataFrame) -> DataFrame:
    """base32 digests as hexadecimal ones: 32 letters of 5 bits are 40 digits of 4."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.lpad(F.bin(F.instr(F.lit(letters), F.substring("r_sha1", i, F.lit(1))) - 1), 5, "0")), "")
    return revisits.withColumn("b", bits).select(
        "r_page", "refers_to", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(157), F.lit(4)), lambda i: F.lower(F.conv(F.substring(F.col("b"), i, F.lit(4)), 2, 16))), "").alias("r_hex")
    )


class RecordReader:
    """Reads one record from its chunks as they come."""

    def __init__(self):
        self.head, self.fields, self.left, self.http, self.sha1 = b"", None, 0, None, hashlib.sha1(usedforsecurity=False)
        self.payload = 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            version, *lines = self.head[:end].decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            self.fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
            self.left = int(self.fields["content-length"])
            data, self.head = self.head[end + 4 :], b""
        if self.http is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            self.http = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in self.head[:end].decode().split("\r\n")[1:])}
            data, self.left, self.head = self.head[end + 4 :], self.left - end - 4, b""
        part = data[: self.left]
        self.sha1.update(part)
        self.payload += len(part)
        self.left -= len(part)

    def result(self) -> tuple:
        """page_id, payload_bytes, payload_digest, record_type, refers_to."""
        if self.left:
            raise ValueError(f"record {self.fields.get('warc-record-id')} lacks {self.left} bytes")
        number = lambda name: int(v) if (v := self.fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]) else None
        kind, digest, size = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:"), int(self.http["content-length"])
        if kind == "response" and (base32(self.sha1.digest()) != digest or self.payload != size):
            raise ValueError(f"record {self.fields['warc-record-id']}: the payload differs from its digest")
        return number("warc-record-id"), size, digest, kind, number("warc-refers-to")


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of archives' chunk rows; digests are those of the payloads as read."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, reader, expected = Collector(schema), None, 0
        for record, chunk, chunks, data in rows(batches, "record_id", "chunk", "chunks", "data"):
            if chunk == 0:
                reader = RecordReader()
            elif chunk != expected:
                raise ValueError(f"record {record}: chunk {expected} is missing")
            reader.feed(data)
            expected = chunk + 1
            if expected == chunks:
                yield from out.add(*reader.result())
        yield from out.flush()

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    columns = ("record_id", "chunk", "chunks", "data")
    single = archives.where(F.col("chunks") == 1).select(*columns).mapInArrow(run, ddl)
    several = archives.where(F.col("chunks") > 1).select(*columns).repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(run, ddl)
    return single.union(several).select(*names)


def export(archives: Iterable, write) -> None:
    """Hand an archive's bytes to write(), from its rows sorted by record_id and chunk."""
    for row in archives:
        write(row["data"])


def gzip_member(data: bytes) -> bytes:
    """A record as a gzip member of its own, as .warc.gz files hold them."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def archive_pages(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record for each page, then read the archives back."""
    return read(durable(records(pages, least_bytes, chunk_bytes), "warc"))
