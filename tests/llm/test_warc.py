import base64
import hashlib

import pytest

from sluice.llm import warc


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/ü\n", ""), (5, "u", "é" * 70000), (6, "u", "é" * 70000), (7, "u", "x" * 65536), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (2, "http://a/2", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    out = sorted(tuple(r) for r in warc.archive_pages(df, least, 1000).select("page_id", "payload_bytes", "payload_digest", "record_type").collect())
    want = []
    for key, _, html in ROWS:
        size = len((html or "").encode())
        last = max(k for k, _, h in ROWS if (h or "") == (html or ""))
        want.append((key, size, b32(html), "response" if key == last or size < least else "revisit"))
    assert out == sorted(want)
    refers = {r["page_id"]: r["refers_to"] for r in warc.archive_pages(df, least).collect()}
    assert refers[5] == 6 and refers[6] is None and refers[1] == (2 if least == 0 else None)


def test_archives_are_warc_files(spark):
    df = spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1)
    rows = sorted(warc.records(df, chunk_bytes=3).collect(), key=lambda r: (r["archive"], r["record_id"], r["chunk"]))
    data = bytearray()
    warc.export(rows, data.extend)
    count = 0
    while data:
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and "\n" not in fields["WARC-Target-URI"]
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = bytearray(rest[n + 4 :])
        count += 1
    assert count == 4


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "hello world")], "page_id long, url string, html string")
    row = warc.records(df).first()
    reader = warc.RecordReader()
    reader.feed(bytes(row["data"]).replace(b"hello", b"jello"))
    with pytest.raises(ValueError, match="digest"):
        reader.result()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(empty).count() == 0
    none = spark.createDataFrame([(None, None, "a", 1), (None, "u", "a", 2), (3, "u", "b", 3)], "page_id long, url string, html string, bytes int")
    out = warc.archive_pages(none).collect()
    assert len(out) == 3 and {r["record_type"] for r in out} == {"response"}
