import base64
import hashlib

import pytest

from seqspark.llm import warc

MAGIC = "WARC/1.0\r\n"


def expected(rows, min_bytes=0):
    """Brute force: {(id, bytes, digest, type, refers_to)} of the round trip."""
    top = {}
    for i, h in rows:
        b = (h or "").encode()
        top[b] = max(top.get(b, -1), -1 if i is None else i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= min_bytes and top[b] != (-1 if i is None else i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[b] if revisit else None))
    return sorted(out, key=str)


def trip(spark, rows, **kw):
    df = spark.createDataFrame([(i, "http://x/ y\r\nz" if i != 1 else None, h, "clash") for i, h in rows], "page_id bigint, url string, html string, digest string")
    return sorted(map(tuple, warc.round_trip(df, **kw).collect()), key=str)


ROWS = [
    (0, "<p>a</p>"),
    (1, None),
    (2, ""),
    (3, "<p>a</p>"),
    (4, f"x{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{MAGIC}tail"),
    (5, MAGIC),
    (6, f"{MAGIC}Content-Length: 4\r\n\r\nabcd"),
    (7, "é\r\n\r\n" * 50),
    (8, f"{MAGIC}Content-Length: 5\r\n\r\nabcde\r\n\r\n" * 40),
    (9, "\r\n" + MAGIC * 3),
    (None, "only once"),
    (None, "<p>a</p>"),
    (10, "long " * 30_000),
]


@pytest.mark.parametrize("split", ["128m", "700b", "64b"])
def test_round_trip(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    rows = ROWS if split != "64b" else ROWS[:10]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert trip(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_minimum_and_repeated_rows(spark):
    rows = [(1, "same text"), (2, "same text"), (3, "s"), (4, "s"), (2, "same text")]
    assert trip(spark, rows, min_bytes=5) == expected(rows, 5)


def test_empty(spark):
    assert trip(spark, []) == []


def test_broken_record_ends_the_chain(spark, tmp_path):
    good = lambda i, body: f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good(1, "one") + good(2, "two").replace("Content-Length: 3", "Content-Length: 9") + good(3, "three")).encode())
    (tmp_path / "b.warc").write_bytes(b"")
    got = warc.read(spark, f"file://{tmp_path}", payload=True).select("record_id", "payload").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("<urn:page:1>", b"one")]
