"""WARC archives: a writer with revisit records, and a reader that verifies record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.llm.common import discard, in_arrow, materialise, new_path

MAGIC = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as 32 base-32 characters."""
    h = F.sha1(payload)
    out = []
    for i in range(8):
        v = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per row of df, in files under path, written by Spark's own
    committed writer (a lost executor's files are written again).

    Of rows with equal payloads (html in UTF-8; null: empty) of min_bytes or more,
    the one with the largest id is the response; the others are revisits that
    refer to it and carry no payload. Smaller ones are all responses. Rows that
    share the largest id and the payload are all responses; null ids count as
    smallest. Line ends and spaces in urls are percent-encoded; a null url is left out.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("n", F.octet_length("body").cast("bigint")).withColumn("digest", sha1_base32(F.col("body").cast("binary")))
    # only payloads that occur twice need a join; it is broadcast where that table is small
    shared = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    shared = materialise(shared, "payloads")
    rows = rows.join(shared, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", safe)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("first")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("body")),
        F.lit("\r\n\r"),  # the writer adds the last \n
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


_LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_FIELD = {k: re.compile(rb"^" + k.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", re.I | re.M) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Payload-Length", "WARC-Refers-To")}

#: What a candidate's header says, as far as it is one.
_SAID = "type string, record_id string, url string, header_digest string, header_length bigint, refers_to string"
_CAND = "file string, split bigint, idx bigint, rel bigint, size bigint, head bigint, length bigint, complete boolean, digest string, " + _SAID


def _said(header: bytes) -> list:
    got = [m[1].decode(errors="replace") if (m := p.search(header)) else None for p in _FIELD.values()]
    got[4] = int(got[4]) if got[4] and got[4].isdigit() else None
    return got


def _digest(payload) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _segments(batches):
    """(file, split, index in the split, segment) in the order of the file."""
    at, idx = None, 0
    for batch in batches:
        for file, split, seg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, split) != at:
                at, idx = (file, split), 0
            yield file, split, idx, seg.as_buffer()
            idx += 1


def _candidates(with_payload: bool):
    def run(batches):
        names = [x.split()[0] for x in _CAND.split(", ")] + ["payload"] * with_payload
        rel, at, rows = 0, None, []

        def out():
            cols = list(zip(*rows, strict=True))
            types = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        held = 0
        for file, split, idx, buf in _segments(batches):
            if (file, split) != at:
                at, rel = (file, split), 0
            seg = memoryview(buf)
            head, length, complete, digest, said, payload = None, None, False, None, [None] * 6, None
            front = bytes(seg[: 1 << 16])
            end = front.find(b"\r\n\r\n")
            if end < 0 and len(seg) > len(front):  # an uncommonly long header
                front = bytes(seg)
                end = front.find(b"\r\n\r\n")
            if end >= 0 and (m := _LENGTH.search(front[: end + 2])):
                head, length = end, int(m[1])
                complete = len(seg) == head + length + 8
                said = _said(front[: end + 2])
                if complete:
                    payload = seg[head + 4 : head + 4 + length]
                    digest = _digest(payload)
            row = [file, split, idx, rel, len(seg), head, length, complete, digest, *said]
            if with_payload:
                row.append(bytes(payload) if payload is not None else None)
                held += len(seg)
            rows.append(row)
            rel += len(seg) + len(MAGIC)
            if len(rows) >= 5_000 or held > 8_000_000:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return run


def _next(t: pa.Table):
    t = t.sort_by("start")
    start = t["start"].to_numpy()
    succ = t["succ"].fill_null(-1).to_numpy()
    j = np.searchsorted(start, succ)
    inside = (j < len(start)) & (start[np.minimum(j, len(start) - 1)] == succ) & (succ > start)
    return t, start, succ, np.where(inside, j, np.arange(len(start)))


def _exits(t: pa.Table) -> pa.Table:
    """Where the chain of each candidate of a split leaves it, by pointer jumping."""
    t, start, succ, nxt = _next(t)
    while True:
        far = nxt[nxt]
        if (far == nxt).all():
            break
        nxt = far
    return pa.table({"file": t["file"], "split": t["split"], "start": t["start"], "exit": pa.array(succ[nxt], pa.int64())})


def _marks(t: pa.Table) -> pa.Table:
    """Which candidates of a split the chain from its entry reaches; the record that covers each."""
    t, start, succ, nxt = _next(t)
    reach = t["entry"].fill_null(False).to_numpy(zero_copy_only=False).copy()
    while True:
        before = reach.sum()
        reach[nxt[reach]] = True
        nxt = nxt[nxt]
        if reach.sum() == before and (nxt[nxt] == nxt).all():
            reach[nxt[reach]] = True
            break
    last = np.maximum.accumulate(np.where(reach, start, -1)) if len(start) else start
    return pa.table({"file": t["file"], "split": t["split"], "idx": t["idx"], "start": t["start"], "verified": pa.array(reach), "owner": pa.array([x if x >= 0 else None for x in last.tolist()], pa.int64())})


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("seg"))


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the WARC files under path: file, offset, type, record_id,
    url, refers_to, header_digest, header_length, payload_bytes, digest (SHA-1 of
    what was read, base 32), and payload (binary) where asked for.

    Files are read in splits by any number of tasks. Every occurrence of the magic
    is a candidate with its successor's offset (own offset + header + declared
    length). Each split jumps its own chains to where they leave it; then pointer
    jumping over the splits' entries, from the start of each file, finds the ones
    reached. Only records on the chain from the file's start count, so a magic
    inside a payload is no record, and what follows a broken record is dropped.
    Empty files and folders without records give no rows.
    """
    cands = materialise(in_arrow(_scan(spark, path), _candidates(payload), _CAND + ", payload binary" * payload), "candidates")
    m = len(MAGIC)
    totals = cands.groupBy("file", "split").agg(F.sum(F.col("size") + m).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # a row a split
    placed = cands.select("file", "split", "idx", "rel", "head", "length", "complete").join(bases, ["file", "split"])
    start = F.col("base") + F.col("rel") - m
    placed = placed.select("file", "split", "idx", start.alias("start"), (start + m + F.col("head") + 4 + F.col("length") + 4).alias("succ"), "complete").where("start >= 0")
    placed = materialise(placed, "chain")
    links = placed.groupBy("file", "split").applyInArrow(_exits, "file string, split bigint, start bigint, exit bigint")
    links = materialise(links.select("file", "start", "exit"), "exits")
    gates = links.select("file", F.col("exit").alias("start")).distinct()
    jump = links.join(gates, ["file", "start"], "left_semi").union(links.where("start = 0")).distinct()
    jump = materialise(jump, "jumps")
    reached = materialise(jump.where("start = 0").select("file", "start"), "reached")
    count = -1
    while (now := reached.count()) != count:
        count = now
        ahead = reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        ahead = ahead.join(jump.select("file", "start"), ["file", "start"], "left_semi")
        was, reached = reached, materialise(reached.union(ahead).distinct(), "reached")
        to = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("exit2"))
        old, jump = jump, materialise(jump.join(to, ["file", "exit"], "left").select("file", "start", F.coalesce("exit2", "exit").alias("exit")), "jumps")
        discard(was, old)
    entries = reached.withColumn("entry", F.lit(True))
    marked = placed.join(entries, ["file", "start"], "left").groupBy("file", "split").applyInArrow(_marks, "file string, split bigint, idx bigint, start bigint, verified boolean, owner bigint")
    marked = materialise(marked, "marks")
    said = ["type", "record_id", "url", "refers_to", "header_digest", "header_length"]
    place = ["file", "split", "idx"]
    ours = cands.join(marked.where("verified").select(*place, "start"), place)
    whole = ours.where("complete").select("file", F.col("start").alias("offset"), *said, F.col("length").alias("payload_bytes"), "digest", *["payload"] * payload)
    broken = ours.where("NOT complete")
    if broken.isEmpty():
        return whole
    # payloads that hold the magic: their pieces are read again and put together
    carry = marked.groupBy("file", "split").agg(F.max(F.when(F.col("verified"), F.col("start"))).alias("last"))
    carry = carry.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("carry"))
    pieces = marked.join(carry, ["file", "split"]).select(*place, "start", F.coalesce("owner", "carry").alias("owner"))
    heads = broken.select("file", F.col("start").alias("owner"), "head", "length", *said)
    pieces = materialise(pieces.join(heads.select("file", "owner"), ["file", "owner"], "left_semi"), "pieces")

    def segments(batches):
        rows, size = [], 0
        for row in _segments(batches):
            rows.append(row[:3] + (bytes(memoryview(row[3])),))
            size += len(rows[-1][3])
            if size > 8_000_000:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["file", "split", "idx", "seg"])

    def assemble(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        row = t.slice(0, 1)
        head, length = row["head"][0].as_py(), row["length"][0].as_py()
        body = MAGIC.join(t["seg"].to_pylist())[head + 4 :]
        content = body[:length] if len(body) == length + 4 and body.endswith(b"\r\n\r\n") else None
        cols = {"file": row["file"], "offset": row["owner"], **{k: row[k] for k in said}, "payload_bytes": pa.array([length if content is not None else None], pa.int64()), "digest": pa.array([_digest(content) if content is not None else None], pa.string())}
        if payload:
            cols["payload"] = pa.array([content], pa.binary())
        return pa.table(cols)

    again = in_arrow(_scan(spark, path), segments, "file string, split bigint, idx bigint, seg binary").join(pieces, place)
    schema = "file string, offset bigint, type string, record_id string, url string, refers_to string, header_digest string, header_length bigint, payload_bytes bigint, digest string" + ", payload binary" * payload
    joined = again.join(heads, ["file", "owner"]).groupBy("file", "owner").applyInArrow(assemble, schema)
    return whole.union(joined.where("payload_bytes IS NOT NULL"))


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes df's rows as WARC files under path (a new shared folder if None) and
    reads them back: id_col, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the payload read; a revisit has
    its header's, which are the full payload's. Records whose payload differs from
    its declared digest are left out. A null html is an empty payload; equal payloads
    are told by their bytes, of pages with equal ids one is named. Null ids and repeated
    rows are records of their own, other columns are not looked at, an empty table gives
    no rows. Payloads below 2 GB."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    path = path or new_path(spark, "warc")
    write(df, path, id_col, url_col, html_col, min_bytes)
    got = read(spark, path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    revisit = F.col("type") == "revisit"
    stated = F.regexp_replace("header_digest", "^sha1:", "")
    got = got.where(revisit | (stated == F.col("digest")))
    return got.select(
        number("record_id").alias(id_col),
        F.when(revisit, F.col("header_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )
