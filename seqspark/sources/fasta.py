"""FASTA files as DataFrames, and alignments as text files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.scratch import cut

#: What a split's records are: number within the split, and whether the split's first
#: piece is part of the header, which an open header of the split before would precede.
_RECORD = "path string, at bigint, k bigint, lead boolean, header string, sequence string"

#: Of a split: its records with residues, whether a header ends in it (or no header is open
#: at its start), and the text of the header that is open at its end.
_SUMMARY = "path string, at bigint, n bigint, closed boolean, tail string"

#: Splits whose summaries are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000
BROADCAST_BYTES = 64 << 20


def _walk(batches: Iterator[pa.RecordBatch]):
    """Events in a task's order: ("record", path, at, k, lead, header, sequence) for each record
    with residues, ("end", path, at, n, closed, tail) where a split ends."""
    place, k, closed, pending = None, 0, False, []

    def end():
        return "end", *place, k, closed, ">".join(pending) if pending else None

    for batch in batches:
        for path, at, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, at) != place:
                if place is not None:
                    yield end()
                place, k, closed, pending = (path, at), 0, at == 0, []
                if not at:  # a file's first piece stands before any header
                    body = piece.replace("\r", "").replace("\n", "")
                    if body:
                        yield "record", path, at, k, False, None, body
                        k = 1
                    continue
            head, line, body = piece.partition("\n")
            pending.append(head)
            if line:
                body = body.replace("\r", "").replace("\n", "")
                if body:
                    yield "record", path, at, k, not closed, ">".join(pending).removesuffix("\r"), body
                    k += 1
                pending, closed = [], True
    if place is not None:
        yield end()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [event[1:] for event in _walk(batches) if event[0] == "end"]
    if rows:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "at", "n", "closed", "tail"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()), ["path", "at", "k", "lead", "header", "sequence"]
    rows, size = [], 0
    for event in _walk(batches):
        if event[0] == "record":
            rows.append(event[1:])
            size += len(event[6])
            if len(rows) == 4096 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _known(parts: DataFrame) -> DataFrame:
    """(path, at, before, carried) from the splits' summaries: the records before a split, and
    the text of the header that is open where it begins. Both add up split by split (counts by
    sums, open headers by concatenation up to the last split that closed one)."""
    order = Window.partitionBy("path").orderBy("at")
    sums = parts.withColumn("chain", F.sum(F.col("closed").cast("int")).over(order)).withColumn("before", F.sum("n").over(order) - F.col("n"))
    tails = F.collect_list("tail").over(Window.partitionBy("path", "chain").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("so_far", F.when(F.size(tails) > 0, F.array_join(tails, ">")))
    return sums.select(F.col("path").alias("p_"), F.col("at").alias("a_"), "before", F.lag("so_far").over(order).alias("carried"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, seq_idx, header, sequence of every record of the files under path.

    A '>' outside a header begins one, mid-line too; a header ends with its line;
    line ends inside a sequence are dropped, every other character stays. Records
    without a residue vanish; text before any header is a record with a null
    header. A missing path raises Spark's PATH_NOT_FOUND; empty files have no records.
    One record stays below 2 GB.

    Each split gives its records where it is read. Files that
    are smaller than Spark's smallest split are read once. Larger ones are read a first time for a
    summary of each split (records, open header), from which its first number and what its
    first header goes on from follow; summaries are broadcast after a check of their size (beyond
    it, records are joined with them by a shuffle).
    """
    m = F.col("_metadata")
    text = spark.read.option("lineSep", ">").text(path)
    least = int(spark.conf.get("spark.sql.files.openCostInBytes").removesuffix("b"))
    part = text.where((m["file_size"] > least) & (m["file_block_length"] < m["file_size"]))
    rows = text.select(m["file_path"].alias("path"), m["file_block_start"].alias("at"), "value").mapInArrow(_records, _RECORD)
    if part.isEmpty():
        return rows.select("path", F.col("k").cast("int").alias("seq_idx"), "header", "sequence")
    parts = cut(part.select(m["file_path"].alias("path"), m["file_block_start"].alias("at"), "value").mapInArrow(_summaries, _SUMMARY))
    n, size = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("tail")), F.lit(0))).first()
    known = _known(parts)
    if n <= BROADCAST_SPLITS and size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = rows.join(known, (F.col("path") == F.col("p_")) & (F.col("at") == F.col("a_")), "left")
    index = F.coalesce("before", F.lit(0)) + F.col("k")
    header = F.when(F.col("lead") & F.col("carried").isNotNull(), F.concat("carried", F.lit(">"), "header")).otherwise(F.col("header"))
    return rows.select("path", index.cast("int").alias("seq_idx"), header.alias("header"), "sequence")


def sequence_stats(sequences: DataFrame) -> DataFrame:
    """Records and residues in all."""
    return sequences.agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("n_residues"))


def write_scores(results: DataFrame, path: str) -> None:
    """A score table (query_idx, result) as text lines, in order of query_idx within files."""
    r = F.col("result")
    place = F.transform(r["end_locations"], lambda e, i: F.concat(F.lit("("), F.when(r["start_locations"].isNull(), "?").otherwise(F.get(r["start_locations"], i).cast("string")), F.lit(", "), e.cast("string"), F.lit(")")))
    line = F.concat(F.lit("#"), F.col("query_idx").cast("string"), F.lit(": "), r["edit_distance"].cast("string"), F.lit("  "), r["num_locations"].cast("string"), F.lit(" [ "), F.coalesce(F.array_join(place, " "), F.lit("")), F.lit(" ]"))
    results.where(r["edit_distance"] >= 0).orderBy("query_idx").select(line.alias("value")).write.text(path)
