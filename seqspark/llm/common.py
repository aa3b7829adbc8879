"""Shared pieces of the training-data operators: tables, folders, hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where the session has none; in local mode only, as on a cluster
    that would lose data between machines."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="seqspark-"))
    return path.rstrip("/")


_LOCAL: dict[str, str] = {}


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/seqspark-{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends at a table
    that every executor can read, so a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of tables made by materialise() that no plan will read any more:
    those that a later round has replaced."""
    for df in frames:
        path = df.__dict__.pop("_seqspark_path", None)
        if path:
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


#: Bytes of the Arrow batches that executors hand to Python, and Spark's own setting.
BATCH_BYTES, _SPARK_BYTES = "4m", "67108864b"


def in_arrow(df: DataFrame, f, schema: str | StructType) -> DataFrame:
    """df.mapInArrow, in batches of few bytes: ones of 64 MB take executors several
    times that beside the heap. A session's own spark.sql.execution.arrow.maxBytesPerBatch stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == _SPARK_BYTES:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(f, schema)


def slices(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that a task turns few texts into Python
    objects at a time. At the end the worker gives its free memory back: Spark keeps
    workers for later tasks, and what they hold counts against the executor."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Returns free memory of Arrow's pool and of the C library to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([], f.type) for f in schema}, schema)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges (a, b): each node but the
    smallest of its component, with that smallest node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(nodes))
    while len(u):
        lu, lv = lab[u], lab[v]
        open_ = lu != lv
        u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
        if not len(u):
            break
        np.minimum.at(lab, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:  # pointer jumping
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    keep = lab != np.arange(len(nodes))
    return nodes[keep], nodes[lab[keep]]


def _forest(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size > 2_000_000:  # bounded memory: what is held shrinks to a forest, or leaves
            a, b = local_forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held, size = [(a, b)], len(a)
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                held, size = [], 0
    if held:
        a, b = local_forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge to another node.

    edges: two bigint columns, in any order, repeated or not; nulls and loops
    count for nothing. root is one node of the component, the same for all.

    Each task first replaces its edges by a forest. Then rounds of contraction:
    every node goes to the neighbour of least pseudo-random rank (or stays), the
    edges are rewritten to the targets, loops and repeats fall away. The nodes
    left shrink by a constant factor a round, on chains too. No neighbourhood is
    ever gathered: only minima by key, and joins that Spark may split by skew.
    """
    a, b = edges.columns[:2]
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    e = materialise(in_arrow(e, _forest, "a bigint, b bigint"), "edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    turn = 0
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rank = lambda c, k=turn: F.xxhash64(F.col(c), F.lit(k))
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("v"))).alias("m"))
        to = best.select("u", F.when(F.col("m.r") < rank("u"), F.col("m.v")).otherwise(F.col("u")).alias("t"))
        to = materialise(to, "hook")
        e2 = (
            e.join(to.select(F.col("u").alias("a"), F.col("t").alias("x")), "a")
            .join(to.select(F.col("u").alias("b"), F.col("t").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        before, e = e, materialise(e2, "edges")
        if turn:  # the nodes are read from the first edges
            discard(before)
        roots = roots.join(to.select(F.col("u").alias("root"), "t"), "root", "left").select("node", F.coalesce("t", "root").alias("root"))
        turn += 1
    return roots
