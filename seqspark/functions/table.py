"""Locations as rows: a table function for LATERAL joins, and its DataFrame form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark import kernel
from seqspark.config import AlignConfig
from seqspark.format import cigar, nice
from seqspark.functions.align import RESULT, STRUCT, align, as_struct, batch_align, batch_distances
from seqspark.functions.names import fresh


class AlignLocations:
    def eval(self, query: str, target: str, mode: str = "HW", k: int = -1):
        if query is None or target is None:
            return
        r = kernel.align(query, target, AlignConfig(mode=mode, k=k, task="locations"))
        starts = r.starts or [None] * len(r.ends or [])
        for i, (s, e) in enumerate(zip(starts, r.ends or [], strict=True)):
            yield i, s, e


def register(spark: SparkSession) -> None:
    """The SQL functions seq_distance, seq_align, seq_cigar, seq_nice (a batch of rows a
    call) and the table function seq_locations."""
    made = F.udtf(AlignLocations, returnType="location_idx int, start int, end int")
    spark.udtf.register("seq_locations", made)

    spark.udf.register("seq_align", _arrow(seq_align, RESULT))
    spark.udf.register("seq_distance", _arrow(seq_distance, "int"))
    spark.udf.register("seq_cigar", _arrow(seq_cigar, "string"))
    spark.udf.register("seq_nice", _arrow(seq_nice, "query_aligned string, matched_aligned string, target_aligned string"))


def _arrow(f, ret: str):
    """An Arrow function of as many arrays as f has arguments."""
    n = f.__code__.co_argcount
    f.__annotations__ = dict.fromkeys(f.__code__.co_varnames[:n], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(f, ret)


def _by_settings(queries, targets, settings: list[pa.Array], work, kind: pa.DataType) -> pa.Array:
    """work(queries, targets, settings) for the rows of each combination of settings, a
    constant one as a rule; null where any of the arguments is."""
    combos = list(zip(*(s.to_pylist() for s in settings), strict=True))
    out = [None] * len(combos)
    for combo in dict.fromkeys(combos):
        if any(x is None for x in combo):
            continue
        rows = [i for i, c in enumerate(combos) if c == combo]
        if len(rows) == len(combos):
            return work(queries, targets, *combo)
        at = pa.array(rows, pa.int64())
        for i, x in zip(rows, work(queries.take(at), targets.take(at), *combo).to_pylist(), strict=True):
            out[i] = x
    return pa.array(out, kind)


def seq_distance(query, target, mode, k):
    return _by_settings(query, target, [mode, k], lambda q, t, m, b: batch_distances(q, t, AlignConfig(mode=m, k=b)), pa.int32())


def seq_align(query, target, mode, task, k):
    def work(q, t, m, what, b):
        return pa.array([None if r is None else as_struct(r) for r in batch_align(q.to_pylist(), t.to_pylist(), AlignConfig(mode=m, task=what, k=b))], STRUCT)

    return _by_settings(query, target, [mode, task, k], work, STRUCT)


def seq_cigar(ops, kind):
    return pa.array([None if o is None or k is None else cigar(bytes(o), k) for o, k in zip(ops.to_pylist(), kind.to_pylist(), strict=True)], pa.string())


_ROWS = pa.struct([(x, pa.string()) for x in ("query_aligned", "matched_aligned", "target_aligned")])


def seq_nice(query, target, mode):
    def work(q, t, m):
        q, t = q.to_pylist(), t.to_pylist()
        rows = batch_align(q, t, AlignConfig(mode=m, task="path"))
        return pa.array([dict(zip(_ROWS.names, nice(list(zip(r.starts, r.ends, strict=True)), cigar(r.path), a, b), strict=True)) if r is not None and r.path else None for r, a, b in zip(rows, q, t, strict=True)], _ROWS)

    return _by_settings(query, target, [mode], work, _ROWS)


def locations(df: DataFrame, query: str, target: str, **kw) -> DataFrame:
    """df with one row per location: location_idx, start, end (start null where unknown)."""
    kw.setdefault("task", "locations")
    r_col, l_col = fresh([df], "__r", "__l")
    r = df.withColumn(r_col, align(query, target, **kw))
    starts = F.col(r_col)["start_locations"]
    ends = F.transform(F.col(r_col)["end_locations"], lambda e, i: F.struct(F.when(starts.isNotNull(), F.get(starts, i)).alias("start"), e.alias("end")))
    own = [F.col(f"`{c}`") for c in df.columns]
    return r.select(*own, F.posexplode(ends).alias("location_idx", l_col)).select(*own, "location_idx", F.col(l_col)["start"].alias("start"), F.col(l_col)["end"].alias("end"))
