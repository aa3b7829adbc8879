"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import components, in_arrow, materialise, slices

#: Passes, hashes concatenated in each, rows of a block, guaranteed neighbour window.
PASSES, HASHES, BLOCK, WINDOW = 12, 64, 1024, 128

#: Rows of a pass that one task goes over, about.
STRETCH = 200_000


def planes(dim: int, n_pass: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, n_pass, dim]).standard_normal((dim, hashes))


def _flat(column: pa.Array, width: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of a list column one after another, lengths, which rows can link): rows
    that are null, empty, zero, or hold null or non-finite numbers can't."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    flat = (values.to_numpy(zero_copy_only=False) if not values.null_count else values.fill_null(float("nan")).to_numpy(zero_copy_only=False)).astype(width) + width(0)
    ok = size > 0
    if len(flat):
        full = np.flatnonzero(ok)
        first = (np.cumsum(size) - size)[full]
        ok[full] = np.logical_and.reduceat(np.isfinite(flat), first) & np.logical_or.reduceat(flat != 0, first)
    return flat, size, ok


def _classes(width: type, passes: int, hashes: int, seed: int):
    """Per row: a digest of its vector, its bytes (little-endian, of the width they came
    in), and its sort key for each pass; nulls where it can't link."""

    def run(batches):
        made: dict[int, np.ndarray] = {}
        for batch in slices(batches, 1024):
            flat, size, ok = _flat(batch.column(1), width)
            at = np.cumsum(size) - size
            n = batch.num_rows
            digests, vecs = [None] * n, [None] * n
            keys = np.zeros((n, passes, -(-hashes // 8)), np.uint8)
            for dim in np.unique(size[ok]).tolist():
                own = np.flatnonzero(ok & (size == dim))
                x = flat[at[own][:, None] + np.arange(dim)]
                if dim not in made:
                    made[dim] = np.concatenate([planes(dim, p, hashes, seed) for p in range(passes)], 1)
                wide = x.astype(np.float64)
                wide /= np.abs(wide).max(1, keepdims=True)
                bits = (wide @ made[dim] > 0).reshape(len(own), passes, hashes)
                keys[own] = np.packbits(bits, axis=2)
                for i, v in zip(own.tolist(), x, strict=True):
                    vecs[i] = v.tobytes()
                    digests[i] = hashlib.sha1(vecs[i]).digest()
            listed = [[k.tobytes() for k in keys[i]] if ok[i] else None for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(np.where(ok, size, 0), pa.int32()), pa.array(vecs, pa.binary()), pa.array(listed, pa.list_(pa.binary()))],
                names=["id", "label", "digest", "dim", "vec", "keys"],
            )

    return run


#: More than what single precision may be off at a cosine, up to some ten thousand dimensions.
ROUGH = 1e-3

LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64()), ("far", pa.int64())])


def _unit(column: pa.ChunkedArray, dim: int, width: type) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), width).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, rough: np.ndarray, a: slice, b: int, c: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row in a and a later one in b to c, at a cosine of `least` or more."""
    p, q = np.nonzero(rough[a] @ rough[b:c].T >= least - ROUGH)
    p, q = p + a.start, q + b
    p, q = p[q > p], q[q > p]
    close = np.einsum("ij,ij->i", x[p], x[q]) >= least  # in double precision
    return p[close], q[close]


#: What a task finds in its stretch of a pass: links (a, b, the first row's block, how far
#: apart); each row's place (pid, pos, kind, c); and the vectors at its two ends.
SWEPT = "what string, pid bigint, pos bigint, kind bigint, c bigint, b bigint, far bigint, dim int, vec binary"
_SWEPT = pa.schema([("what", pa.string()), *((k, pa.int64()) for k in ("pid", "pos", "kind", "c", "b", "far")), ("dim", pa.int32()), ("vec", pa.binary())])


def _sweep(least: float, width: type, block: int, window: int):
    """A pass over rows in order: each block with itself and the `window` rows behind it."""

    def rows(what, n, **cols):
        full = {"what": [what] * n, **cols}
        return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(n, f.type) for f in _SWEPT], schema=_SWEPT)

    def run(batches):
        context = TaskContext.get()
        pid = context.partitionId() if context else 0
        held: list[pa.RecordBatch] = []  # rows from the block at `start` on
        start, size, ends = 0, 0, None

        def work(t: pa.Table, n: int):
            """Links whose first row is among the first n (whole blocks, or all)."""
            kind, c, dim = t["kind"].to_numpy(), t["c"].to_numpy(), t["dim"].to_numpy()
            cut = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            found = []
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(kind)], strict=True):
                if i >= n:
                    break
                x = _unit(t["vec"].slice(i, j - i), int(dim[i]), width)
                rough = x.astype(np.float32)
                for at in range(i - (i % block), min(j, n), block):
                    last = min(j, at + block + window) - i
                    for one in range(max(at, i), min(j, at + block, n), 256):
                        p, q = _near(x, rough, slice(one - i, min(one + 256, at + block, j, n) - i), one - i, last, least)
                        found.append((p + i, q + i))
            p, q = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            yield rows("link", len(p), pid=np.full(len(p), pid), pos=p + start, c=c[p], b=c[q], far=q - p)
            yield rows("place", n, pid=np.full(n, pid), pos=np.arange(start, start + n), kind=kind[:n], c=c[:n])

        def end(what, t, first):
            n = t.num_rows
            return rows(what, n, pid=np.full(n, pid), pos=np.arange(first, first + n), kind=t["kind"].to_numpy(), c=t["c"].to_numpy(), dim=t["dim"].to_numpy(), vec=t["vec"].combine_chunks() if n else pa.array([], pa.binary()))

        lot = 8 * block
        for batch in slices(batches, block):
            held.append(batch)
            size += batch.num_rows
            if size >= lot + block + window:
                t = pa.Table.from_batches(held)
                if start == 0:
                    yield end("head", t.slice(0, window), 0)
                yield from work(t, lot)
                held, start, size = t.slice(lot).combine_chunks().to_batches(), start + lot, size - lot
        if size:
            t = pa.Table.from_batches(held)
            if start == 0:
                yield end("head", t.slice(0, window), 0)
            yield from work(t, size)
            yield end("tail", t.slice(max(0, size - window)), start + max(0, size - window))

    return run


def _compare(least: float, width: type):
    """Links within one cell between rows of side 0 and those of side 1, which stand behind them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("rank", "ascending")])
        kind, side, rank, c, dim = (t[k].to_numpy() for k in ("kind", "side", "rank", "c", "dim"))
        cell = t["cell"][0].as_py()
        cut = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        found = []
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(kind)], strict=True):
            n = int((side[i:j] == 0).sum())
            if not 0 < n < j - i:
                continue
            x = _unit(t["vec"].slice(i, j - i), int(dim[i]), width)
            rough = x.astype(np.float32)
            for at in range(0, n, 256):
                p, q = _near(x, rough, slice(at, min(at + 256, n)), n, j - i, least)
                found.append((p + i, q + i))
        if not found:
            return LINK.empty_table()
        p, q = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.Table.from_arrays([pa.array(c[p]), pa.array(c[q]), pa.array(np.full(len(p), cell)), pa.array(rank[q] - rank[p])], schema=LINK)

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, passes: int = PASSES, hashes: int = HASHES, block: int = BLOCK, window: int = WINDOW, seed: int = 10) -> DataFrame:
    """One row per row of df: id_col, n_links, component_id, kept.

    Only rows with equal, non-null labels link, at a cosine (double precision) of
    `threshold` or more. In each pass, the distinct vectors stand in the order of
    their concatenated sign hashes; each is compared with at least `window`
    neighbours on either side (all of its block of `block`), in the task that sorts
    them, so that a pass moves each vector once; the ends of neighbouring tasks meet
    after that. Where a link spans
    the window or more, the run may be longer than it: such blocks are compared
    with ever further blocks until none brings a link, so dense groups lose none.
    Verified pairs of all passes are united. Candidates are approximate (a pair
    apart in every pass is missed), links are exact.

    Equal vectors of a label are one class; they link with each other. Vectors
    that are null, empty, zero or hold null or non-finite numbers, and rows with a
    null label, link with nothing: n_links 0, component_id their own id, kept.
    Vectors of different length don't link. n_links counts other rows; repeated
    ids are separate rows. component_id is the smallest id of the component (null
    if it has none) and kept says id = component_id (null-safe). An empty table gives
    no rows; other columns are not looked at. Vectors of any length: a task holds the
    vectors of one block and its neighbours.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    # what is shuffled has the width of the input; cosines are computed in double precision
    width = np.float32 if df.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>" if width is np.float32 else "array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = in_arrow(rows, _classes(width, passes, hashes, seed), "id string, label string, digest binary, dim int, vec binary, keys array<binary>")
    rows = materialise(rows.select(F.col("id").cast(kind).alias("id"), "label", "digest", "dim", "vec", "keys"), "vectors")
    linked = rows.where("label is not null and digest is not null")
    base = linked.groupBy("label", "dim", "digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"), F.first("keys").alias("keys"))
    base = materialise(base.withColumn("c", F.monotonically_increasing_id()), "classes")

    # each pass in order, its vectors with it: rows are compared where they are sorted
    keyed = base.select("c", "label", "dim", "vec", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "label", "dim", "key", "c"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() * passes // STRETCH))
    keyed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    keyed = keyed.select(F.xxhash64("pass", "label", "dim").alias("kind"), "c", "dim", "vec")
    swept = materialise(in_arrow(keyed, _sweep(threshold, width, block, window), SWEPT), "swept")
    places = swept.where("what = 'place'")
    counts = places.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).orderBy("pid").collect()  # a row a partition
    # partitions one after another; blocks don't go over their ends
    table, total, blocks_ = [], 0, 0
    for i, r in enumerate(counts):
        table.append((r["pid"], i, total, blocks_))
        total, blocks_ = total + r["n"], blocks_ + -(-r["n"] // block)
    offsets = spark.createDataFrame(table or [(0, 0, 0, 0)], "pid bigint, nth bigint, off bigint, first bigint")
    at = lambda df: df.join(F.broadcast(offsets), "pid").withColumn("rank", F.col("off") + F.col("pos")).withColumn("block", (F.col("first") + F.floor(F.col("pos") / block)).cast("bigint"))
    ranked = at(places).select("rank", "kind", "block", "c")
    found = at(swept.where("what = 'link'")).select(F.col("c").alias("a"), "b", F.col("block").alias("cell"), "far")

    def compared(dealt: DataFrame) -> DataFrame:
        return materialise(dealt.groupBy("cell").applyInArrow(_compare(threshold, width), "a bigint, b bigint, cell bigint, far bigint"), "links")

    # the ends of neighbouring partitions; a cell is the last block of the former
    ends = at(swept.where("what IN ('head', 'tail')")).withColumn("side", F.when(F.col("what") == "tail", 0).otherwise(1))
    last_block = F.max(F.when(F.col("side") == 0, F.col("block"))).over(Window.partitionBy("gap"))
    ends = ends.withColumn("gap", F.col("nth") - F.col("side")).withColumn("cell", last_block).where("cell IS NOT NULL")
    links = [found, compared(ends.select("cell", "side", "kind", "rank", "c", "dim", "vec"))]
    # blocks whose links reach the window: on to the blocks behind, twice as far each time
    open_ = links[0].union(links[1]).where(F.col("far") >= window).select(F.col("cell").alias("left")).distinct()
    reach, step = 0, 1
    while not open_.isEmpty():
        pairs = open_.select("left", F.explode(F.sequence(F.col("left") + reach + 1, F.col("left") + reach + step)).alias("right")).where(F.col("right") < blocks_)
        pairs = materialise(pairs.withColumn("cell", F.col("left") * (1 << 31) + F.col("right")), "pairs")
        sides = pairs.select(F.col("left").alias("block"), "cell", F.lit(0).alias("side")).union(pairs.select(F.col("right").alias("block"), "cell", F.lit(1).alias("side")))
        dealt = ranked.join(sides, "block").join(base.select("c", "dim", "vec"), "c").select("cell", "side", "kind", "rank", "c", "dim", "vec")
        links.append(compared(dealt))
        reach, step = reach + step, 2 * step
        open_ = links[-1].select(F.shiftright("cell", 31).alias("left")).distinct()

    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    every = materialise(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    count = base.select("c", "n")
    ends = every.union(every.select("b", "a")).toDF("c", "o")
    degree = ends.join(count.select(F.col("c").alias("o"), "n"), "o").groupBy("c").agg(F.sum("n").alias("others"))
    named = base.select("label", "digest", "c", "least", "n").join(components(every), F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c"))
    named = materialise(named.join(degree, "c", "left").select("label", "digest", "root", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    info = named.join(smallest, "root").select("label", "digest", "n_links", "component_id")
    out = rows.select("id", "label", "digest").join(info, ["label", "digest"], "left")
    can = F.col("label").isNotNull() & F.col("digest").isNotNull()
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(can, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
