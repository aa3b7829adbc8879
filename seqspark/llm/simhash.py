"""SimHash fingerprints and their exact linking through a Gray-order hierarchical index."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import components, fresh, in_arrow, local_forest, materialise, release, slices

#: Rows that one cell of the index may hold; larger groups are dealt out as pairs of parts.
CELL_ROWS = 20_000

#: Child pairs looked at together: bounds a task's memory.
PAIRS_AT_ONCE = 250_000

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, th, fp): one row per row of df, th the text's 64-bit hash, fp a bigint with the fingerprint's bits."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], names=["id", "th", "fp"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return in_arrow(rows, run, "id string, th bigint, fp bigint").select(F.col("id").cast(kind).alias("id"), "th", "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit code in Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """A hierarchical index over groups of fingerprints.

    Within its group, a fingerprint stands in Gray order, in which neighbours
    share long prefixes. Each level adds `step` bits: fingerprints with the same
    prefix form one node there, so a shared bit pattern is kept and compared
    once. The self-join goes down pairs of nodes, adds up the differing bits and
    drops a pair with everything below it once the sum passes the bound.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, step: int = 8):
        order = np.lexsort((gray_rank(fp), group))
        self.fp, group = fp[order].astype(np.uint64), group[order]
        n = len(self.fp)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        starts = [np.flatnonzero(new)]
        for bits in range(step, 64 + step, step):
            p = self.fp >> np.uint64(max(0, 64 - bits))
            new[1:] |= p[1:] != p[:-1]
            starts.append(np.flatnonzero(new))
        self.starts, self.step = starts, step
        # first child of each node, and one past the last
        self.child = [np.append(np.searchsorted(low, high), len(low)) for high, low in zip(starts, starts[1:], strict=False)]

    def pairs(self, bound: int):
        """(a, b) arrays of fingerprints at `bound` differing bits or fewer, a and b different."""
        g = np.arange(len(self.starts[0]))
        sizes = np.diff(np.append(self.starts[0], len(self.fp)))
        g = g[sizes > 1]
        stack = [(0, g, g, np.zeros(len(g), np.int8))]
        depth = len(self.child)
        while stack:
            level, a, b, acc = stack.pop()
            if level == depth:
                differ = a != b
                if differ.any():
                    at = self.starts[depth]
                    yield self.fp[at[a[differ]]], self.fp[at[b[differ]]]
                continue
            child = self.child[level]
            na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
            total = np.cumsum(na * nb)
            if len(a) and total[-1] > PAIRS_AT_ONCE and len(a) > 1:
                cut = max(1, int(np.searchsorted(total, total[-1] // 2)))
                stack += [(level, a[cut:], b[cut:], acc[cut:]), (level, a[:cut], b[:cut], acc[:cut])]
                continue
            if not len(a):
                continue
            if total[-1] > 4 * PAIRS_AT_ONCE:  # one pair of very broad nodes: by slices of its first node
                rows = max(1, PAIRS_AT_ONCE // int(nb[0]))
                parts = [(np.arange(k, min(k + rows, child[a[0] + 1])), int(nb[0])) for k in range(child[a[0]], child[a[0] + 1], rows)]
            else:
                parts = [(None, 0)]
            for left, width in parts:
                if left is None:
                    of = np.repeat(np.arange(len(a)), na * nb)
                    k = np.arange(int(total[-1])) - (total - na * nb)[of]
                    x, y = child[a[of]] + k // nb[of], child[b[of]] + k % nb[of]
                    self_pair, base = a[of] == b[of], acc[of]
                else:
                    x = np.repeat(left, width)
                    y = np.tile(np.arange(child[b[0]], child[b[0] + 1]), len(left))
                    self_pair, base = np.full(len(x), a[0] == b[0]), np.repeat(acc[:1], len(x))
                once = ~self_pair | (x <= y)
                x, y, base = x[once], y[once], base[once]
                low = self.starts[level + 1]
                shift = np.uint64(max(0, 64 - self.step * (level + 1)))
                mask = np.uint64((1 << self.step) - 1)
                d = np.bitwise_count(((self.fp[low[x]] ^ self.fp[low[y]]) >> shift) & mask).astype(np.int8) + base
                near = d <= bound
                if near.any():
                    stack.append((level + 1, x[near], y[near], d[near]))


def masks(bits: int) -> list[int]:
    """Bit masks of which one at least is untouched by any `bits` differences:
    64 bits in bits + 2 pieces, two of them kept."""
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    piece = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [piece[i] | piece[j] for i, j in combinations(range(n), 2)]


def _links(bits: int):
    def run(batches):
        held = []

        def flush(parts):
            m, key, cell, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.ones(len(fp), bool)
            new[1:] = (m[1:] != m[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            index = GrayIndex(np.cumsum(new), fp.view(np.uint64))
            for a, b in index.pairs(bits):
                a, b = local_forest(a.view(np.int64), b.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE)

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m, key, cell, fp = (batch.column(i).to_numpy() for i in range(4))
            new = np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            # rows come sorted: all groups but the last of what is held are whole
            cut = int(new[-1]) + 1 if len(new) else 0
            starts_new = bool(held) and (held[-1][0][-1], held[-1][1][-1], held[-1][2][-1]) != (m[0], key[0], cell[0])
            if held and rows > 200_000 and (cut or starts_new):
                if cut:
                    held.append((m[:cut], key[:cut], cell[:cut], fp[:cut]))
                yield from flush(held)
                held, rows = [], 0
                m, key, cell, fp = m[cut:], key[cut:], cell[cut:], fp[cut:]
            held.append((m, key, cell, fp))
            rows += len(m)
        if held:
            yield from flush(held)
        release()

    return run


def hamming_edges(fps: DataFrame, bits: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): edges that connect just the fingerprints connected by links of
    `bits` differing bits or fewer. fps: one bigint column without repeats.

    Two fingerprints within the bound agree on one of the masks; they meet in
    the group of that mask's value. A group over cell_rows is dealt into parts,
    and each pair of parts is a cell of its own, so no task holds a large group
    and no pair is lost. Cells are joined through a GrayIndex.
    """
    fp = fps.columns[0]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")).alias("key")) for i, m in enumerate(masks(bits)))))
    rows = fps.select(F.col(fp).alias("fp"), keys.alias("k")).select("k.m", "k.key", "fp")
    hot = rows.groupBy("m", "key").count().where(F.col("count") > cell_rows)
    hot = materialise(hot.select("m", "key", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        cells = rows.select("m", "key", F.lit(0).alias("cell"), "fp")
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, part) * F.col("parts") + F.greatest(j, part))
        # a pair of equal parts is covered by every pair that has the part
        others = F.filter(others, lambda c: c != part * F.col("parts") + part)
        cells = rows.join(hot, ["m", "key"], "left").select("m", "key", F.explode(F.when(F.col("parts") > 1, others).otherwise(F.array(F.lit(0)))).alias("cell"), "fp")
    dealt = cells.repartition("m", "key", "cell").sortWithinPartitions("m", "key", "cell")
    return in_arrow(dealt, _links(bits), "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of df: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among all rows reachable by links of `bits`
    differing bits or fewer, the row itself included. Null or wordless texts have
    fingerprint zero and link like any other. A null id never is a component_id
    unless its whole component has none. Repeated rows give repeated results;
    other columns of df are not looked at; an empty df gives no rows. Texts of any
    length: one is held at a time, its hashes in blocks.
    """
    rows = _labelled(df, id_col, text_col, shingle, bits, cell_rows)
    return rows.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, bits: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, th, fp, root, component_id) of each row; root tells components apart even where ids repeat."""
    fps = materialise(fingerprints(df, id_col, text_col, shingle), "fp")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(hamming_edges(least.select("fp"), bits, cell_rows))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    # only components of several fingerprints, and apart from the join, so that Spark may split a large one
    comp = named.groupBy("root").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "smallest")
    comp = materialise(comp, "components")
    labels = named.join(comp, "root", "left").select("fp", "root", F.coalesce("smallest", "least").alias("component_id"))
    return fps.join(labels, "fp").select("id", "th", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """df without near copies: of each component one row stays, that with the
    smallest id (on a tie, the text of smallest hash; of equal rows, one). Rows
    with a null id can't be named as copies and all stay. Null and wordless texts
    are copies of each other. An empty df stays empty; whole texts of any length
    are read, one at a time; further columns, whatever their names, stay as they are."""
    rows = materialise(_labelled(df, id_col, text_col, **kw), "labelled").where("id is not null")
    first = rows.where("id = component_id")  # one a component, but where ids repeat
    keep = first.groupBy("root").agg(F.min("th").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "keep")
    own, hashed = fresh(df, "__id", "__th")
    named = [F.col("id").alias(own), F.col("th").alias(hashed)]
    # the dropped rows are fewer than the kept ones: only their keys go to the texts
    drop = rows.where("id <> component_id").select(*named).union(first.join(keep, "root").where("th <> keep").select(*named)).distinct()
    drop = materialise(drop, "copies")
    twice = rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*named)
    twice = materialise(twice, "twice")
    same = (F.col(id_col) == F.col(own)) & (F.xxhash64(text_col) == F.col(hashed))
    kept = df.join(drop, same, "left_anti")
    if twice.isEmpty():
        return kept
    return kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").dropDuplicates([id_col]))
