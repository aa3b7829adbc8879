"""Alignment as Spark columns.

Sequences are strings (symbols are code points), binaries (bytes) or arrays (any
values). A null on either side gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark import format as fmt
from seqspark import kernel, lanes
from seqspark.config import AlignConfig

RESULT = "status int, edit_distance int, end_locations array<int>, start_locations array<int>, num_locations int, alignment binary, alignment_length int, alphabet_length int, cigar string"

STRUCT = pa.struct(
    [
        ("status", pa.int32()),
        ("edit_distance", pa.int32()),
        ("end_locations", pa.list_(pa.int32())),
        ("start_locations", pa.list_(pa.int32())),
        ("num_locations", pa.int32()),
        ("alignment", pa.binary()),
        ("alignment_length", pa.int32()),
        ("alphabet_length", pa.int32()),
        ("cigar", pa.string()),
    ]
)

#: Queries this long or longer are cheaper one at a time: whole columns as one integer.
LANE_SYMBOLS = 2048

#: So are targets this long, where no more than so many stand side by side.
FEW_SYMBOLS, FEW_PAIRS = 4096, 6


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def batch_align(queries: list, targets: list, config: AlignConfig) -> list[kernel.Alignment | None]:
    """Alignments of pairs; a numpy lane for each of the shorter ones."""
    equal = kernel.partners(config.equalities)
    out: list = [None] * len(queries)
    fast, far, pieces = [], config.mode == "NW" and config.k >= 0, config.mode == "HW" and not equal
    for i, (q, t) in enumerate(zip(queries, targets, strict=True)):
        if q is not None and t is not None and len(q) and len(t) and len(q) < LANE_SYMBOLS and not (far and abs(len(q) - len(t)) > config.k) and not (pieces and kernel.by_pieces(q, t, config.k)):
            fast.append(i)
    known = dict(zip(fast, lanes.search([queries[i] for i in fast], [targets[i] for i in fast], config.mode, equal), strict=True)) if len(fast) > 1 else {}
    starts = _starts(queries, targets, known, config, equal) if config.task != "distance" else {}
    paths = _paths(queries, targets, known, starts, config, equal) if config.task == "path" else {}
    profiles: dict = {}
    for i, (q, t) in enumerate(zip(queries, targets, strict=True)):
        if q is None or t is None:
            continue
        profile = None
        if i not in known and len(q) and len(t):
            key = q if isinstance(q, (str, bytes)) else tuple(q)
            profile = profiles.get(key)
            if profile is None:
                if len(profiles) > 256:
                    profiles.clear()
                profile = profiles[key] = kernel.Profile(q, equal)
        out[i] = kernel.align(q, t, config, profile, known.get(i), starts.get(i), paths.get(i))
    return out


#: Symbols that are searched for starts at a time.
START_SYMBOLS = 4_000_000


def _starts(queries: list, targets: list, known: dict, config: AlignConfig, equal: dict) -> dict[int, list[int]]:
    """The smallest start of each end: a prefix search of the reversed query from each end on
    backwards, a lane a location; the last column that reaches the distance is the start."""
    if config.mode != "HW":
        return {i: [0] * len(ends) for i, (_, ends) in known.items()}
    out: dict[int, list[int]] = {}
    jobs: list[tuple] = []  # pair, end, distance
    lots: tuple[list, list] = ([], [])
    size = 0

    def flush():
        for (i, end, d), (got, at) in zip(jobs, lanes.search(*lots, "SHW", equal), strict=True):
            out[i].append(end - at[-1] if got == d else end + 1)
        jobs.clear()
        for x in lots:
            x.clear()

    for i, (d, ends) in known.items():
        out[i] = []
        if config.k >= 0 and d > config.k:
            continue
        back = queries[i][::-1]
        for end in ends:
            part = targets[i][max(0, end + 1 - len(back) - d) : end + 1][::-1]
            jobs.append((i, end, d))
            lots[0].append(back)
            lots[1].append(part)
            size += len(back) + len(part)
            if size > START_SYMBOLS:
                flush()
                size = 0
    if jobs:
        flush()
    return out


def _paths(queries: list, targets: list, known: dict, starts: dict, config: AlignConfig, equal: dict) -> dict[int, bytes]:
    """Paths of the first locations, for pairs that needn't be divided."""
    own, parts = [], []
    for i, (d, ends) in known.items():
        n = len(queries[i])
        if 0 <= config.k < d or config.mode != "NW" and config.before_start and kernel.before_start(d, n):
            continue
        part = targets[i][starts[i][0] : ends[0] + 1]
        if len(part) and kernel.stored(n, len(part), config.path_bytes):
            own.append(i)
            parts.append(part)
    return dict(zip(own, lanes.paths([queries[i] for i in own], parts, equal), strict=True)) if own else {}


def _values(array: pa.Array) -> list:
    return array.to_pylist()


def _pairs(config: AlignConfig, build, kind: pa.DataType):
    """An Arrow iterator function over (queries, targets)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, targets in batches:
            got = []
            for at in range(0, len(queries), 2048):
                got += [None if r is None else build(r) for r in batch_align(_values(queries.slice(at, 2048)), _values(targets.slice(at, 2048)), config)]
            yield pa.array(got, kind)

    return run


def _packed(array: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """(symbols, offsets) of a string or binary array; nulls are empty. None for other types."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        wide = np.int64
    elif pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        wide = np.int32
    else:
        return None
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    is_text = pa.types.is_string(array.type) or pa.types.is_large_string(array.type)
    if is_text and raw.max(initial=0) > 127:  # code points, not bytes
        texts = [x or "" for x in array.to_pylist()]
        return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    return raw, at - at[0]


def _packed_lists(queries: pa.Array, targets: pa.Array):
    """Two list arrays of one type as (symbols, offsets) each, their values numbered
    together, and the number of each value. None if the values can't be numbered."""
    parts, sizes = [], []
    for a in (queries, targets):
        if not (pa.types.is_list(a.type) or pa.types.is_large_list(a.type)) or pa.types.is_nested(a.type.value_type):
            return None
        parts.append(a.flatten())
        sizes.append(np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64))
    if parts[0].type != parts[1].type:
        return None
    coded = pa.concat_arrays(parts).dictionary_encode(null_encoding="encode")
    codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(parts[0])
    of = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
    if len(of) < len(coded.dictionary):  # values that are equal to Python only
        return None
    return (codes[:n], sizes[0]), (codes[n:], sizes[1]), of


def batch_distances(queries: pa.Array, targets: pa.Array, config: AlignConfig) -> pa.Array:
    """Distances of pairs in two arrays of one type: strings, binaries or lists."""
    near = kernel.partners(config.equalities)
    number = None
    q, t = (None, None) if queries.type != targets.type or config.max_alphabet is not None else (_packed(queries), _packed(targets))
    if q is None and queries.type == targets.type and config.max_alphabet is None and (lists := _packed_lists(queries, targets)):
        q, t, of = lists
        number = of.get
    elif pa.types.is_string(queries.type) or pa.types.is_large_string(queries.type):
        number = ord
    none = np.asarray(queries.is_null()) | np.asarray(targets.is_null())
    if q is None or t is None:
        return pa.array([None if r is None else r.edit_distance for r in batch_align(_values(queries), _values(targets), config)], pa.int32())
    match = None
    if near:
        coded = {(number(a) if number else a): [number(b) if number else b for b in bs] for a, bs in near.items()}
        match = {a: [b for b in bs if b is not None] for a, bs in coded.items() if a is not None}
    size, other = np.diff(q[1]), np.diff(t[1])
    few = (other >= FEW_SYMBOLS) & (size > 0)
    alone = (size >= LANE_SYMBOLS) | (few if few.sum() <= FEW_PAIRS else False)
    if config.mode == "HW" and config.k >= 0 and not near and not pa.types.is_nested(queries.type):  # by their pieces
        alone |= (size >= kernel.PIECE * (config.k + 1)) & (other >= kernel.PIECE_TARGET)
    far = np.flatnonzero(alone & ~none)
    d = np.empty(len(size), np.int32)
    if len(far):  # one at a time, whole columns as one integer
        slow = batch_align(_values(queries.take(pa.array(far))), _values(targets.take(pa.array(far))), config)
        d[far] = [r.edit_distance for r in slow]
        short = np.flatnonzero(~alone | none)
        sub = lambda p, n: (p[0][np.repeat(np.isin(np.arange(len(n)), short), n)], np.concatenate([[0], np.cumsum(n[short])]))
        q, t = sub(q, size), sub(t, other)
    else:
        short = np.arange(len(size))
    own = lanes.distances(*q, *t, config.mode, match, config.k)
    if config.k >= 0:
        both = (size[short] > 0) & (other[short] > 0)
        own = np.where(both & (own > config.k), -1, own)
    d[short] = own
    return pa.array(d, pa.int32(), mask=none)


def _distances(config: AlignConfig):
    """An Arrow iterator function that gives the distances alone."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, targets in batches:
            yield batch_distances(queries, targets, config)

    return run


def as_struct(r: kernel.Alignment, cigar_format: str = "extended") -> dict:
    return {
        "status": r.status,
        "edit_distance": r.edit_distance,
        "end_locations": r.ends,
        "start_locations": r.starts,
        "num_locations": len(r.ends or []),
        "alignment": r.path,
        "alignment_length": len(r.path or b""),
        "alphabet_length": r.alphabet_length,
        "cigar": fmt.cigar(r.path, cigar_format),
    }


def _udf(f, ret: str):
    # the annotations tell Spark that this is an iterator of tuples
    f.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(f, ret)


def align(query, target, mode: str = "NW", task: str = "distance", k: int = -1, equalities=(), cigar_format: str = "extended", **kw) -> Column:
    """struct(status, edit_distance, end_locations, start_locations, num_locations,
    alignment, alignment_length, alphabet_length, cigar) of query against target."""
    config = AlignConfig(k=k, mode=mode, task=task, equalities=tuple(equalities), **kw)
    if cigar_format not in fmt.LETTERS:
        raise ValueError(f"unknown CIGAR format {cigar_format!r}")

    return _udf(_pairs(config, lambda r: as_struct(r, cigar_format), STRUCT), RESULT)(column(query), column(target))


def edit_distance(query, target, mode: str = "NW", k: int = -1, equalities=(), native: bool | None = None) -> Column:
    """The distance, -1 where it is over k (k < 0: no bound).

    Global distances of strings under plain equality are computed where that is cheaper, row
    by row: in the JVM (levenshtein), or, for pairs with a text of LONG_TEXT characters or more, in the
    Arrow kernel, which keeps to a band; the kernel sees nulls for the others. Below a bound of LONG_TEXT
    levenshtein keeps to a band itself, so all stay in the JVM. native=True keeps all
    in the JVM, native=False sends all to the kernel, which also takes other modes, equalities,
    binaries and arrays. with_distance() splits a table into two plans instead."""
    config = AlignConfig(k=k, mode=mode, equalities=tuple(equalities))
    q, t = column(query), column(target)
    plain = mode == "NW" and not equalities
    if native and not plain:
        raise ValueError("only global distances under plain equality have a native form")
    kernel_of = _udf(_distances(config), "int")
    if native is False or not plain:
        return kernel_of(q, t)
    if config.k < 0:
        short = F.levenshtein(q, t)
    else:
        # an empty side is exempt from the bound; lengths too far apart need no table
        gap = F.abs(F.length(q) - F.length(t))
        short = F.when((F.length(q) == 0) | (F.length(t) == 0), F.greatest(F.length(q), F.length(t))).when(gap > config.k, -1).otherwise(F.levenshtein(q, t, config.k))
    if native or 0 <= config.k < LONG_TEXT:
        return short
    long = F.greatest(F.length(q), F.length(t)) >= LONG_TEXT
    return F.when(long, kernel_of(F.when(long, q).cast("string"), F.when(long, t).cast("string"))).otherwise(short)


#: Texts this long or longer are cheaper in the Arrow kernel than in levenshtein.
LONG_TEXT = 128


def with_distance(df: DataFrame, query: str, target: str, out: str = "distance", k: int = -1) -> DataFrame:
    """df with the global distance of two string columns as `out`, in two plans: pairs
    with a text of LONG_TEXT characters or more go to the Arrow kernel, which keeps to a
    band, all others and nulls stay in the JVM. Rows in any order."""
    long = F.coalesce(F.greatest(F.length(query), F.length(target)) >= LONG_TEXT, F.lit(False))
    near = df.where(~long).withColumn(out, edit_distance(query, target, k=k, native=True))
    far = df.where(long).withColumn(out, edit_distance(query, target, k=k, native=False))
    return near.union(far)


def alphabet_length(query, target) -> Column:
    """Distinct symbols of the two strings together."""
    q, t = column(query), column(target)
    return F.size(F.array_distinct(F.filter(F.concat(F.split(q, ""), F.split(t, "")), lambda c: c != "")))


def cigar(alignment, cigar_format: str = "extended") -> Column:
    """The CIGAR of a binary of operations, as a fold in the JVM; null for a foreign code."""
    if cigar_format not in fmt.LETTERS:
        raise ValueError(f"unknown CIGAR format {cigar_format!r}")
    ops = F.filter(F.split(F.hex(column(alignment)), "(?<=\\G..)"), lambda c: c != "")
    letters = fmt.LETTERS[cigar_format]
    named = F.transform(ops, lambda c: F.when(c == "00", letters[0]).when(c == "01", letters[1]).when(c == "02", letters[2]).when(c == "03", letters[3]).otherwise("?"))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("op"), F.lit(0).alias("n"))
    close = lambda a: F.when(a["n"] > 0, F.concat(a["out"], a["n"].cast("string"), a["op"])).otherwise(a["out"])
    fold = F.aggregate(
        named,
        start,
        lambda a, c: F.when(a["op"] == c, F.struct(a["out"].alias("out"), c.alias("op"), (a["n"] + 1).alias("n"))).otherwise(F.struct(close(a).alias("out"), c.alias("op"), F.lit(1).alias("n"))),
        close,
    )
    return F.when(F.array_contains(named, "?"), F.lit(None)).otherwise(fold)


def nice_alignment(query, target, result, gap: str = "-") -> Column:
    """struct(query_aligned, matched_aligned, target_aligned) of an align() result
    with a path; null where there is none. In the JVM, over the CIGAR's runs."""
    r = column(result)
    text = r["cigar"]
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)[=XID]"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(r"\d+([=XID])"), F.lit(1))
    first = F.coalesce(F.when(F.size(r["start_locations"]) > 0, F.element_at(r["start_locations"], 1)), F.lit(0))
    start = F.struct(F.lit("").alias("q"), F.lit("").alias("m"), F.lit("").alias("t"), F.lit(0).alias("i"), first.alias("j"))
    q, t = column(query), column(target)

    def add(a, run):
        n, op = run["n"].cast("int"), run["op"]
        dash = F.repeat(F.lit(gap), n)
        return F.struct(
            F.concat(a["q"], F.when(op == "D", dash).otherwise(F.substring(q, a["i"] + 1, n))).alias("q"),
            F.concat(a["m"], F.when(op == "=", F.repeat(F.lit("|"), n)).when(op == "X", F.repeat(F.lit("."), n)).otherwise(dash)).alias("m"),
            F.concat(a["t"], F.when(op == "I", dash).otherwise(F.substring(t, a["j"] + 1, n))).alias("t"),
            (a["i"] + F.when(op == "D", 0).otherwise(n)).alias("i"),
            (a["j"] + F.when(op == "I", 0).otherwise(n)).alias("j"),
        )

    rows = F.aggregate(F.zip_with(runs, ops, lambda n, op: F.struct(n.alias("n"), op.alias("op"))), start, add)
    made = F.struct(rows["q"].alias("query_aligned"), rows["m"].alias("matched_aligned"), rows["t"].alias("target_aligned"))
    return F.when(F.length(text) > 0, made)


def path_check(query, target, result, mode: str = "NW") -> Column:
    """struct(sound, cost, start, starts_by_insertion) of an align() result with a path, of strings
    under plain equality: whether its matches match, its mismatches don't and it takes the
    whole query up to the end; what it costs; where it begins in the target; and whether it begins by inserting a
    symbol although the target has one before it, which a mismatch could take instead.
    Null without a path. In the JVM, over the CIGAR's runs."""
    r = column(result)
    text = r["cigar"]
    q, t = column(query), column(target)
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)[=XID]"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(r"\d+([=XID])"), F.lit(1))
    pairs = F.zip_with(runs, ops, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))
    taken = lambda but: F.aggregate(pairs, F.lit(0), lambda a, x: a + F.when(x["op"] == but, 0).otherwise(x["n"]))
    end = F.element_at(r["end_locations"], 1)
    first = end + 1 - taken("I")
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("cost"), F.lit(0).alias("i"), first.alias("j"))

    def step(a, x):
        own, other = F.substring(q, a["i"] + 1, x["n"]), F.substring(t, a["j"] + 1, x["n"])
        differ = ~F.exists(F.sequence(F.lit(1), x["n"]), lambda p: F.substring(own, p, F.lit(1)) == F.substring(other, p, F.lit(1)))
        good = F.when(x["op"] == "=", own == other).when(x["op"] == "X", differ).otherwise(True)
        return F.struct(
            (a["ok"] & good).alias("ok"),
            (a["cost"] + F.when(x["op"] == "=", 0).otherwise(x["n"])).alias("cost"),
            (a["i"] + F.when(x["op"] == "D", 0).otherwise(x["n"])).alias("i"),
            (a["j"] + F.when(x["op"] == "I", 0).otherwise(x["n"])).alias("j"),
        )

    walked = F.aggregate(pairs, start, step)
    sound = walked["ok"] & (walked["i"] == F.length(q)) & (walked["j"] == end + 1) & (F.lit(mode != "NW") | (first == 0))
    made = F.struct(sound.alias("sound"), walked["cost"].alias("cost"), first.alias("start"), ((F.element_at(ops, 1) == "I") & (first > 0)).alias("starts_by_insertion"))
    return F.when(F.length(text) > 0, made)


def pretty_alignment(query, target, result, mode: str = "NW") -> Column:
    """A text of fifty-column blocks, from an align() result with a path."""

    def run(batches):
        for q, t, path, ends in batches:
            yield pa.array([None if p is None or not e else fmt.pretty(a, b, p, e[0], mode) for a, b, p, e in zip(*(x.to_pylist() for x in (q, t, path, ends)), strict=True)], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    r = column(result)
    return F.arrow_udf(run, "string")(column(query), column(target), r["alignment"], r["end_locations"])
