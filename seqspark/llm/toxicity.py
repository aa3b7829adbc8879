"""Toxicity: a linear classifier whose score may not depend on which identity group a text names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import in_arrow, slices

# Identity terms; those of one row can stand for each other.
IDENTITY = [
    "women men girls boys",
    "woman man girl boy",
    "female male transgender nonbinary",
    "muslim christian jewish hindu buddhist atheist catholic sikh",
    "muslims christians jews hindus buddhists atheists catholics sikhs",
    "black white asian latino hispanic african arab indigenous",
    "gay lesbian bisexual straight heterosexual homosexual queer trans",
    "immigrants refugees natives foreigners",
    "mexican chinese american russian german french indian turkish",
    "old young elderly teenage",
    "blind deaf disabled autistic",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos hindúes",
]

#: Bounds of the fit: labelled rows of each class, and features.
SAMPLE_ROWS, FEATURES = 10_000, 8_192

THRESHOLD = 0.7

#: Lengths of word beginnings that count as features.
STEMS = (4, 5, 6, 7, 8)

_EDGE = b"".join(bytes([i]) for i in range(33, 127) if not chr(i).isalnum())
_WORDS_HELD = 100_000


def swaps() -> dict[bytes, list[bytes]]:
    """Each identity term with the others of its rows."""
    out: dict[bytes, list[bytes]] = {}
    for row in IDENTITY:
        terms = [t.encode() for t in row.split()]
        for t in terms:
            out.setdefault(t, []).extend(x for x in terms if x != t)
    return out


def stripped(word: bytes) -> bytes:
    return word.strip(_EDGE)


def features(word: bytes, exact: frozenset | dict = frozenset()) -> list[bytes]:
    """The features of a lower-case word: itself (with a mark), and its beginnings
    unless it is an identity term. Words over 64 bytes count by their beginnings."""
    w = stripped(word)
    if not w:
        return []
    out = [b"=" + w] if len(w) <= 64 else []
    if w not in exact:
        s = w[:64].decode(errors="ignore")
        out += [b"^" + s[:k].encode() for k in STEMS if len(s) >= k]
    return out


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode().lower().split())


def sample(labels: DataFrame, train: Column, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, y) of at most `rows` labelled rows of each class, those of least hash of their id."""
    own = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    h = F.xxhash64(F.col("id").cast("string"), F.lit(8))
    take = lambda y: own.where(F.col("y") == y).orderBy(h, "id").limit(rows)
    return take(0).union(take(1))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, top: int = FEATURES, fairness: float = 10.0, l2: float = 1e-4, seed: int = 0) -> dict:
    """The classifier, from at most `rows` labelled rows of each class (documented bound;
    those of least hash of their id, so ties and the tables' order play no part). Without
    rows of both classes it rejects nothing.

    Executors count features by label and later reduce each row to the features
    kept; the driver gets at most 2 * rows lists of at most `top` numbers. The
    loss is class-weighted log loss + l2 + fairness * (score(x) - score(x'))^2,
    x' being the row with its identity terms swapped for others of their kind.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    picked = own.join(F.broadcast(sample(labels, train, id_col, label_col, rows)), "id").select("y", "t")
    swap = swaps()

    def count(batches):
        n: dict[bytes, list[int]] = {}
        size = [0, 0]
        for batch in slices(batches):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size[y] += 1
                seen = set()
                for w in words_of(t):
                    seen.update(features(w, swap))
                for f in seen:
                    n.setdefault(f, [0, 0])[y] += 1
            if len(n) > 400_000:
                yield counted(n)
                n = {}
        n[b""] = size
        yield counted(n)

    def counted(n):
        return pa.RecordBatch.from_pydict({"f": pa.array(list(n), pa.binary()), "neg": pa.array([v[0] for v in n.values()], pa.int64()), "pos": pa.array([v[1] for v in n.values()], pa.int64())})

    sums = in_arrow(picked, count, "f binary, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = {r["f"] == b"": r for r in sums.where(F.length("f") == 0).collect()}.get(True)
    empty = {"weights": {}, "bias": -2.0, "identity": list(swap)}
    if total is None or not total["pos"] or not total["neg"]:
        return empty
    npos, nneg = total["pos"], total["neg"]
    # log odds in standard deviations; beginnings and words with both signs
    odds = F.log((F.col("pos") + 0.5) / (npos + 1.0)) - F.log((F.col("neg") + 0.5) / (nneg + 1.0))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    kept = sums.where((F.length("f") > 0) & (F.col("pos") + F.col("neg") >= 4)).select("f", z.alias("z")).where(F.abs("z") >= 3).orderBy(F.abs("z").desc(), "f").limit(top)
    vocab = [bytes(r["f"]) for r in kept.collect()]
    vocab += [b"=" + t for t in swap if b"=" + t not in set(vocab)]
    index = {f: i for i, f in enumerate(vocab)}

    def reduce(batches):
        import zlib

        for batch in slices(batches):
            xs, cs = [], []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                x = {index[f] for w in words for f in features(w, swap) if f in index}
                terms = {s for w in words if (s := stripped(w)) in swap}
                c = None
                if terms:
                    c = {i for i in x if vocab[i][1:] not in terms or vocab[i][:1] != b"="}
                    for term in terms:
                        others = swap[term]
                        c.add(index[b"=" + others[zlib.crc32(term + b"|" + str(len(words)).encode()) % len(others)]])
                xs.append(sorted(x))
                cs.append(sorted(c) if c is not None else None)
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "x": pa.array(xs, pa.list_(pa.int32())), "c": pa.array(cs, pa.list_(pa.int32()))})

    data = in_arrow(picked, reduce, "y int, x array<int>, c array<int>").toArrow().combine_chunks()
    weights, bias = regress(data["y"].to_numpy(), _rows(data["x"]), _rows(data["c"]), len(vocab), fairness, l2)
    return {"weights": {f: float(w) for f, w in zip(vocab, weights, strict=True) if w}, "bias": float(bias), "identity": list(swap)}


def _rows(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """The rows of a column of integer lists, without a Python object a number."""
    out: list[np.ndarray | None] = []
    for part in column.chunks:
        flat, size = part.flatten().to_numpy(), part.value_lengths().fill_null(0).to_numpy()
        at = np.cumsum(size) - size
        out += [flat[i : i + n] if ok else None for i, n, ok in zip(at.tolist(), size.tolist(), part.is_valid().to_pylist(), strict=True)]
    return out


def _csr(rows: list[np.ndarray]):
    size = np.array([len(r) for r in rows], np.int64)
    return np.concatenate(rows).astype(np.int64) if size.sum() else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), size)


def regress(y, x, c, n_features: int, fairness: float, l2: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the counterfactual-regularised logistic loss. y: labels; x:
    the rows' features; c: those with identity terms swapped, or None. The rows'
    order is made the same whichever order they came in."""
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes(), b"" if c[i] is None else c[i].tobytes()))
    y, x, c = np.array([y[i] for i in order], float), [x[i] for i in order], [c[i] for i in order]
    col, row = _csr(x)
    pairs = [i for i, k in enumerate(c) if k is not None]
    col2, row2 = _csr([c[i] for i in pairs])
    pairs = np.array(pairs, np.int64)
    n = len(y)
    share = np.where(y == 1, n / (2 * max(1, y.sum())), n / (2 * max(1, n - y.sum()))) / n
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        s = np.bincount(row, weights=w[col], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        g = (p - y) * share
        gw = np.bincount(col, weights=g[row], minlength=n_features) + l2 * w
        gb = g.sum()
        if len(pairs):
            s2 = np.bincount(row2, weights=w[col2], minlength=len(pairs)) + b
            d = 2 * fairness * (s[pairs] - s2) / len(pairs)
            on = np.zeros(n)
            on[pairs] = d
            gw += np.bincount(col, weights=on[row], minlength=n_features) - np.bincount(col2, weights=d[row2], minlength=n_features)
        g = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _scorer(model: dict):
    weights, bias, identity = model["weights"], model["bias"], frozenset(model["identity"])
    known: dict[bytes, tuple] = {}

    def of(text: str | None) -> float:
        words = words_of(text)
        if len(known) > _WORDS_HELD:
            known.clear()
        for w in words.difference(known):
            known[w] = tuple(f for f in features(w, identity) if f in weights)
        hit = set().union(*filter(None, map(known.__getitem__, words)))
        s = bias + sum(weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-min(max(s, -40.0), 40.0))))

    return of


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: id_col, score (0 to 1), predicted (1 if score >= threshold).

    Whole texts are read. A null, empty or wordless text gets the score of a text
    without features. Repeated rows give repeated results; null ids stay null;
    only id_col and text_col are looked at; an empty table gives no rows. Whole texts of
    any length: memory is that of a few texts and a bounded table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = _scorer(shared.value)
        for batch in slices(batches):
            out = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    out = in_arrow(rows, run, "id string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(df: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, whole, whose text scores below the threshold. Nothing is joined,
    so null and repeated ids, and columns of any names, are no matter."""
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = _scorer(shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([of(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return in_arrow(df, run, df.schema)
