"""Language-model scoring of whole documents with a gated recurrent network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm import gru, wordkeys
from seqspark.llm.common import in_arrow, materialise, release

#: Words in a task's own table, classes of frequent words, classes of all others (by spelling).
TABLE_WORDS, HEAD, TAIL = 500_000, 32, 1 << wordkeys.CLASS_BITS

CLASSES = HEAD + TAIL // gru.MEMBERS

#: The training rows are dealt into so many parts, each trained on from the average that
#: the one before gave; a part into shards of about so many tokens, but no more than MAX_SHARDS.
PARTS, SHARD_TOKENS, MAX_SHARDS = 4, 2_000_000, 10_000

#: Learning rates at the beginning and the end of the training rows.
RATES = (0.01, 0.0005)

#: Texts of so many tokens begin first, so that they don't go on alone at a task's end.
LONG_TOKENS = 2_048

BLOCK = 512  # weights averaged together


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, c): the key of each token of all rows with its count; counted in the tasks first."""

    def run(batches):
        counts = wordkeys.Counts()
        for batch in batches:
            for _, _, keys, _ in wordkeys.tokens(batch, 0):
                yield from map(out, counts.add(keys))
        yield from map(out, counts.rest())
        del counts
        release()

    def out(pair):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], names=["w", "c"])

    return in_arrow(docs.select(F.col(text_col).alias("t")), run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words above some count, TABLE_WORDS at most, and the end; most frequent first.

    The count comes from a histogram (eight classes to each doubling), so the
    driver gets its few hundred rows and then only the words themselves."""
    step = F.floor(F.log2("c") * 8)
    room, least = TABLE_WORDS, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["s"]
    keep = F.col("w") == wordkeys.END
    got = counts.where(keep if least is None else (step >= least) | keep).toArrow()
    w, c = got["w"].to_numpy(), got["c"].to_numpy()
    order = np.lexsort((w, -c))
    return w[order], c[order]


def vocabulary(counts: DataFrame) -> dict:
    """The model before training: words of the table with their outputs and counts, totals,
    and weights that make it the class-factored unigram model."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    keys, c = _frequent(counts)
    members = HEAD * gru.MEMBERS
    end = np.flatnonzero(keys == wordkeys.END)
    if len(end) and end[0] >= members:  # the end is always told apart
        order = np.arange(len(keys))
        order[members - 1], order[end[0]] = end[0], members - 1
        keys, c = keys[order], c[order]
    known = min(members, len(keys))
    rows = np.where(np.arange(len(keys)) < known, np.arange(len(keys)), members + (keys & (TAIL - 1)))
    names = keys[:known].tolist()
    far = counts.where(~F.col("w").isin(names)) if names else counts  # 1,024 keys at most
    tail_c, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in far.groupBy(F.col("w").bitwiseAND(F.lit(TAIL - 1)).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        tail_c[r["k"]], tail_v[r["k"]] = r["c"], r["v"]
    by_output = np.zeros(CLASSES * gru.MEMBERS)
    by_output[:known] = c[:known]
    by_output[members:] = tail_c
    start = int(np.flatnonzero(keys == wordkeys.END)[0]) if len(keys) else 0
    weights = gru.flat(gru.init(by_output.reshape(CLASSES, gru.MEMBERS)))
    return {"keys": keys, "rows": rows.astype(np.int16), "logs": np.log10(c + 1.0), "n": int(n), "v": int(v), "tail_log": np.log10(tail_c + tail_v + 1), "start": start, "weights": weights}


ENCODED = "uid bigint, id string, train boolean, key bigint, n_tokens bigint, known bigint, base double, own double, rest array<bigint>, ids binary"


def encode(docs: DataFrame, model: dict, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, its whole text as outputs of the network (`ids`, 16 bits
    each), with what the word counts alone say: known tokens, base (log10 under the
    counts), own (what listed words of tail classes add to the network's score), and
    the keys of the words that aren't in the model's table."""
    small = {k: model[k] for k in ("keys", "rows", "logs", "n", "v", "tail_log")}
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        m = shared.value
        table, members = wordkeys.Table(m["keys"]), HEAD * gru.MEMBERS
        rows, logs = np.append(m["rows"], 0), np.append(m["logs"], 0.0)
        unit = np.log10(m["n"] + m["v"] + 1.0)
        within = np.append(np.zeros(members), m["tail_log"])
        extra = np.append(np.where(m["rows"] >= members, m["logs"], 0.0), 0.0)
        for batch in batches:
            for i, j, keys, first in wordkeys.tokens(batch, 4):
                at = table.find(keys)
                lost = np.flatnonzero(at < 0)
                row = rows[at]
                row[lost] = members + (keys[lost] & (TAIL - 1))
                n = np.diff(first)
                base, own = np.add.reduceat(logs[at], first[:-1]) - n * unit, np.add.reduceat(extra[at] - within[row], first[:-1])
                far = np.searchsorted(lost, first)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in range(4)),
                        pa.array(n, pa.int64()),
                        pa.array(n - np.diff(far), pa.int64()),
                        pa.array(base),
                        pa.array(own),
                        pa.ListArray.from_arrays(pa.array(far, pa.int32()), pa.array(keys[lost], pa.int64())),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(row.astype("<i2"))]),
                    ],
                    names=["uid", "id", "train", "key", "n_tokens", "known", "base", "own", "rest", "ids"],
                )
        release()

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col)).alias("key"),
        F.col(text_col).alias("t"),
    )
    return materialise(in_arrow(rows, run, ENCODED), "encoded")


def _texts(batches, column: int, seen=None) -> Iterator[np.ndarray]:
    """The outputs of each row's text; seen: gets each batch first."""
    for batch in batches:
        if seen:
            seen(batch)
        data, at = wordkeys.buffers(batch.column(column))
        ids = np.frombuffer(data, "<i2") if len(data) else np.zeros(0, np.int16)
        for a, b in zip((at[:-1] // 2).tolist(), (at[1:] // 2).tolist(), strict=True):
            yield ids[a:b]


def fit(encoded: DataFrame, model: dict, parts: int = PARTS, rates: tuple[float, float] = RATES, shard_tokens: int = SHARD_TOKENS) -> np.ndarray:
    """The network's weights after reading every token of the rows marked `train`, once.

    Rows go to parts and shards by hash of id and text, so the weights depend on the
    rows alone, not on how a table is split into files. Each shard trains from the
    weights so far, by truncated backpropagation with the state carried to each
    text's end; a part's shards are averaged by tokens seen."""
    weights = model["weights"]
    shards = max(1, min(MAX_SHARDS, -(-model["n"] // (parts * shard_tokens))))
    at = lambda share: rates[0] + (rates[1] - rates[0]) * share
    for part in range(parts):
        own = encoded.where(F.col("train") & (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)) == part)).select((F.col("n_tokens") >= LONG_TOKENS).alias("long"), "key", "ids")
        own = own.repartition(shards, "key").sortWithinPartitions(F.col("long").desc(), "key").select("ids")
        blocks = in_arrow(own, _trainer(encoded, weights, model["start"], (at(part / parts), at((part + 1) / parts)), model["n"] // (parts * shards)), _WEIGHTS).groupBy("k").applyInArrow(_total, _WEIGHTS).collect()
        if blocks:
            weights = np.concatenate([np.array(r["w"]) / r["n"] for r in sorted(blocks, key=lambda r: r["k"])]).astype(np.float32)
    return weights


_WEIGHTS = "k int, shard int, w array<double>, n bigint"


def _trainer(frame: DataFrame, weights: np.ndarray, start: int, rates: tuple[float, float], tokens: int):
    shared = frame.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value.copy()
        seen = gru.train(w, _texts(batches, 0), start, CLASSES, rates, tokens)
        release()
        if seen:
            parts = [w[i : i + BLOCK].astype(np.float64) * seen for i in range(0, len(w), BLOCK)]
            context = TaskContext.get()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([context.partitionId() if context else 0] * len(parts), pa.int32()), pa.array(parts, pa.list_(pa.float64())), pa.array([seen] * len(parts), pa.int64())], names=["k", "shard", "w", "n"])

    return run


def _total(t: pa.Table) -> pa.Table:
    t = t.sort_by("shard").combine_chunks()
    w = t["w"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
    return pa.table({"k": t["k"].slice(0, 1).cast(pa.int32()), "shard": pa.array([0], pa.int32()), "w": pa.array([w], pa.list_(pa.float64())), "n": pa.array([t["n"].to_numpy().sum()], pa.int64())})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, rates: tuple[float, float] = RATES) -> tuple[dict, DataFrame]:
    """(model, word counts) from all rows of docs.

    Word counts, class totals and the network's training all cover every row and
    grow with the input; the network reads every token once. The driver gets the
    counts' totals, at most TABLE_WORDS keys and the weights.
    """
    counts = materialise(count_words(docs, text_col), "words")
    model = vocabulary(counts)
    if model["n"] and parts:
        model["weights"] = fit(encode(docs, model, F.lit(True), id_col, text_col), model, parts, rates)
    return model, counts


def score(docs: DataFrame, model: dict, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    The network reads a document to its end, its state going on from window to
    window. A word of a tail class has the class's probability times
    (c + 1) / (tokens + words + 1 of the class). Words outside the task's table
    are looked up in the whole table of counts by a join, split where skewed.

    A null text is empty: one token, the end. Without any training token all
    words are unknown, base_score is 0 and so is score. An empty table gives no
    rows. Repeated rows give repeated results, null ids stay null, other columns
    are not looked at. Long texts are cut into pieces between words while they
    are encoded, and read window by window; a task holds the outputs (two bytes a
    token) of the texts that it reads at the time.
    """
    return _scored(encode(docs, model, F.lit(False), id_col, text_col), model, counts, id_col, docs.schema[id_col].dataType.simpleString())


def _scored(encoded: DataFrame, model: dict, counts: DataFrame, id_col: str, kind: str) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast((model["weights"], model["start"], model["n"]))
    columns = ["uid", "id", "n_tokens", "known", "base", "own"]
    schema = pa.schema([("uid", pa.int64()), ("id", pa.string()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64())])

    def run(batches):
        weights, start, n = shared.value
        held: dict[int, tuple] = {}
        out: list[tuple] = []

        def take(batch):
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                held[take.next] = row
                take.next += 1

        take.next = 0

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        texts = _texts((b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)), 6, take)
        for i, s in gru.log10_likelihood(weights, texts, start, CLASSES) if n else ((i, None) for i, _ in enumerate(texts)):
            *row, own = held.pop(i)
            out.append((*row, 0.0 if s is None else own + s))
            if len(out) == 4096:
                yield flush()
        if out:
            yield flush()
        release()

    # long texts begin first
    rows = encoded.sortWithinPartitions((F.col("n_tokens") >= LONG_TOKENS).desc()).select(*columns, "ids")
    rows = in_arrow(rows, run, "uid bigint, id string, n_tokens bigint, known bigint, base double, own double")
    met = encoded.select("uid", F.explode("rest").alias("w")).join(counts, "w")
    more = met.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("found"))
    add = F.coalesce("more", F.lit(0.0))
    return rows.join(more, "uid", "left").select(
        F.col("id").cast(kind).alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"),
        (F.col("own") + add).alias("score"),
    )


def train_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, rates: tuple[float, float] = RATES) -> DataFrame:
    """score() of all rows by what learn() finds in those where `train` holds; texts are encoded once."""
    counts = materialise(count_words(docs.where(train), text_col), "words")
    model = vocabulary(counts)
    encoded = encode(docs, model, train, id_col, text_col)
    if model["n"]:
        model["weights"] = fit(encoded, model, parts, rates)
    return _scored(encoded, model, counts, id_col, docs.schema[id_col].dataType.simpleString())
