"""Language identification of whole and mixed texts: script ranges, word scores, Viterbi."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import in_arrow

BUCKETS = 1 << 16
TOP = 0x34000  # code points above hold no letters

# Code point ranges of scripts.
SCRIPTS = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Ethiopic", [(0x1200, 0x137F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Mongolian", [(0x1800, 0x18AF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF), (0x30000, 0x31FFF)]),
]
OTHER = len(SCRIPTS) + 1  # letters of scripts not listed; 0 is no letter


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its script, 0 for neither letter nor mark; its lower case where
    that is one code point; whether it is a letter."""
    import unicodedata

    script, lower, letter = np.zeros(TOP + 1, np.uint8), np.arange(TOP + 1, dtype=np.uint32), np.zeros(TOP + 1, bool)
    for i in range(TOP):
        c = chr(i)
        letter[i] = c.isalpha()
        if letter[i] or unicodedata.category(c) in ("Mn", "Mc") and i > 0x36F:
            script[i] = OTHER
        if len(low := c.lower()) == 1:
            lower[i] = min(ord(low), TOP)
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            script[a : min(b, TOP - 1) + 1][script[a : min(b, TOP - 1) + 1] > 0] = k
    return script, lower, letter


def words_of(texts: list[str], tables):
    """The words of some texts: runs of letters of one script, marks included, with one letter at least.

    Returns (bucket of each letter's trigram, first letter of each word, script of
    each word, text of each word, first character and one past the last)."""
    script_of, lower, letter = tables
    parts = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    cp = np.full(int(sizes.sum()), 32, np.uint32)
    ends = np.cumsum(sizes)
    for p, e in zip(parts, ends, strict=True):
        cp[e - 1 - len(p) : e - 1] = p
    cp = lower[np.minimum(cp, TOP)]
    script = script_of[cp]
    at = np.flatnonzero(script)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    s = script[at]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (s[1:] != s[:-1])
    begin = np.flatnonzero(first)
    real = np.logical_or.reduceat(letter[cp[at]], begin)
    if not real.all():  # marks without a letter
        keep = np.repeat(real, np.diff(np.append(begin, len(at))))
        at, s, first = at[keep], s[keep], first[keep]
        if not len(at):
            z = np.zeros(0, np.int64)
            return z, z, z, z, z, z
    last = np.ones(len(at), bool)
    last[:-1] = first[1:]
    c = cp[at].astype(np.uint64)
    before, after = np.full(len(c), 32, np.uint64), np.full(len(c), 32, np.uint64)
    before[1:][~first[1:]] = c[:-1][~first[1:]]
    after[:-1][~last[:-1]] = c[1:][~last[:-1]]
    h = before * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    word = np.flatnonzero(first)
    text = np.searchsorted(ends, at[word], side="right")
    base = ends[text] - sizes[text]
    return bucket, word, s[word].astype(np.int64), text, at[word] - base, at[np.flatnonzero(last)] + 1 - base


def _grouped(batch, limit=2_000_000):
    """Row ranges of a batch with a bounded number of characters each (one row at least)."""
    n, start, size = batch.num_rows, 0, 0
    lengths = [len(x) if x is not None else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
    for i, k in enumerate(lengths):
        if i > start and size + k > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += k
    if n > start:
        yield batch.slice(start, n - start)


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_share: float = 0.01) -> dict:
    """Trigram and script counts of every row with a text and a language.

    Counts are made in each task and summed by Spark; what reaches the driver is
    at most 65,536 numbers a language, however many the rows."""

    def run(batches):
        tables = letter_tables()
        count: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _grouped(batch):
                langs = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                for lang in dict.fromkeys(langs):
                    own = [t for t, k in zip(texts, langs, strict=True) if k == lang]
                    bucket, word, script, *_ = words_of(own, tables)
                    c = count.setdefault(lang, np.zeros(BUCKETS + 64, np.int64))
                    c[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    if len(word):
                        c[BUCKETS:] += np.bincount(script, weights=np.diff(np.append(word, len(bucket))), minlength=64).astype(np.int64)
        for lang, c in count.items():
            full = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(full), pa.string()), "k": pa.array(full, pa.int32()), "n": pa.array(c[full], pa.int64())})

    rows = df.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    counts = in_arrow(rows, run, "lang string, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    of = {x: i for i, x in enumerate(langs)}
    all_ = np.zeros((BUCKETS + 64, len(langs)))
    if langs:
        all_[counts["k"].to_numpy(), [of[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    tri, scripts = all_[:BUCKETS], all_[BUCKETS:]
    logp = np.log((tri + 0.5) / (tri.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    uses = scripts >= np.maximum(1, min_share * scripts.sum(0))
    uses[~uses.any(1)] = True  # a script that no language uses narrows nothing
    return {"langs": langs, "logp": logp, "uses": uses}


def viterbi(score: np.ndarray, start: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: score (words x labels), the first word and the
    number of words of each text. All texts take their steps together."""
    out = np.zeros(len(score), np.int16)
    order = np.argsort(-size, kind="stable")
    begin, size = start[order], size[order]
    order = order[size > 0]
    begin, size = begin[size > 0], size[size > 0]
    if not len(size):
        return out
    steps = int(size[0])
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than t
    stay = np.ones(score.shape, bool)
    came = np.zeros(len(score), np.int16)
    delta = score[begin].copy()
    final = np.zeros(len(size), np.int16)
    for t in range(1, steps):
        k = alive[t]
        if k < len(delta):
            final[k : len(delta)] = delta[k:].argmax(1)
            delta = delta[:k]
        at = begin[:k] + t
        top = delta.argmax(1)
        jump = delta[np.arange(k), top][:, None] - penalty
        s = delta >= jump
        stay[at], came[at] = s, top
        delta = np.where(s, delta, jump) + score[at]
    final[: len(delta)] = delta.argmax(1)
    # back: the longest texts begin first
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        cur = state[:k]
        out[at] = cur
        state[:k] = np.where(stay[at, cur], cur, came[at])
    return out


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """One row per row of df: id_col, lang_pred, score, n_words and, where asked
    for, spans (array of start, end, lang; characters of the text).

    A word's script leaves the languages that use it; those get the sum of the
    word's trigram log-probabilities; the best path with `penalty` for each
    change of language labels every word. lang_pred is the language with most
    letters (on a tie the first in order), score its share of all letters.

    A text that is null or has no letters (digits, marks or signs alone), or a model
    without languages: 'und', score 0, no spans. An empty table gives no rows.
    Texts of any length: rows are read together up to two million characters, a
    longer text alone. Repeated rows give repeated results; null ids stay null;
    only id_col and text_col are looked at.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        langs, logp, uses = (shared.value[k] for k in ("langs", "logp", "uses"))
        tables = letter_tables()
        names = [*langs, "und"]
        barred = np.where(uses, np.float32(0), np.float32(-1e6))
        for batch in batches:
            for part in _grouped(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = len(texts)
                bucket, word, script, text, a, b = words_of(texts, tables)
                pred, share = np.full(n, len(langs)), np.zeros(n)
                words = np.bincount(text, minlength=n) if len(word) else np.zeros(n, np.int64)
                found: list[list] = [[] for _ in range(n)]
                if len(word) and langs:
                    score = np.add.reduceat(logp[bucket], word, axis=0) + barred[script]
                    first = np.cumsum(words) - words
                    label = viterbi(score, first, words, penalty)
                    letters = np.zeros((n, len(langs)))
                    np.add.at(letters, (text, label), b - a)
                    total = letters.sum(1)
                    has = total > 0
                    pred[has] = letters[has].argmax(1)
                    share[has] = letters[has].max(1) / total[has]
                    if spans:
                        new = np.ones(len(word), bool)
                        new[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
                        i = np.flatnonzero(new)
                        j = np.append(i[1:], len(word)) - 1
                        for d, x, y, k in zip(text[i].tolist(), a[i].tolist(), b[j].tolist(), label[i].tolist(), strict=True):
                            found[d].append({"start": x, "end": y, "lang": langs[k]})
                cols = {"id": part.column(0), "lang_pred": pa.array([names[k] for k in pred.tolist()], pa.string()), "score": pa.array(share, pa.float64()), "n_words": pa.array(words, pa.int64())}
                if spans:
                    cols["spans"] = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
                yield pa.RecordBatch.from_pydict(cols)

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    out = in_arrow(rows, run, "id string, lang_pred string, score double, n_words bigint" + ", spans array<struct<start:int,end:int,lang:string>>" * spans)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def train_and_identify(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """identify() on df with what learn() finds in its rows where `train` holds."""
    return identify(df, learn(df.where(train), lang_col, text_col), id_col, text_col, **kw)
