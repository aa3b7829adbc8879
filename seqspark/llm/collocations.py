"""Phrase collocations: n-grams that occur far more often than their parts suggest.

Tasks explode the n-grams of their texts into rows, and Spark adds them up by language
and phrase. Sizes are counted one after another: an n-gram can't be frequent unless
both (n-1)-grams in it are, so those that hold an infrequent one give no row. A Bloom
filter of the frequent shorter phrases tells; what it lets through in error is counted
like the others and falls to the threshold, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import in_arrow, materialise, slices

MIN_COUNT, MAX_N, TOP, COVER = 10, 3, 2000, 50

#: Bytes that end a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"

#: Lower-cases A-Z, ends of pieces become line feeds, tabs blanks.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_ENDS) + b" ")

#: Words that a task holds before it sends its counts on.
LOT_WORDS = 2_000_000

#: Bytes of text, and those up to the end of the piece, that are split into words at a time.
SLICE_BYTES = 1_000_000

#: Phrases that a task sends on at a time.
BATCH_ROWS = 65_536

#: Most bits of a filter; bits a phrase below that, and probes.
FILTER_BITS, PHRASE_BITS, PROBES = 1 << 27, 12, 4

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _word_hash(words) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    x = (h ^ (h >> np.uint64(29))) * _MIX[1] + word * _MIX[2]
    return x ^ (x >> np.uint64(32))


def _bits(h: np.ndarray, lang: str, bits: int):
    """Where a filter of so many bits (a power of two) looks for phrases of a language."""
    h = h ^ _word_hash([b"lang:" + lang.encode()])[0]
    for m in _MIX:
        yield ((h * m) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _holds(table: np.ndarray, h: np.ndarray, lang: str) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _bits(h, lang, len(table) * 64):
        out &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return out


class Lot:
    """Words of one language, waiting to be counted. Code 0 stands for the end of a piece."""

    def __init__(self):
        self.index: dict[bytes, int] = {b"\n": 0}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        index, at = self.index, 0
        while at < len(data):
            end = data.find(b"\n", at + SLICE_BYTES)
            end = len(data) if end < 0 else end
            words = [w for w in data[at:end].replace(b"\n", b" \n ").split(b" ") if w]
            for w in set(words).difference(index):
                index[w] = len(index)
            self.codes += [np.fromiter(map(index.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
            self.size += len(words) + 1
            at = end

    def count(self, n: int, lang: str, tables: list[np.ndarray]):
        """(phrases, their numbers), some at a time: n-grams whose shorter parts pass the filters."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        words = list(self.index)
        if n == 1:
            yield words[1:], np.bincount(codes, minlength=len(words))[1:]
            return
        own = _word_hash(words)
        # of the m-grams that begin at each place: number (-1: none), and of each number a place and a hash
        gram = np.where(codes > 0, codes, -1).astype(np.int64)
        h, good = own, _holds(tables[0], own, lang)
        good[0] = False
        for m in range(1, n):
            gram = np.where((gram >= 0) & good[gram], gram, -1)
            place = np.flatnonzero((gram[:-1] >= 0) & (gram[1:] >= 0))
            last = codes[place + m]
            key, first, inverse, counts = np.unique(gram[place] * len(words) + last, return_index=True, return_inverse=True, return_counts=True)
            if not len(key):
                return
            h = _longer(h[key // len(words)], own[key % len(words)])
            gram = np.full(len(codes), -1, np.int64)
            gram[place] = inverse
            if m < n - 1:
                good = _holds(tables[m], h, lang)
        at = place[first]
        del gram, place, key, first, inverse, h
        for a in range(0, len(at), BATCH_ROWS):
            columns = [[words[c] for c in codes[at[a : a + BATCH_ROWS] + j].tolist()] for j in range(n)]
            yield list(map(b" ".join, zip(*columns, strict=True))), counts[a : a + BATCH_ROWS]


def _grams(df: DataFrame, lang: str, text: str, n: int, tables: list) -> DataFrame:
    """(lang, phrase, n) of n-grams, counted within tasks."""
    names = ["lang", "phrase", "n"]

    def flush(lots: dict):
        for name, lot in lots.items():
            for phrases, counts in lot.count(n, name, [t.value for t in tables]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names)

    def run(batches):
        lots: dict[str, Lot] = {}
        size = 0
        for part in slices(batches):
            kinds = part.column(0).to_pylist()
            for name in dict.fromkeys(kinds):
                data = b"\n".join(t.encode() for k, t in zip(kinds, part.column(1).to_pylist(), strict=True) if k == name).translate(_CLEAN)
                lot = lots.setdefault(name, Lot())
                size -= lot.size
                lot.add(data)
                size += lot.size
            if size >= LOT_WORDS:
                yield from flush(lots)
                lots, size = {}, 0
        yield from flush(lots)

    rows = df.where(F.length(text) > 0).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t"))
    return in_arrow(rows, run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter(frequent: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of the phrases, at most so many bits: tasks give its words, Spark joins them by OR."""
    bits = 1 << max(10, int(PHRASE_BITS * max(1, frequent.count()) - 1).bit_length())
    bits = min(bits, most_bits)

    def run(batches):
        for part in slices(batches, 65_536):
            langs, phrases = np.array(part.column(0).to_pylist(), object), part.column(1).to_pylist()
            split = [p.encode().split(b" ") for p in phrases]
            word, mask = [], []
            hashes = np.array([_word_hash(w[:1])[0] for w in split], np.uint64)
            for j in range(1, max(map(len, split), default=1)):
                own = np.array([i for i, w in enumerate(split) if len(w) > j], np.int64)
                hashes[own] = _longer(hashes[own], _word_hash([split[i][j] for i in own.tolist()]))
            for lang in dict.fromkeys(langs.tolist()):
                for at in _bits(hashes[langs == lang], lang, bits):
                    word.append(at >> 6)
                    mask.append((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))
            if word:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(word)), pa.array(np.concatenate(mask))], ["word", "mask"])

    got = in_arrow(frequent.select("lang", "phrase"), run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return table


def phrase_counts(df: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, min_count: int = MIN_COUNT, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases of 1 to max_n words that occur min_count times or more: lang, size, phrase, n; words in all: lang, n)."""
    words = materialise(_grams(df, lang, text, 1, []), "words")
    found = [materialise(words.where(F.col("n") >= min_count), "phrases")]
    tables: list = []
    context = df.sparkSession.sparkContext
    for n in range(2, max_n + 1):
        tables.append(context.broadcast(_filter(found[-1], filter_bits)))
        found.append(materialise(_grams(df, lang, text, n, tables).where(F.col("n") >= min_count), "phrases"))
    out = found[0].withColumn("size", F.lit(1))
    for n, more in enumerate(found[1:], 2):
        out = out.unionByName(more.withColumn("size", F.lit(n)))
    return out, words.groupBy("lang").agg(F.sum("n").alias("total"))


#: Parts that a language's phrases are ranked in before its first ones meet.
RANK_PARTS = 64


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_n words.

    Texts are lower-cased (A-Z) and split at .,;:!? and line ends into pieces, those at
    blanks and tabs into words. a is how often a phrase occurs within pieces, l and r how often
    its first k words and the others do, n the language's words; the score is
    floor(1000000 a a / (l r)) for the cut k that makes it least (of equal ones the first),
    in Decimal, exact up to a = 4 * 10^15. A phrase with a < min_count is none; one that
    lies in a longer phrase with 100 f >= cover * a is dropped (a one-word extension tells: it
    occurs at least as often as any longer one). rank: by score and a, largest first, then phrase by bytes.

    A null language counts as und; null and empty texts hold nothing; repeated rows count each
    time; ids and other columns aren't looked at; an empty table gives no rows. Texts of
    any length: a task holds LOT_WORDS words and one text. Filters take filter_bits at
    most: with far more frequent phrases than that they let more through, to the same result.
    """
    counts, totals = phrase_counts(df, lang, text, max_n, min_count, filter_bits)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    candidates = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size")
    cuts = candidates.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size")).alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    scored = scored.withColumn("up", (whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("down", (whole("l") * whole("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")

    longer = candidates.where("size > 2").withColumn("w", words)
    inside = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size")))).alias("phrase"), F.col("a").alias("f"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = best.join(inside, (best["lang"] == inside["lang"]) & (best["phrase"] == inside["phrase"]) & (100 * F.col("f") >= cover * F.col("a")), "left_anti")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a part of a language first: none has to sort all its phrases
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
