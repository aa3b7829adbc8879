"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seqspark.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_n, least, top, cover=50):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, max_n + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        total = sum(v for k, v in own.items() if len(k) == 1)
        cands = {k: v for k, v in own.items() if len(k) > 1 and v >= least}
        held = defaultdict(int)
        for k, v in cands.items():
            for n in range(2, len(k)):
                for i in range(len(k) - n + 1):
                    held[k[i : i + n]] = max(held[k[i : i + n]], v)
        rows_ = []
        for k, a in cands.items():
            score, cut = min((1_000_000 * a * a // (own[k[:i]] * own[k[i:]]), i) for i in range(1, len(k)))
            if 100 * held[k] < cover * a:
                rows_.append((-score, -a, " ".join(k).encode(), own[k[:cut]], own[k[cut:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -s))
    return sorted(out)


@pytest.mark.parametrize("max_n,top,lot,bits", [(3, 2000, 2_000_000, 1 << 27), (3, 7, 300, 1 << 10), (5, 40, 300, 1 << 12)])
def test_collocations(spark, monkeypatch, max_n, top, lot, bits):
    monkeypatch.setattr(C, "LOT_WORDS", lot)
    monkeypatch.setattr(C, "SLICE_BYTES", 200)
    rng = random.Random(max_n)
    words = ["New", "york", "City", "ünder", "zug", "a", "b\u00a0c", "x1", "\U0001f600"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "  "]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "de", None]), text(rng.randrange(60))) for _ in range(150)]
    rows += [("en", "New York City hall. " * 40), ("en", None), ("fr", ""), ("fr", " ,. "), (None, None), ("und", text(200))] + [("en", "same row here")] * 12
    df = spark.createDataFrame([(i, *r, "x", 1.5) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string, phrase string, N double").repartition(3)
    got = C.collocations(df, max_n=max_n, min_count=4, top=top, filter_bits=bits).collect()
    want = plain(rows, max_n, 4, top)
    assert sorted(tuple(r) for r in got) == want and {r[0] for r in want} == {"en", "de", "und"}


def test_scores_beyond_64_bits(spark):
    """Products of counts of 10^12 stay exact."""
    a, left, right = 3 * 10**12 + 1, 3 * 10**12 + 7, 7 * 10**12 + 3
    got = spark.sql(f"SELECT cast({a} AS decimal(19,0)) * cast({a} AS decimal(19,0)) * cast(1000000 AS decimal(7,0)) AS u, cast({left} AS decimal(19,0)) * cast({right} AS decimal(19,0)) AS d").selectExpr("cast(u AS decimal(38,0)) div cast(d AS decimal(38,0)) AS s").first().s
    assert got == 1_000_000 * a * a // (left * right)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
