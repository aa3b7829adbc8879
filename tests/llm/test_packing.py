"""Packing against the tokenizer's library, brute force and the bounds of windows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqspark.llm.packing import END, Words, boundaries, cut, pack, words_apart
from seqspark.llm.queries import word_tokenizer

JSON = word_tokenizer()
LIBRARY = Tokenizer.from_str(JSON)


def test_words_give_the_library_s_ids():
    assert words_apart(JSON)
    assert not words_apart(word_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(5)
    symbols = [*" \n\t\r\x0b\x1c\x85\xa0\u2000\u3000\u00c0\u00c9e\u0301\u03a3\u03c2'sT.?!,12\ud55c\ufb01\u2460\u0130\u00df\u4e2d\U0001f642\u200b", "<|endoftext|>", "'ll", " "]
    symbols += [*"()\u00d7\u0178\u01c5\u0141\u0149A#$%&*+-/<=>@[]^_`{|}~", "<|", "|>"]
    for words in (Words(LIBRARY, limit=500), Words(LIBRARY, limit=500, letters=True)):
        for _ in range(4000):
            text = "".join(rng.choice(symbols) for _ in range(rng.randrange(40)))
            assert (words.encode(text) & ~np.uint32(END)).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def padding(size, window):
    return 0 if size & (size - 1) == 0 else window - size


def test_cuts_cost_the_least():
    rng = random.Random(2)
    for _ in range(200):
        at = np.cumsum([rng.randrange(1, 33) for _ in range(rng.randrange(1, 90))])
        cost = np.array([rng.choice([0, 4, 32]) for _ in at])
        place, price = [0, *at.tolist()], [0, *cost.tolist()]
        least = [0] * len(place)
        for b in range(1, len(place)):
            least[b] = price[b] + min(least[a] + padding(place[b] - place[a], 64) for a in range(b) if place[b] - place[a] <= 64)
        ends = [0, *cut(at, cost, 64).tolist()]
        price = dict(zip(place, price, strict=True))
        assert sum(padding(b - a, 64) + price[b] for a, b in zip(ends, ends[1:], strict=False)) == least[-1]
        assert ends[-1] == place[-1] and all(0 < b - a <= 64 for a, b in zip(ends, ends[1:], strict=False))


def test_boundaries():
    at, cost = boundaries(np.array([10, 300, 310, 315]), np.array([310, 320]), 4, 32)
    assert at.tolist() == [10, 138, 266, 300, 310, 315, 320] and cost.tolist() == [4, 32, 32, 4, 0, 4, 0]


@pytest.mark.parametrize("window", [256, 2048])
def test_pack(spark, window):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["Alpha", "beta,", "gamma.", "delta", "x-y", "42!"]) for _ in range(n))
    rows = [(i, prose(rng.choice([0, 1, 5, 60, 700])), "x", 3) for i in range(200)]
    rows += [(900, None, "x", 3), (901, "", "x", 3), (902, "word " * 30_000, "x", 3), (903, "q" * 50_000, "x", 3), (None, "No id.", "x", 3), (904, " ", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, OFFSET int").repartition(3)
    got = pack(df, JSON, window=window, ids=True).collect()
    docs, windows = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc_id, text, *_ in rows:
        pieces = sorted(docs[doc_id], key=lambda r: r.start)
        want = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        assert [x for r in pieces for x in r.ids] == want
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert all(r.doc_tokens == len(want) for r in pieces)
    used = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        used += padding(sum(r.length for r in own), window)
        assert sum(r.length for r in own) <= window
    assert used < 0.02 * sum(r.length for r in got)


def test_pack_keeps_order_and_odd_tables(spark):
    rows = [(i, f"Text number {i}. " * (i % 50)) for i in range(300)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), JSON).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    twice = [(7, "same text"), (7, "same text")]
    got = pack(spark.createDataFrame(twice, "doc_id bigint, text string").coalesce(1), JSON).collect()
    assert sum(r.length for r in got) == 6 and {r.doc_tokens for r in got} == {3} and sum(r.start == 0 for r in got) == 2
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), JSON).collect() == []
    assert pack(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), JSON, end_id=None).collect() == []
