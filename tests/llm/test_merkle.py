"""The Merkle manifest against a plain recomputation."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from seqspark.llm.merkle import fold, manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, d string, I int"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][a : a + fanout]) for a in range(0, len(out[-1]), fanout)])
    return out


def path(tree, j, fanout):
    out = []
    for tier in tree[:-1]:
        a = j // fanout * fanout
        out.append((tier[a:j], tier[j + 1 : a + fanout]))
        j //= fanout
    return out


def expected(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        doc_id, source, lang, n_chars, text = row[:5]
        head = [field(v) for v in (doc_id, source, lang, n_chars)]
        leaf = digest([*head, field(text)])
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        groups[source].append((doc_id, leaf, digest([*head, field(text and text.translate(LOWER))]) if hit else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in names}
    trees = {s: levels([leaf for _, leaf, _ in members[s]], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for at, s in enumerate(names):
        for j, (doc_id, leaf, now) in enumerate(members[s]):
            proof = path(trees[s], j, fanout) + path(top, at, fanout)
            for before, after in proof:
                now = digest([*before, now, *after])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], digest(x for b, a in proof for x in b + a), now, now == top[-1][0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("fanout,depth", [(16, 2), (3, 2), (2, 1)])
def test_manifest(spark, fanout, depth):
    rows = [(i, "hot", "en", i, f"Text {i} ß", "x", 1) for i in range(90)]
    rows += [(i, f"s{i % 23}", None, None, "Ab" * (i % 7), None, 2) for i in range(100, 160)]
    rows += [(500, None, "de", 3, None, "y", 3), (501, "", "de", 0, "", "y", 3), (502, "Ω", "fr", 9, "word " * 50_000, "y", 3)]
    rows += [(None, "hot", "en", 1, "No id", "z", 4), (7, "hot", "en", 7, "Text 7 ß", "x", 1), (7, "hot", "en", 7, "other", "x", 1)]
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), COLUMNS, "source", "doc_id", tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, fanout=fanout, levels=depth, proofs=True)
    got = got.collect()
    assert order(tuple(r)[:7] for r in got) == order(expected(rows, fanout))
    for r in got:
        proof = list(zip(r.before, r.after, strict=True))
        assert fold(r.leaf, proof) == r.root and digest(b + a for b, a in proof) == r.proof_sha256
    assert {r.verified for r in got} == {True, False}


def test_small_tables(spark):
    one = [(3, "a", "en", 2, "Hi", "", 0)]
    assert [tuple(r) for r in manifest(spark.createDataFrame(one, SCHEMA), COLUMNS, "source", "doc_id").collect()] == expected(one, 16)
    assert manifest(spark.createDataFrame([], SCHEMA), COLUMNS, "source", "doc_id").collect() == []
