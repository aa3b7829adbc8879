import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqspark import kernel
from seqspark.config import CASE_INSENSITIVE, IUPAC, AlignConfig
from seqspark.functions.align import align, alphabet_length, cigar, edit_distance, nice_alignment, path_check, pretty_alignment, with_distance
from seqspark.functions.table import locations, register
from seqspark.operators.join import _within_one, containment_join, distance_join
from seqspark.operators.search import align_fasta, n_best, n_best_cli
from seqspark.sources.fasta import read_fasta, sequence_stats, write_scores
from seqspark.streaming.align import align_stream, n_best_stream
from tests import dp


def test_types_and_nulls(spark):
    rows = [("ab", "abc"), (None, "x"), ("x", None), ("", ""), ("", "abc")]
    df = spark.createDataFrame(rows, "q string, t string")
    got = df.select(align("q", "t", task="path").alias("r"), edit_distance("q", "t").alias("n"), edit_distance("q", "t", native=False).alias("k"), edit_distance("q", "t", k=1).alias("b")).collect()
    assert [r.n for r in got] == [r.k for r in got] == [1, None, None, 0, 3]
    assert [r.b for r in got] == [1, None, None, 0, 3]
    assert got[1].r is None and got[0].r.cigar == "2=1D" and got[0].r.end_locations == [2] and got[3].r.end_locations == [-1]
    arr = spark.createDataFrame([([1, 2, 3], [1, 3])], "q array<int>, t array<int>")
    assert arr.select(edit_distance("q", "t", mode="HW", native=False)).first()[0] == 1
    raw = spark.createDataFrame([(bytearray(b"\x00\xff\x01"), bytearray(b"\x00\x01"))], "q binary, t binary")
    assert raw.select(edit_distance("q", "t", native=False)).first()[0] == 1
    assert df.limit(0).select(align("q", "t")).count() == 0


def test_native_plan_and_bound(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("a", "abcdefgh")], "q string, t string")
    plan = df.select(edit_distance("q", "t", k=3))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "levenshtein" in plan
    assert [r[0] for r in df.select(edit_distance("q", "t", k=3)).collect()] == [3, -1]
    with pytest.raises(ValueError):
        edit_distance("q", "t", mode="HW", native=True)
    with pytest.raises(ValueError):
        align("q", "t", cigar_format="x")


# The same alignment as in test_kernel.py.
def test_renderings_in_the_jvm(spark):
    q, t = "TAAGGATGGTCCCATTC", "AAGGGGTCTCATATC"
    r = spark.createDataFrame([(q, t)], "q string, t string").withColumn("r", align("q", "t", task="path"))
    got = r.select(nice_alignment("q", "t", "r").alias("n"), cigar("r.alignment").alias("c"), "r.cigar", pretty_alignment("q", "t", "r").alias("p"), alphabet_length("q", "t").alias("a")).first()
    assert tuple(got.n) == ("TAAGGATGGTCCCAT-TC", "-||||--||||.|||-||", "-AAGG--GGTCTCATATC")
    assert got.c == got.cigar and got.a == 4 and got.p.startswith("T: ")
    bad = spark.createDataFrame([(bytearray(b"\x00\x07"),), (bytearray(b""),), (None,)], "o binary")
    assert [x[0] for x in bad.select(cigar("o")).collect()] == [None, "", None]


def test_locations_and_sql(spark):
    df = spark.createDataFrame([(1, "ab", "xabxab"), (2, None, "x")], "id int, q string, t string")
    got = [tuple(r) for r in locations(df, "q", "t", mode="HW").select("id", "location_idx", "start", "end").collect()]
    assert got == [(1, 0, 1, 2), (1, 1, 4, 5)]
    register(spark)
    df.createOrReplaceTempView("pairs_t")
    sql = spark.sql("SELECT id, l.start, l.end FROM pairs_t, LATERAL seq_locations(q, t) l").collect()
    assert [tuple(r) for r in sql] == [(1, 1, 2), (1, 4, 5)]
    one = spark.sql("SELECT seq_distance('ab', 'xaab', 'HW', -1) d, seq_align('ab', 'ab', 'NW', 'path', -1).cigar c, seq_cigar(X'000103', 'standard') s, seq_nice('ab', 'b', 'NW').matched_aligned n").first()
    assert tuple(one) == (0, "2=", "1M1I1M", "-|")


@pytest.mark.parametrize("k, method", [(0, None), (1, "deletions"), (2, "deletions"), (1, "pieces"), (2, "pieces"), (3, "pieces"), (4, "pieces"), (1, None), (2, None)])
def test_join_loses_nothing(spark, k, method):
    rng = random.Random(k)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "aaa", "aaa"]
    long = "".join(rng.choice("abc") for _ in range(30))
    words += [long[:n] for n in range(20, 30)]  # on both sides of where the method changes
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    got = sorted((r.id, r.id2, r.distance) for r in distance_join(df, df.toDF("id2", "w2"), "w", "w2", k, method=method).collect())
    want = sorted((i, j, d) for i, a in enumerate(words) for j, b in enumerate(words) if a is not None and b is not None and (d := dp.table(a, b, "NW")[-1][-1]) <= k)
    assert got == want
    semi = {r.id for r in distance_join(df, df.where("id < 5").toDF("id2", "w2"), "w", "w2", k, how="left_semi", method=method).collect()}
    assert semi == {i for i, j, _ in want if j < 5}


@pytest.mark.parametrize("broadcast_bytes", [1_000_000, 0])
def test_containment(spark, broadcast_bytes):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(12)]
    queries = [texts[2][50:150], texts[3][10:60][:20] + "Z" + texts[3][10:60][21:], "ab", "q" * 60]
    got = {(r.qid, r.tid, r.distance) for r in containment_join(spark.createDataFrame(list(enumerate(queries)), "qid int, q string"), spark.createDataFrame([*enumerate(texts), (99, None)], "tid int, t string"), "qid", "q", "tid", "t", k_share=0.06, broadcast_bytes=broadcast_bytes).collect()}
    want = {(i, j, d) for i, q in enumerate(queries) for j, t in enumerate(texts) if (d := dp.search(q, t, "HW")[0]) <= int(len(q) * 0.06)}
    assert got == want and (0, 2, 0) in want and (1, 3, 1) in want


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, "abd", "y")], "a int, b string, __r string")
    other = spark.createDataFrame([("abc", 5, 6)], "b string, A int, d int")
    out = distance_join(df, other, "b", "b", 1)
    assert out.columns == ["a", "b", "__r", "b", "A", "d", "distance"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "abc", "x", "abc", 5, 6, 0), (2, "abd", "y", "abc", 5, 6, 1)]
    assert [r.a for r in distance_join(df, other, "b", "b", 0, how="left_semi").collect()] == [1]
    assert distance_join(df, other.limit(0), "b", "b", 1).count() == 0
    where = locations(df, "b", "b")
    assert where.columns == ["a", "b", "__r", "location_idx", "start", "end"] and where.count() == 2
    scored = df.select(F.col("a").alias("query_idx"), F.lit(1).alias("score"), F.lit(1).alias("__top"), F.lit(2).alias("__level"))
    assert n_best_cli(scored, 1).columns == scored.columns and n_best_cli(scored, 1).count() == 1


def test_arrays_like_strings(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    rows = [(list(a), list(b), a, b) for a in words[:8] for b in words] + [(None, ["a"], None, "a")]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>, s string, t string")
    for mode in ("NW", "HW", "SHW"):
        got = df.select(edit_distance("x", "y", mode=mode, k=20, native=False, equalities=[("a", "b")]).alias("d"), edit_distance("s", "t", mode=mode, k=20, native=False, equalities=[("a", "b")]).alias("e")).collect()
        assert all(r.d == r.e for r in got) and got[-1].d is None
    odd = spark.createDataFrame([([1, None, 3], [1, None, 4])], "x array<int>, y array<int>")
    assert odd.select(edit_distance("x", "y", native=False).alias("d")).first().d == 1


def test_distance_by_length(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (5, 127, 128, 700, 2500)]
    cut = [b[3:] + "A" for b in base]
    df = spark.createDataFrame([*zip(base, cut, strict=True), (None, "x"), ("", "")], "q string, t string")
    got = {r.q: r.distance for r in with_distance(df, "q", "t").collect()}
    assert got == {**{b: dp.table(b, c, "NW")[-1][-1] for b, c in zip(base[:4], cut[:4], strict=True)}, base[4]: 4, None: None, "": 0}
    assert {r.q: r.distance for r in with_distance(df, "q", "t", k=2).collect()}[base[4]] == -1


def cli_rule(scores, n, k):
    """A run that tightens its bound as it goes; scores over the bound are -1."""
    import heapq

    heap, kept, bound = [], [], k
    for i, s in enumerate(scores):
        if bound >= 0 and s > bound:
            continue
        kept.append((i, s))
        heapq.heappush(heap, -s)
        if len(heap) > n:
            heapq.heappop(heap)
        if len(heap) == n:
            bound = -heap[0] - 1 if k < 0 else min(k, -heap[0] - 1)
    top = -heap[0] if heap else -1
    return sorted((i, s) for i, s in kept if s <= top)


def test_n_best(spark):
    rng = random.Random(3)
    for n, k, most in ((1, -1, 4), (3, -1, 6), (3, 2, 6), (5, -1, 1), (10, 4, 9)):
        scores = [rng.randint(0, most) for _ in range(30)]
        df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "query_idx int, score int")
        assert sorted((r.query_idx, r.score) for r in n_best_cli(df, n, k).collect()) == cli_rule(scores, n, k)
        assert [r.query_idx for r in n_best(df, n).orderBy("score", "query_idx").collect()] == [i for _, i in sorted((s, i) for i, s in enumerate(scores))[:n]]
    assert n_best(df, 0).count() == 30


FASTA = {
    "a.fa": ">one\nACGT\nAC\n>two > still header\r\nGG\r\nTT>mid line\nCC\n>empty\n>last\n",
    "b.fa": "acgt n\nAC\n>x\nT",
    "c.fa": "",
}


def test_fasta(spark, tmp_path):
    for name, text in FASTA.items():
        (tmp_path / name).write_text(text, newline="")
    got = [(r.path[-4:], r.seq_idx, r.header, r.sequence) for r in read_fasta(spark, str(tmp_path)).orderBy("path", "seq_idx").collect()]
    assert got == [("a.fa", 0, "one", "ACGTAC"), ("a.fa", 1, "two > still header", "GGTT"), ("a.fa", 2, "mid line", "CC"), ("b.fa", 0, None, "acgt nAC"), ("b.fa", 1, "x", "T")]
    assert tuple(sequence_stats(read_fasta(spark, str(tmp_path))).first()) == (5, 21)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_fasta(spark, str(tmp_path / "missing"))


def test_fasta_in_splits(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice([">", "\n", "\r\n", "A", "C", "G > T", ">x > y\n", "ACGT" * 5, ">h\nAC\n"]) for _ in range(400))
    (tmp_path / "a.fa").write_text(text, newline="")
    (tmp_path / "b.fa").write_text(">only > one > header" * 20, newline="")
    (tmp_path / "c.fa").write_text("ACGT" * 200 + "\n>x\nA", newline="")

    def plain(text):
        out, header, body, inside = [], None, [], False
        for c in text:
            if inside:
                if c == "\n":
                    inside = False
                else:
                    header += c
            elif c == ">":
                out.append((header, "".join(body)))
                header, body, inside = "", [], True
            elif c not in "\r\n":
                body.append(c)
        out.append((header, "".join(body)))
        return [(h.removesuffix("\r") if h is not None else None, b) for h, b in out if b]

    want = {f: plain((tmp_path / f).read_bytes().decode()) for f in ("a.fa", "b.fa", "c.fa")}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "97", "40", "7"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {f: [] for f in want}
            for r in read_fasta(spark, str(tmp_path)).orderBy("path", "seq_idx").collect():
                assert r.seq_idx == len(got[r.path[-4:]])
                got[r.path[-4:]].append((r.header, r.sequence))
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_align_fasta_and_score_table(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">a\nACT\n>b\nGGG\n>c\nCGA\n")
    (tmp_path / "t.fa").write_text("CGACTGAC\n>second\nTTTT\n")
    out = align_fasta(spark, str(tmp_path / "q.fa"), str(tmp_path / "t.fa"), mode="HW", n_best_of=2, task="path", pretty=True)
    got = {r.header: (r.score, r.result.start_locations) for r in out.collect()}
    assert got == {"a": (0, [2]), "c": (0, [0])}
    write_scores(out, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["#0: 0  1 [ (2, 4) ]", "#2: 0  1 [ (0, 2) ]"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "kitten"), ("a", "mitten"), ("b", "sitting"), ("a", "x")], "k string, w string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, w string").parquet(str(tmp_path / "in")).withColumn("t", F.lit("kitten"))
    made = align_stream(stream, "w", "t").withColumn("d", F.col("result.edit_distance"))
    q = made.select("w", "d").writeStream.format("memory").queryName("aligned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("aligned").collect()} == {("kitten", 0), ("mitten", 1), ("sitting", 3), ("x", 6)}
    q = n_best_stream(made, "k", "d", "w", 2).writeStream.outputMode("update").format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, tuple(r["items"])) for r in spark.table("best").collect()} == {("a", ("kitten", "mitten")), ("b", ("sitting",))}


@pytest.mark.parametrize("mode,k", [("NW", -1), ("NW", 2), ("HW", -1), ("SHW", 3)])
def test_best_targets_with_all_ties(spark, monkeypatch, mode, k):
    from seqspark.operators import search

    monkeypatch.setattr(search, "NEAR_PAIRS", 7)
    monkeypatch.setattr(search, "NEAR_IDS", 5)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("AB") for _ in range(n))
    q = [(i, word(rng.randrange(1, 7)), "x") for i in range(12)] + [(12, "", "x"), (13, None, "x")]
    t = [(i, word(rng.randrange(1, 9)), 0) for i in range(40)] + [(40, "", 0), (41, None, 0), (39, "AB", 0), (39, "AB", 0)]
    got = search.best_targets(spark.createDataFrame(q, "id int, q string, d string"), spark.createDataFrame(t, "id int, q string, n int").repartition(3), "id", "q", "id", "q", mode=mode, k=k)
    got = sorted(tuple(r) for r in got.collect())
    want = []
    for i, a, _ in q:
        if a is None:
            continue
        d = [(dp.search(a, b, mode)[0] if a and b else max(len(a), len(b)) if mode == "NW" else len(a), j) for j, b, _ in t if b is not None]
        least = min(x for x, _ in d)
        want += [(i, j, x) for x, j in d if x == least and (k < 0 or x <= k)]
    assert got == sorted(want)
    assert search.best_targets(spark.createDataFrame([], "id int, q string"), spark.createDataFrame(t, "id int, q string, n int"), "id", "q", "id", "q").collect() == []


def test_join_with_a_piece_that_all_texts_have(spark, monkeypatch):
    from seqspark.operators import join

    monkeypatch.setattr(join, "PIECE_ROWS", 5)
    rng = random.Random(3)
    texts = ["the same long beginning " + "".join(rng.choice("ABCD") for _ in range(rng.randrange(0, 20))) for _ in range(120)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    got = {(r[0], r[2]) for r in join.distance_join(df, df.toDF("j", "u"), "s", "u", 3).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if dp.search(a, b, "NW")[0] <= 3}


def test_default_distance_of_long_texts(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(word(n), word(n + rng.randrange(9))) for n in (1, 20, 127, 128, 300)] + [("", word(200)), (word(200), ""), (None, word(200)), ("A", None)]
    df = spark.createDataFrame(rows, "q string, t string")
    for k in (-1, 90, 150):
        a, b = (df.select(edit_distance("q", "t", k=k, native=n).alias("d")).collect() for n in (None, True))
        assert a == b


def test_path_check(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    df = spark.createDataFrame([(word(rng.randrange(1, 30)), word(rng.randrange(1, 60))) for _ in range(60)], "q string, t string")
    for mode in ("NW", "HW", "SHW"):
        r = df.withColumn("r", align("q", "t", mode=mode, task="path")).select("r", path_check("q", "t", F.col("r"), mode).alias("c")).where("c is not null").collect()
        assert all(x.c.sound and x.c.cost == x.r.edit_distance and x.c.start == x.r.start_locations[0] and not x.c.starts_by_insertion for x in r) and r
    wrong = spark.createDataFrame([("AC", "AG")], "q string, t string").withColumn("r", F.expr("named_struct('cigar', '2=', 'end_locations', array(1))"))
    assert not wrong.select(path_check("q", "t", F.col("r")).alias("c")).first().c.sound


@pytest.mark.parametrize("mode,k,n", [("NW", -1, 5), ("HW", -1, 7), ("NW", 3, 40), ("NW", -1, 0), ("SHW", -1, 500)])
def test_n_nearest_within_a_first_bound(spark, monkeypatch, mode, k, n):
    from seqspark.operators import search

    monkeypatch.setattr(search, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(search, "SAMPLE_TIMES", 1)
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("AB") for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "query_idx int, sequence string").repartition(3)
    got = search.n_nearest(df, spark.createDataFrame([("ABBABA",)], "sequence string"), n, mode=mode, k=k).select("score", "query_idx").collect()
    want = sorted((d, i) for i, s in rows if k < 0 or (d := dp.search(s, "ABBABA", mode)[0]) <= k) if k >= 0 else sorted((dp.search(s, "ABBABA", mode)[0], i) for i, s in rows)
    assert sorted(tuple(r) for r in got) == (want[:n] if n else want)


@pytest.mark.parametrize("relation", ["iupac", "case", "chain"])
@pytest.mark.parametrize("k", [0, 1, 3])
def test_join_under_equalities(spark, monkeypatch, relation, k):
    from seqspark.operators import join

    equalities, letters = {"iupac": (IUPAC, "ACGTNRY"), "case": (CASE_INSENSITIVE, "abAB"), "chain": ((("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("e", "a")), "abcdef")}[relation]
    near = kernel.partners(equalities)
    # each pair of equal symbols has something in common, and so has each with itself
    stand = join._plain_symbols(equalities)
    reads = lambda s: set(stand.get(s, [s]))
    assert all(reads(a) & reads(b) for a in near for b in near[a])
    monkeypatch.setattr(join, "EXPANSIONS", 16)
    rng = random.Random(k)
    texts = ["".join(rng.choice(letters if rng.random() < 0.4 else letters[:3]) for _ in range(rng.randrange(0, 14))) for _ in range(45)]
    a, b = (spark.createDataFrame(list(enumerate(x)), "i int, s string") for x in (texts[:25], texts[15:]))
    got = sorted((r[0], r[2], r[4]) for r in join.distance_join(a, b, "s", "s", k, equalities=equalities).collect())
    equal = lambda x, y: x == y or y in near.get(x, ())
    far = lambda x, y: dp.table(x, y, "NW", equal)[-1][-1]
    assert got == sorted((i, j, far(x, y)) for i, x in enumerate(texts[:25]) for j, y in enumerate(texts[15:]) if far(x, y) <= k)


def test_best_of_windows_on_a_stream(spark, tmp_path):
    from datetime import datetime

    from seqspark.streaming.align import n_best_window_stream

    at = lambda h, m=0: datetime(2024, 1, 1 + h // 24, h % 24, m)
    schema = "k string, at timestamp, s int, i string"
    lots = [[("a", at(1), 5, "p"), ("a", at(2), 3, "q"), ("a", at(3), 3, "o"), ("b", at(4), 1, "r"), ("b", at(4), -1, "bad"), ("b", at(5), None, "bad"), (None, at(5), 1, "bad")], [("a", at(20), 1, "s"), ("a", at(30), 9, "t")], [("b", at(60), 2, "u"), ("a", at(2), 0, "late")]]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, lot in enumerate(lots):  # state goes from one run to the next
            spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            best = n_best_window_stream(stream, "k", "at", "s", "i", 2, "1 day", "1 hour")
            best.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = {(r.k, r.until.day, tuple(r["items"]), tuple(r.scores)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2, ("s", "o"), (1, 3)), ("b", 2, ("r",), (1,)), ("a", 3, ("t",), (9,))}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_broadcasts_no_side_by_its_estimated_size(spark, tmp_path, k, how):
    # what a small file holds may be exploded into more than the driver can
    spark.range(50).selectExpr("id", "'text ' || id as t").write.parquet(str(tmp_path / "t"))
    a = spark.read.parquet(str(tmp_path / "t"))
    plan = distance_join(a, a.toDF("other", "u"), "t", "u", k, how=how)._jdf.queryExecution().executedPlan().toString()
    builds = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    # but the few frequent pieces, one in PIECE_ROWS rows at most
    assert len(builds) <= (1 if k else 0)


def test_pairs_within_one_edit_meet_once(spark):
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)] + ["héllo", "hélo", "hello", "\U0001f600a"]
    a = spark.createDataFrame([(t,) for t in texts], "a string").distinct()
    got = _within_one(a, a.toDF("b")).collect()
    expected = {(x, y) for x in texts for y in texts if dp.table(x, y, "NW")[-1][-1] <= 1}
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_all_distances_with_equal_sequences_and_nulls(spark):
    from seqspark.operators import search

    rng = random.Random(11)
    own = [[rng.choice([7, 9, None]) for _ in range(rng.randrange(4))] for _ in range(12)] + [None, [], [9]]
    rows = [((i, None if i % 5 == 0 else f"w{i}"), own[i % len(own)]) for i in range(45)]  # each sequence three times
    df = spark.createDataFrame(rows, "id struct<n:int,w:string>, s array<int>")
    out = search.all_distances(df.where("id.n % 4 = 0"), df.toDF("other", "t"), "id", "s", "other", "t")
    got = {(r[0].n, r[0].w, r[1].n, r[1].w): r[2] for r in out.collect()}
    want = {(*a, *b): None if x is None or y is None else dp.table(x, y, "NW")[-1][-1] for a, x in rows if a[0] % 4 == 0 for b, y in rows}
    assert got == want and out.count() == len(want)


def test_array_symbols_compares_distinct_weeks(spark, tmp_path):
    from seqspark.plans.queries import q_array_symbols

    # 40 users of one and the same week
    spark.range(80).selectExpr("id AS event_id", "timestamp'2024-01-02 00:00:00' + make_dt_interval(0, 0, id) AS ts", "id % 40 AS user_id", "if(id < 40, 'view', 'click') AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    out = q_array_symbols(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 2 * 39 and {(r.week, r.other_week, r.distance) for r in rows} == {("2024-01-01", "2024-01-01", 0)}
    # two distinct sides meet in the product, not all weeks
    # what meets in the product is grouped by its sequence before
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan[plan.index("CartesianProduct") :].count("functions=[min(") >= 2


def test_all_distances_shuffles_no_pairs(spark, monkeypatch):
    from seqspark.operators import search

    monkeypatch.setattr(search, "MEMBERS", 4, raising=False)  # 30 ids of a sequence come in parts
    df = spark.range(90).selectExpr("id", "array(int(id % 3), 1) as s")
    out = search.all_distances(df.where("id % 5 = 0"), df.toDF("other", "t"), "id", "s", "other", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert {(r.id, r.other): r.distance for r in rows} == {(i, j): int(i % 3 != j % 3) for i in range(0, 90, 5) for j in range(90)} and len(rows) == 18 * 90
    # what follows the product is given out where it is compared
    above = plan[: plan.index("CartesianProduct")]
    assert "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("k", [1, 2])
def test_join_loses_no_pair_of_other_types(spark, k):
    pairs = lambda rows: {(i, j, d) for i, x in enumerate(rows) for j, y in enumerate(rows) if (d := dp.table(x, y, "NW")[-1][-1]) <= k}
    numbers = [7, 27, 270, 2670, 21, 212, -21]
    binaries = [b"", b"aa", b"\xc8a", b"\xc8\x00a", b"\xc8\xc8\xffa"]
    collated = ["abc", "ABC", "abd", "x", "X"]
    for rows, kind, texts in ((numbers, "long", list(map(str, numbers))), (binaries, "binary", binaries), (collated, "string collate UTF8_LCASE", collated)):
        df = spark.createDataFrame(list(enumerate(rows)), f"i int, t {kind}")
        got = distance_join(df, df.toDF("j", "u"), "t", "u", k)
        assert got.schema["t"].dataType == got.schema["u"].dataType == df.schema["t"].dataType
        assert {(r.i, r.j, r.distance) for r in got.collect()} == pairs(texts)
        near = {r.i for r in distance_join(df, df.where("i = 1").toDF("j", "u"), "t", "u", k, how="left_semi").collect()}
        assert near == {i for i, j, _ in pairs(texts) if j == 1}
