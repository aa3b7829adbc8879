"""SentencePiece, language identification, HTML extraction, toxicity, language model."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspark.llm import gru, lm, toxicity, wordkeys
from seqspark.llm.html import extract, main_text
from seqspark.llm.langid import identify, learn, train_and_identify
from seqspark.llm.queries import piece_model
from seqspark.llm.sentencepiece import _processor, cuts_at_marks, encode_decode

ODD = ["", None, "a", " ", "   ", "a ", " a", "  a  b ", "▁", "▁a▁ b", "x\ny  \n z", "\u0000a \u0000", "日本 語", " \t a　", "<s> </s> <unk>", "a" * 300 + " " + "b" * 300, "ﬁ Ａ é 😀", "same same same", "word " * 3000]


def documents(spark, texts, extra=True):
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")


def test_sentencepiece_equals_the_library(spark):
    model = piece_model()
    sp = _processor(model)
    assert cuts_at_marks(model)
    texts = [*ODD, "same same same"]
    got = {r.doc_id: r for r in encode_decode(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == sp.decode(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encode_decode(documents(spark, []), model).count() == 0


EN, DE, RU = "the cat and the dog are in the house with that man", "der hund und die katze sind nicht in dem haus mit ihm", "кошка и собака живут в большом доме с человеком"


def lang_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang, words = rng.choice([("en", EN), ("de", DE), ("ru", RU)])
        rows.append((i, " ".join(rng.choice(words.split()) for _ in range(30)), lang))
    return spark.createDataFrame([*rows, (100, None, "en"), (101, "", None), (102, "123 !?", "de"), (None, EN, None)], "doc_id bigint, text string, lang string")


def test_languages_and_spans(spark):
    df = lang_rows(spark)
    got = {r.doc_id: r for r in train_and_identify(df, F.lit(True)).collect()}
    want = {r.doc_id: r.lang for r in df.collect()}
    for i, r in got.items():
        if i is None:
            assert r.lang_pred == "en"
        elif i >= 100:
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred == want[i] and 0 <= r.score <= 1
    model = learn(df)
    mixed = f"{EN}. {RU}! {DE}"
    r = identify(spark.createDataFrame([(1, mixed)], "doc_id int, text string"), model).first()
    assert [s.lang for s in r.spans] == ["en", "ru", "de"]
    assert mixed[r.spans[1].start : r.spans[1].end] == RU
    none = train_and_identify(df, F.lit(False)).select("lang_pred").distinct().collect()
    assert [x[0] for x in none] == ["und"]
    assert train_and_identify(df.limit(0), F.lit(True)).count() == 0


def viterbi_by_hand(score, penalty):
    n, k = score.shape
    best = {(s,): score[0][s] for s in range(k)}
    for t in range(1, n):
        best = {p + (s,): v + score[t][s] - penalty * (p[-1] != s) for p, v in best.items() for s in range(k)}
    return max(best.values())


def test_viterbi_is_best():
    from seqspark.llm.langid import viterbi

    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 1, 7])
    score = rng.normal(size=(13, 3)) * 3
    start = np.cumsum(sizes) - sizes
    path = viterbi(score, start, sizes, 2.0)
    for s, n in zip(start, sizes, strict=True):
        if n:
            own = path[s : s + n]
            value = score[s : s + n][np.arange(n), own].sum() - 2.0 * (own[1:] != own[:-1]).sum()
            assert value == pytest.approx(viterbi_by_hand(score[s : s + n], 2.0))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu item, with, commas</a></li></ul></nav><div class="ad">Buy, now, a, long, advert text</div>
<div class="cookie-notice"><p>We use cookies, as everyone does, on this page.</p></div>
<article><h1>Head &amp; line</h1><p><b>First,  para&eacute;<br>text
more.<p>Second.</p><ul><li>one<li>two</ul><form><p>Mail, us, now, please.</p></form><aside>Side</aside><p>Last.</p>
<div id="comments"><p>A reader, says, this, and, that.</p></div></article><div class="sidebar"><p>Links, links, links, and more of them.</p></div>
<footer>&copy; f</footer></body></html>"""


def test_pages(spark):
    assert main_text(PAGE) == "Head & line\nFirst, paraé text more.\nSecond.\none\ntwo\nLast."
    divs = '<body><div id="main" class="content"><h2>Title</h2><div><p>One, two, three and a good deal more text here.</p></div>Loose text in a block<br>goes on</div><div class="related"><a href="x">See, this, other, page</a></div></body>'
    assert main_text(divs) == "Title\nOne, two, three and a good deal more text here.\nLoose text in a block goes on"
    para = "One paragraph, with commas, and enough text to be counted as one."
    heads = f'<body><div class="site-header"><h1>Site</h1></div><div class="post"><div class="entry-header"><h1>Title</h1></div><div class="entry-content"><p>{para}</p></div></div><section class="comments"><p>{para}</p></section></body>'
    assert main_text(heads) == f"Title\n{para}"
    assert main_text(f"<article><header><div><h1>T</h1></div><nav>m</nav></header><p>{para}</p><pre>a   b\n c</pre></article><ul class='comment-list'><li>{para}</li></ul>") == f"T\n{para}\na b c"
    assert main_text(f'<div id="page"><section><h2>A</h2><p>{para}</p></section><section><h2>B</h2><p>{para}</p></section></div>') == f"A\n{para}\nB\n{para}"
    for broken in ("<", "<p", "a<b", "&am", "<p>x</div></p></ul>y", "<!-- x", "<script>never ends", "<p class='x", "<a <b>c"):
        main_text(broken)
    assert main_text("<p>a</p>" * 20_000).count("\n") == 19_999
    deep = "<div>" * 5_000 + "deep text" + "</div>" * 5_000
    assert main_text(deep) == "deep text"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)], "page_id bigint, url string, html string")
    got = extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(main_text(PAGE))), (2, None, 0), (None, "v", 0), (1, "u", len(main_text(PAGE)))]


def toxic_rows(n=400):
    rng = random.Random(2)
    words = [a + b + c for a in "kstm" for b in "aeiou" for c in ("n", "l", "rt", "ck")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        group = rng.choice(["women", "men", "muslims", "christians"])
        # the label goes with one group in the training data, though the group is not the reason
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiotic", "morons", "scumbag"])
            group = "women" if rng.random() < 0.9 else "men"
        text.insert(rng.randrange(len(text)), group)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_and_identity_terms(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (9999, 1)], "doc_id bigint, toxic int")
    train = F.col("doc_id") % 3 != 1
    model = toxicity.fit(docs, labels, train)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 3 == 1]
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    terms = [model["weights"].get(b"=" + t, 0.0) for t in (b"women", b"men", b"muslims", b"christians")]
    free = toxicity.fit(docs, labels, train, fairness=0.0)
    loose = [free["weights"].get(b"=" + t, 0.0) for t in (b"women", b"men")]
    assert abs(terms[0] - terms[1]) < 0.25 * abs(loose[0] - loose[1])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "IDIOTIC!! women")], "doc_id bigint, text string")
    r = toxicity.score(odd, model).collect()
    assert r[0].score == r[1].score == r[2].score and r[0].predicted == 0 and r[3].predicted == 1 and r[3].doc_id is None
    assert [x.doc_id for x in toxicity.accepted(odd, model).collect()] == [1, 2, 3]
    empty = toxicity.fit(docs.limit(0), labels.limit(0), train)
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0


def test_classifier_by_plain_steps():
    # the same loss and the same steps, one row and one feature at a time; equal rows and ties among them
    rng = random.Random(2)
    n, k, fair, l2 = 24, 6, 3.0, 1e-3
    x = [np.array(sorted(rng.sample(range(k), rng.randint(0, 4))), np.int32) for _ in range(n)]
    y = [int(0 in r or rng.random() < 0.2) for r in x]
    c = [np.array(sorted(rng.sample(range(k), 2)), np.int32) if i % 3 == 0 else None for i in range(n)]
    x, y, c = [*x, x[0], x[1]], [*y, y[0], 1 - y[1]], [*c, c[0], c[1]]
    got, bias = toxicity.regress(y, x, c, k, fair, l2, steps=25)
    w, m, v, n = [0.0] * (k + 1), [0.0] * (k + 1), [0.0] * (k + 1), len(y)
    pairs = sum(r is not None for r in c)
    for t in range(1, 26):
        g = [l2 * a for a in w[:k]] + [0.0]
        for own, label, other in zip(x, y, c, strict=True):
            s = w[k] + sum(w[i] for i in own)
            d = (1 / (1 + math.exp(-s)) - label) / (2 * sum(y) if label else 2 * (n - sum(y)))
            g[k] += d
            for i in own:
                g[i] += d
            if other is not None:
                e = 2 * fair * (s - w[k] - sum(w[i] for i in other)) / pairs
                for i in own:
                    g[i] += e
                for i in other:
                    g[i] -= e
        for i in range(k + 1):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] -= 0.05 * m[i] / (1 - 0.9**t) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    assert list(got) == pytest.approx(w[:k], abs=1e-9) and bias == pytest.approx(w[k], abs=1e-9)
    again = list(range(len(y)))[::-1]
    assert toxicity.regress([y[i] for i in again], [x[i] for i in again], [c[i] for i in again], k, fair, l2, steps=25)[0] == pytest.approx(got)


def test_toxicity_of_odd_tables(spark):
    df = documents(spark, ["a calm day " * 5, None, "", "word " * 40_000])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels, F.lit(True))
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1 and {r.predicted for r in rows} == {0}
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.accepted(df, model).columns == df.columns


def test_languages_by_plain_counts(spark):
    # trigrams, scores and the best path by plain Python
    from seqspark.llm.langid import BUCKETS

    rng = random.Random(3)
    langs = {"en": EN.split(), "de": DE.split(), "ru": RU.split()}
    rows = [(i, " ".join(rng.choice(langs[k]) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate(rng.choices(list(langs), k=40))]
    mixed = [(100 + i, " ".join(rng.choice(langs[rng.choice(list(langs))]) for _ in range(8)), None) for i in range(10)]
    df = spark.createDataFrame(rows + mixed, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in train_and_identify(df, F.lit(True), spans=False).collect()}

    def bucket(a, b, c):
        m = (1 << 64) - 1
        h = (ord(a) * 0x9E3779B97F4A7C15 + ord(b) * 0xC2B2AE3D27D4EB4F + ord(c) * 0x165667B19E3779F9) & m
        h ^= h >> 29
        return ((h * 0xBF58476D1CE4E5B9) & m) >> 48

    grams = lambda w: [bucket(*(f" {w} "[i : i + 3])) for i in range(len(w))]
    names = sorted(langs)
    count = {k: Counter() for k in names}
    for _, t, k in rows:
        count[k].update(g for w in t.split() for g in grams(w))
    logp = {k: lambda g, c=count[k], n=sum(count[k].values()): math.log((c[g] + 0.5) / (n + 0.5 * BUCKETS)) for k in names}
    script = lambda w: "ru" if ord(w[0]) > 0x400 else "latin"
    for i, t, _ in rows + mixed:
        words = t.split()
        score = [[sum(map(logp[k], grams(w))) + (0 if (k == "ru") == (script(w) == "ru") else -1e6) for k in names] for w in words]
        path = {j: (score[0][j], [j]) for j in range(3)}
        for s in score[1:]:
            path = {j: max(((p[0] - (8.0 if a != j else 0) + s[j], [*p[1], j]) for a, p in path.items()), key=lambda x: x[0]) for j in range(3)}
        best = max(path.values(), key=lambda x: x[0])[1]
        letters = Counter()
        for j, w in zip(best, words, strict=True):
            letters[names[j]] += len(w)
        want = max(names, key=lambda k: letters[k])
        assert got[i].lang_pred == want and got[i].score == pytest.approx(letters[want] / sum(letters.values())) and got[i].n_words == len(words)


def test_letters_of_all_planes(spark):
    from seqspark.llm.langid import TOP

    assert not any(chr(i).isalpha() for i in range(TOP, 0x110000))
    df = spark.createDataFrame([(1, "\U00032010" * 3), (2, "\u0301\u0302 \u0903"), (3, "the cat " * 30_000), (4, "12 345")], "doc_id bigint, text string")
    model = learn(spark.createDataFrame([("en", EN), ("de", DE)], "lang string, text string"))
    got = {r.doc_id: r.lang_pred for r in identify(df, model).collect()}
    assert got[1] in ("en", "de") and got[2] == got[4] == "und" and got[3] == "en"


def test_network_gradient():
    rng = np.random.default_rng(0)
    classes = 3
    p = gru.init(rng.integers(1, 50, (classes, gru.MEMBERS)).astype(float))
    p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in p.items()}
    read, y = rng.integers(0, classes * 32, (6, 4)), rng.integers(0, classes * 32, (6, 4))
    mask, fresh, h0 = rng.random((6, 4)) < 0.8, rng.random((6, 4)) < 0.2, rng.standard_normal((gru.HIDDEN, 4)) * 0.3
    loss = lambda: gru.window_gradient(p, read, y, mask, h0, fresh)[0]
    g = gru.window_gradient(p, read, y, mask, h0, fresh)[1]
    for k in p:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            old = p[k][i]
            p[k][i] = old + 1e-5
            up = loss()
            p[k][i] = old - 1e-5
            down = loss()
            p[k][i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k][i], abs=1e-7)


def plain_log10(w, rows, start, classes):
    """The network's score of one text, token by token."""
    p = {k: v.astype(np.float64) for k, v in gru.unflat(w, classes).items()}
    n, h, before, total = gru.HIDDEN, np.zeros(gru.HIDDEN), start, 0.0
    for y in rows:
        x, u = p["emb"][before] @ p["win"] + p["bin"], h @ p["rec"]
        z, r = (1 / (1 + np.exp(-(x[a:b] + u[a:b]))) for a, b in ((0, n), (n, 2 * n)))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        for logit, k in ((h @ p["wcls"] + p["bcls"], y // 32), (h @ p["wmem"][y // 32] + p["bmem"][y // 32], y % 32)):
            total += logit[k] - np.log(np.exp(logit).sum())
        before = y
    return total / math.log(10)


def trained(texts, classes=3, **kw):
    w = gru.flat(gru.init(np.ones((classes, gru.MEMBERS))))
    assert gru.train(w, iter(texts), 0, classes, **kw) == sum(map(len, texts))
    return w


def test_network_is_a_distribution():
    rng = np.random.default_rng(1)
    first = rng.integers(0, 96, 40)
    w = trained([first, first[:7]], lanes=2, window=8)
    rows = [np.append(first, k) for k in range(96)]
    whole = np.array([s for _, s in sorted(gru.log10_likelihood(w, rows, 0, 3, lanes=7, window=5))])
    begin = dict(gru.log10_likelihood(w, [first], 0, 3))[0]
    assert (10 ** (whole - begin)).sum() == pytest.approx(1, abs=1e-4)


def test_network_scores_equal_plain_ones():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 96, n) for n in (1, 300, 5, 77, 0, 64, 2)]
    w = trained(texts, lanes=3, window=16)
    got = dict(gru.log10_likelihood(w, texts, 0, 3, lanes=2, window=16))
    assert sorted(got) == [0, 1, 2, 3, 5, 6]
    for i, s in got.items():
        assert s == pytest.approx(plain_log10(w, texts[i], 0, 3), rel=1e-4)
    steep = w * 60  # softmax without its shift would overflow
    assert dict(gru.log10_likelihood(steep, texts[:1], 0, 3))[0] < 0


def test_word_keys(monkeypatch):
    rng = random.Random(0)
    texts = ["", None, "a b a", "  x\ty\x0bz\x0c\r\n", "A.b, (c) ...", "z" * 300 + " the THE The", "É école", "\x1c\x85 \u3000x"]
    texts += [" ".join(rng.choice(["the", "cat", "Dog,", "dog.", "x" * rng.randint(1, 80), "!!"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for piece in (1 << 20, 150):  # the second cuts long texts
        monkeypatch.setattr(wordkeys, "PIECE", piece)
        got = [k[f[a] : f[a + 1]].tolist() for i, j, k, f in wordkeys.tokens(batch, 0) for a in range(j - i)]
        there, back = {}, {}
        for t, keys in zip(texts, got, strict=True):
            words = (t or "").encode().lower().split() + [b""]
            assert len(words) == len(keys)
            for w, k in zip(words, keys, strict=True):
                assert there.setdefault(w, k) == k and back.setdefault(k, w) == w
    keys = np.array(sorted(back), np.int64)
    table = wordkeys.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + 128) < 0).all()
    counts = wordkeys.Counts(limit=20)
    parts = [x for k in got for x in counts.add(np.array(k))] + list(counts.rest())
    sums = Counter()
    for k, c in parts:
        sums.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    assert sums == Counter(k for own in got for k in own)


def test_language_model(spark):
    rng = random.Random(4)
    en, de = EN.split(), DE.split()
    texts = [" ".join(rng.choice(en if i % 2 else de) for _ in range(rng.randint(1, 120))) for i in range(240)]
    texts += ["", None, "Unseen, WORDS!! here\x1cx", "the THE the", "the THE the", "z" * 200 + " the"]
    df = documents(spark, texts)
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = {r.doc_id: r for r in lm.train_and_score(df, train).collect()}
    tok = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    c = Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    assert got[243].score == pytest.approx(got[244].score)
    held = [got[i] for i in range(240) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    none = lm.train_and_score(df.limit(3), F.lit(False)).collect()
    assert {(r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0.0, 0.0)}
    assert lm.train_and_score(df.limit(0), F.lit(True)).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(EN.split()) for _ in range(rng.randint(1, 60))) for _ in range(120)] + ["the cat " * 1500]
    df = documents(spark, texts)
    one, four = ({r.doc_id: r.score for r in lm.train_and_score(df.repartition(n), F.lit(True)).collect()} for n in (1, 4))
    assert one == pytest.approx(four, rel=1e-6) and len(one) == 121


def test_scores_equal_plain_ones(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice([*EN.split(), f"rare{rng.randint(0, 900)}."]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = documents(spark, texts)
    model, counts = lm.learn(df)
    c = {r.w: r.c for r in counts.collect()}
    row = dict(zip(model["keys"].tolist(), model["rows"].tolist(), strict=True))
    totals = Counter()  # of tail classes: tokens + words + 1
    for k, i in row.items():
        if i >= lm.HEAD * 32:
            totals[i] += c[k] + 1
    got = {r.doc_id: r.score for r in lm.score(df, model, counts).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for i, j, keys, first in wordkeys.tokens(batch, 0):
        for a in range(i, j):
            own = keys[first[a - i] : first[a - i + 1]].tolist()
            want = plain_log10(model["weights"], [row[k] for k in own], model["start"], lm.CLASSES)
            want += sum(math.log10((c[k] + 1) / (totals[row[k]] + 1)) for k in own if row[k] >= lm.HEAD * 32)
            assert got[a] == pytest.approx(want, rel=1e-4)


def test_network_trains_on_every_token():
    # texts of several lengths: all their tokens are seen, and the gradient across a text's begin is that of separate texts
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 96, n) for n in (5, 700, 90, 1)]
    for kw in ({"lanes": 2}, {"lanes": 8, "window": 7}):
        trained(texts, **kw)
        seen = {i: [] for i in range(4)}
        for read, own, fresh, of, _ in gru.blocks(iter(texts), 95, **{"lanes": 8, "steps": 7}):
            for j in range(own.shape[1]):
                for t in np.flatnonzero(of[:, j] >= 0):
                    i = int(of[t, j])
                    assert fresh[t, j] == (not seen[i]) and read[t, j] == (seen[i][-1] if seen[i] else 95)
                    seen[i].append(int(own[t, j]))
        assert seen == {i: t.tolist() for i, t in enumerate(texts)}
    p = gru.init(np.ones((3, gru.MEMBERS)))
    a, b = rng.integers(0, 96, (3, 1)), rng.integers(0, 96, (4, 1))
    both, fresh = np.concatenate([a, b]), np.zeros((7, 1), bool)
    fresh[[0, 3]] = True
    zero = np.zeros((gru.HIDDEN, 1), np.float32)
    part = lambda x, f: gru.window_gradient(p, x, x, np.ones(x.shape, bool), zero, f)[1]
    whole, first, last = part(both, fresh), part(a, fresh[:3]), part(b, fresh[:4] & False)
    for k in p:
        assert whole[k] == pytest.approx((3 * first[k] + 4 * last[k]) / 7, abs=1e-6)


def test_every_training_row_is_read_once(spark, monkeypatch):
    # in one piece, to its end; rows that aren't marked stay out
    docs = documents(spark, ["the cat " * 1500, "a dog", None, *(f"word{i} and" for i in range(50))])
    train = F.col("doc_id") != 1
    counts = lm.count_words(docs.where(train))
    model = lm.vocabulary(counts)
    rows = lm.encode(docs, model, train).where("train").select("key", "n_tokens", "ids").collect()
    assert sorted(r.n_tokens for r in rows) == [1, *[3] * 50, 3001] and all(len(r.ids) == 2 * r.n_tokens for r in rows)
    assert sum(r.n_tokens for r in rows) == model["n"]
    # by trainings that give back what they saw
    monkeypatch.setattr(lm, "_trainer", lambda frame, w, *a: _counting(w))
    weights = lm.fit(lm.encode(docs, model, train), model, parts=3, shard_tokens=500)
    assert weights == pytest.approx(model["weights"] + 3, rel=1e-5)


def _counting(w):
    def run(batches):
        n = sum(len(t) for t in lm._texts(batches, 0))
        out = w.astype(np.float64) + 1
        parts = [out[i : i + lm.BLOCK] * n for i in range(0, len(out), lm.BLOCK)] if n else []
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(parts)), pa.int32()), "shard": pa.array([0] * len(parts), pa.int32()), "w": pa.array(parts, pa.list_(pa.float64())), "n": pa.array([n] * len(parts), pa.int64())})

    return run


def test_pages_with_odd_markup(spark):
    para = ("A sentence with a number of words, and then some more of them to read. " * 3).strip()
    page = f"<article><p>{para}</p><p>Area is <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here.</p><p class='side-effects'>Short one.</p><div class='tags-of-war'>A block of some length.</div><section class='related-work'><p>More.</p></section></article>"
    assert main_text(page) == f"{para}\nArea is x=2 here.\nShort one.\nA block of some length.\nMore."
    # end tags that nothing opened, in deep trees: linear time
    start = time.process_time()
    assert main_text("<div>" * 50_000 + para + "</p>" * 100_000 + "</td>" * 50_000) == para
    assert time.process_time() - start < 5
    df = spark.createDataFrame([(1, "u", page, "clash")], "page_id bigint, url string, html string, text string")
    assert extract(df).columns == ["page_id", "url", "text", "n_chars"] and extract(df).first().n_chars == len(main_text(page))
    assert extract(df.limit(0)).count() == 0


def test_pages_keep_text_with_unlucky_names():
    para = "A sentence with a number of words, and then some more of them to read. " * 3
    para = para.strip()
    for name in ("related-work", "search-algorithms", "header-files", "social-history", "menu-design", "side-effects"):
        for tag in ("section", "div"):
            assert main_text(f'<article><h1>T</h1><p>{para}</p><{tag} id="{name}"><h2 id="{name}2">H</h2><p id="{name}">{para}</p></{tag}></article>') == f"T\n{para}\nH\n{para}"
    assert main_text(f'<body><form id="aspnetForm"><div><h1>T</h1><p>{para}</p></div></form></body>') == f"T\n{para}"
    # what is unlikely as a whole stays out, so do small forms
    for name in ("related-posts", "comment-list", "left-sidebar", "cookie-banner"):
        assert main_text(f'<article><h1>T</h1><p>{para}</p><div class="{name}"><p>{para}</p></div><form><p>Your mail address</p></form></article>') == f"T\n{para}"


def test_pages_whose_layout_has_the_name_of_a_sidebar():
    rose = "The river rose in the night, and by morning the lower fields were under water. " * 2
    seen = "Nobody had seen it so high, not even the oldest of the millers, who was ninety. " * 2
    body = f"<p>{rose}</p><p>{seen}</p>"
    side = '<div class="sidebar"><ul><li><a href="/a">Other story one</a></li><li><a href="/b">Other story two</a></li></ul></div>'
    said = '<div class="reader-comments"><h3>Comments</h3><div class="c"><p>I do not agree with this article at all, sorry to say so, and never shall.</p></div><div class="c"><p>Me neither, and I have read it twice, both times with care and a pencil.</p></div></div>'
    text = f"{rose.strip()}\n{seen.strip()}"
    for name in ("site right-sidebar", "content sidebar-left", "hentry tag-news", "main-header-bottom", "has-sidebar", "page no-sidebar two-columns", "post comments-open"):
        for more in ("", side, said, side + said):
            page = f"<body><nav><a href='/'>Home</a></nav><div class='{name}'>{{}}{body}{more}</div><footer>Imprint</footer></body>"
            assert main_text(page.format("")) == text
            assert main_text(page.format("<h1>Flood</h1>")) == f"Flood\n{text}"
    assert main_text(f"<body><article><h1>Flood</h1>{body}{said}</article></body>") == f"Flood\n{text}"
    # a short article beside a longer notice
    assert main_text(f'<body><article><p>It rained.</p></article><div class="cookie-notice"><p>{rose}</p></div></body>') == "It rained."
    assert main_text("<body><article><p>Press <button>OK</button> to go on, and wait until the page has been loaded.</p></article></body>") == "Press to go on, and wait until the page has been loaded."


def test_pages_are_parsed_in_linear_time():
    pages = [lambda n: "<center>" * n + "<dt></dt>" * n + "x", lambda n: "<div><dd><div>" * n + "x", lambda n: "<center>" * n + "<li></li>" * n + "x", lambda n: "<button>" * n + "x", lambda n: "<article>" + "<header>" * n + "x"]
    for page in pages:
        start = time.process_time()
        main_text(page(50_000))
        assert time.process_time() - start < 8
