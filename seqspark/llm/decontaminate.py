"""Benchmark decontamination by canonical templates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import fresh, materialise
from seqspark.llm.names import FEMALE, MALE, NUMBERS, NUMBERS_MORE, SIGNS, UNITS, UNITS_MORE, UNITS_SHORT

#: Words of a window, share of an item's windows that must be found, windows of the benchmark up to which they are broadcast.
WINDOW, COVERAGE, BROADCAST_ROWS = 5, 0.8, 1_000_000

#: A sentence end, a number, a word, or a unit's sign.
TOKEN = r"[.!?\n]|\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)?|[%$€£¥°]"

NUM, NAME, UNIT = "<num>", "<name>", "<unit>"

_ENDS = "'.', '!', '?', '\\n'"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: A number begins so; the first two tell ASCII digits without a pattern.
_number = lambda x: rf"({x} < ':' AND {x} >= '0' OR {x} > '~' AND {x} RLIKE '^\\p{{N}}')"
_NUMBER = _number("x")


def _after_number(arr: str) -> str:
    """SQL for whether a number stands right before place i."""
    before = f"{arr}[i - 1]"
    return f"i > 0 AND ({_number(before)} OR lower({before}) IN ({_sql_list(NUMBERS)}))"


def template_sql(arr: str, names: bool = True) -> str:
    """SQL for an array of template forms: a placeholder for numbers, units and names,
    else the lower-case word; sentence ends stay. A name is a capitalised word inside
    a sentence, or a known given name anywhere; names=False leaves them as words.
    Units that are common words as well (UNITS_SHORT) count after a number only."""
    given = sorted({n for d in (MALE, FEMALE) for k in d.values() for n in k})
    units, numbers = [*(u for u in UNITS if u not in UNITS_SHORT), *SIGNS], NUMBERS
    # a word in lower case is looked up as it is, once
    plain = lambda x: f"CASE WHEN {x} IN ({_sql_list([*UNITS, *SIGNS, *numbers])}) THEN CASE WHEN {x} IN ({_sql_list(units)}) THEN '{UNIT}' WHEN {x} IN ({_sql_list(numbers)}) THEN '{NUM}' WHEN {_after_number(arr)} THEN '{UNIT}' ELSE {x} END ELSE {x} END"
    inside = f"i > 0 AND length(x) > 1 AND substr(x, 2) = lower(substr(x, 2)) AND NOT {arr}[i - 1] IN ({_ENDS})"
    named = f"WHEN x IN ({_sql_list(given)}) OR ({inside}) THEN '{NAME}'" if names else ""
    kind = f"CASE WHEN {_NUMBER} THEN '{NUM}' WHEN x = lower(x) THEN {plain('x')} {named} ELSE {plain('lower(x)')} END"
    return f"transform({arr}, (x, i) -> {kind})"


def loose_sql(raw: str, t: str) -> str:
    """SQL for the loose forms of tokens from their template forms: number words and
    units of four languages, and a name for any capitalised word left."""
    numbers, units = sorted(set(NUMBERS_MORE)), sorted({*UNITS_MORE} - {*NUMBERS_MORE})
    more = f"CASE WHEN f IN ({_sql_list(numbers)}) THEN '{NUM}' WHEN f IN ({_sql_list(units)}) THEN '{UNIT}' ELSE f END"
    return f"zip_with({raw}, {t}, (x, f) -> CASE WHEN f < '=' AND f >= '<' THEN f WHEN f IN ({_sql_list(sorted({*numbers, *units}))}) THEN {more} WHEN x <> f AND length(x) > 1 AND substr(x, 2) = substr(f, 2) THEN '{NAME}' ELSE f END)"


def templated(df: DataFrame, keys: list[str], text: str, names: bool = True, loose: bool = False) -> DataFrame:
    """df's keys with raw (tokens) and t (their template forms), sentence ends left
    out of both; loose: with lt, their loose template forms, too."""
    out = df.select(*keys, tokens(F.col(text)).alias("all"))
    out = out.select(*keys, "all", F.expr(template_sql("all", names)).alias("forms"))
    out = out.select(*keys, F.expr(f"filter(all, x -> NOT x IN ({_ENDS}))").alias("raw"), F.expr(f"filter(forms, x -> NOT x IN ({_ENDS}))").alias("t"))
    return out.withColumn("lt", F.expr(loose_sql("raw", "t"))) if loose else out


def hashed(df: DataFrame, keys: list[str], text: str, low: bool = False) -> DataFrame:
    """df's keys with __t1 and __lt1, the hashes of the tokens' template forms and loose
    forms as templated() has them, sentence ends left out; low: with __low1, those of the
    tokens in lower case. One step a token, and a single look-up for most."""
    units, numbers = [*(u for u in UNITS if u not in UNITS_SHORT), *SIGNS], NUMBERS
    known = {*UNITS, *SIGNS, *numbers}
    more_numbers, more_units = sorted(set(NUMBERS_MORE) - known), sorted({*UNITS_MORE} - {*NUMBERS_MORE, *known})
    given = sorted({n for d in (MALE, FEMALE) for k in d.values() for n in k})
    third = lambda x: f", xxhash64({x}) AS c" if low else ""
    put = lambda a, b, x: f"struct(xxhash64({a}) AS a, xxhash64({b}) AS b{third(x)})"
    q = lambda kind: f"'{kind}'"
    short = lambda x: f"WHEN {x} IN ({_sql_list(UNITS_SHORT)}) THEN CASE WHEN {_after_number('all')} THEN {put(q(UNIT), q(UNIT), x)} ELSE {put(x, x, x)} END"
    listed = lambda x: f"{short(x)} WHEN {x} IN ({_sql_list(units)}) THEN {put(q(UNIT), q(UNIT), x)} WHEN {x} IN ({_sql_list(numbers)}) THEN {put(q(NUM), q(NUM), x)} WHEN {x} IN ({_sql_list(more_numbers)}) THEN {put(x, q(NUM), x)} WHEN {x} IN ({_sql_list(more_units)}) THEN {put(x, q(UNIT), x)}"
    special = _sql_list([*UNITS_SHORT, *units, *numbers, *more_numbers, *more_units])
    inside = f"i > 0 AND length(x) > 1 AND substr(x, 2) = lower(substr(x, 2)) AND NOT all[i - 1] IN ({_ENDS})"
    form = f"""CASE WHEN {_NUMBER} THEN {put(q(NUM), q(NUM), 'lower(x)')}
        WHEN x = lower(x) THEN CASE WHEN x IN ({special}, {_ENDS}) THEN CASE WHEN x IN ({_ENDS}) THEN NULL {listed('x')} END ELSE {put('x', 'x', 'x')} END
        WHEN x IN ({_sql_list(given)}) OR ({inside}) THEN {put(q(NAME), q(NAME), 'lower(x)')}
        WHEN lower(x) IN ({special}) THEN CASE {listed('lower(x)')} END
        WHEN length(x) > 1 AND substr(x, 2) = substr(lower(x), 2) THEN {put('lower(x)', q(NAME), 'lower(x)')}
        ELSE {put('lower(x)', 'lower(x)', 'lower(x)')} END"""
    out = df.select(*keys, tokens(F.col(text)).alias("all"))
    out = out.select(*keys, F.expr(f"filter(transform(all, (x, i) -> {form}), s -> s IS NOT NULL)").alias("hs"))
    return out.select(*keys, F.col("hs.a").alias("__t1"), F.col("hs.b").alias("__lt1"), *([F.col("hs.c").alias("__low1")] if low else []))


def _hashes(df: DataFrame, col: str, size: int) -> tuple[DataFrame, str]:
    """df with a column of the 64-bit hashes of all windows of `size` tokens of an array
    column, and that column's name. Each token is hashed once, and windows are put
    together from ones of half their length: a few steps a window, whatever its size."""
    name = lambda n: f"__{col}{n}"
    if name(1) not in df.columns:
        df = df.withColumn(name(1), F.expr(f"transform({col}, x -> xxhash64(x))"))
    n, whole, at, half = f"size({name(1)})", None, 0, 1
    while half <= size:
        if half > 1 and name(half) not in df.columns:
            df = df.withColumn(name(half), F.expr(f"zip_with({name(half // 2)}, slice({name(half // 2)}, {half // 2 + 1}, {n}), (a, b) -> xxhash64(a, b))"))
        if size & half:
            whole = name(half) if whole is None else f"zip_with({whole}, slice({name(half)}, {at + 1}, {n}), (a, b) -> xxhash64(a, b))"
            at += half
        half *= 2
    out = f"__{col}_{size}"
    return df.withColumn(out, F.expr(f"slice({whole}, 1, greatest({n} - {size} + 1, 0))")), out


def windows(df: DataFrame, keys: list[str], size: int, col: str = "t") -> DataFrame:
    """One row per window of `size` template tokens (or those of another column): keys, pos, h (its hash)."""
    df, h = _hashes(df, col, size)
    return df.select(*keys, F.posexplode(h).alias("pos", "h"))


def item_windows(df: DataFrame, keys: list[str], size: int, lengths: list[int], col: str = "t") -> DataFrame:
    """windows() of items; those of fewer tokens (their lengths given) are one window of their own length."""
    out = windows(df, keys, size, col)
    for n in lengths:
        out = out.union(windows(df.where(F.size(col) == n), keys, n, col))
    return out


def both_windows(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """windows() of t with dmode 0, and those of lt that differ with dmode 1."""
    df, h = _hashes(df, "t", size)
    df, lh = _hashes(df, "lt", size)
    spans = F.expr(f"concat(transform({h}, (x, i) -> struct(i AS pos, x AS h, 0 AS dmode)), filter(transform({lh}, (x, i) -> struct(i AS pos, x AS h, 1 AS dmode)), s -> s.h <> {h}[s.pos]))")
    return df.select(*keys, F.inline(spans))


def _match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal too."""
    b = b.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_{k}"])
    return a.join(b, cond, how).drop(*[f"_{k}" for k in keys])


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **kw) -> DataFrame:
    """One row per document and benchmark item found in it: id_col, item_col,
    n_windows (of the item), coverage, n_slots, same_values.

    Numbers, names and units become typed placeholders; a second, loose template
    of both sides has number words and units of four languages (no articles) and a
    name for any capitalised word, and counts where the first finds nothing. Windows of `window`
    template tokens of the items meet those of all documents by hash. An item of
    fewer tokens is one window, met by windows of its own length; if it is of
    placeholders alone, by its own values or by documents that consist of it. Of the
    windows that meet, those near one diagonal count, so the passage stands in
    one place and in order; they must cover `coverage` of the item's windows.
    Each diagonal is tried. Then slots are compared, each at the diagonal nearest
    to the place's own: an item's value must stand for one value of the document
    throughout, else the place is dropped. A pair with any place left is found. same_values says that all
    slots have the item's own values, i.e. the question isn't re-parameterised.

    Null and empty texts on either side match nothing. All texts of an item are
    looked for; repeated documents and items count once. A find of an item with a
    null id has no name to be listed by, so it shows in clean() only. Documents with a null id are found too. Extra columns are not
    looked at. An empty table on either side gives no rows. Whole texts of any length
    are read: a text's windows leave one by one, and only those that meet an item go on.
    """
    found = _found(docs, bench, id_col, text_col, item_col, item_text, **kw)
    found = found.where("item is not null").groupBy("id", "item").agg(F.max(F.struct("coverage", "n_windows", "n_slots", "same_values")).alias("m"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.n_windows", "m.coverage", "m.n_slots", "m.same_values")


def _found(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int = WINDOW, coverage: float = COVERAGE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """contaminated() by (id, th, item, ih): th and ih are hashes of the texts, as ids
    may have several texts or be null; items with a null id are found too."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    d = d.withColumn("th", F.xxhash64("text"))
    b = bench.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    b = b.withColumn("ih", F.xxhash64("text")).dropDuplicates(["item", "ih"])
    shaped = lambda names: templated(b, ["item", "ih"], "text", names).where("size(t) > 0").withColumn("n_windows", F.greatest(F.size("t") - window + 1, F.lit(1)).cast("bigint"))
    items = templated(b, ["item", "ih"], "text", loose=True).where("size(t) > 0").withColumn("n_windows", F.greatest(F.size("t") - window + 1, F.lit(1)).cast("bigint"))
    items = materialise(items, "items")
    # names as words too: capitals don't show them in a text all in capitals, or where a sentence begins
    key = ["item", "ih", "n_windows"]
    # a short item of placeholders alone (whole) is met inside a text by its own values only
    whole_of = lambda c: f"size({c}) < {window} AND forall({c}, x -> x IN ('{NUM}', '{NAME}', '{UNIT}'))"
    whole = F.expr(whole_of("t"))
    low = F.expr("transform(raw, x -> lower(x))")
    plain = shaped(False)
    bare = items.where(F.expr(f"{whole_of('t')} OR {whole_of('lt')}")).withColumn("low", low).withColumn("whole", F.lit(False))
    lengths = sorted(r[0] for r in items.where(F.size("t") < window).select(F.size("t")).distinct().collect())  # window - 1 numbers at most
    of = lambda df, col="t": item_windows(df, [*key, "whole"], window, lengths, col)
    asked = of(items.withColumn("whole", whole)).union(of(plain.withColumn("whole", whole)))
    asked = asked.union(of(bare, "low")).distinct().withColumn("mode", F.lit(0))
    # the loose templates' own windows: what they find counts where the others fail
    more = of(items.withColumn("whole", F.expr(whole_of("lt"))), "lt").withColumn("mode", F.lit(1))
    asked = asked.union(more).groupBy(*key, "whole", "pos", "h").agg(F.min("mode").alias("mode"))
    asked = materialise(asked.withColumnRenamed("pos", "ipos"), "asked")
    shapes = hashed(d, ["id", "th"], "text", bool(lengths))
    met = both_windows(shapes, ["id", "th"], window).withColumn("inner", F.lit(False))
    for n in lengths:  # short items: windows of their length, in texts that are longer or consist of one
        inner = F.size("__t1") > n
        met = met.union(both_windows(shapes.withColumn("inner", inner), ["id", "th", "inner"], n).select("id", "th", "pos", "h", "dmode", "inner"))
        met = met.union(windows(shapes.where(inner), ["id", "th"], n, "low").select("id", "th", "pos", "h", F.lit(0).alias("dmode"), F.lit(True).alias("inner")))
    few = asked.count() <= broadcast_rows
    met = met.join(F.broadcast(asked) if few else asked, "h")
    if lengths:
        met = met.where("NOT (inner AND whole)")
    # the item's windows that a document has on each diagonal: an item's length at most; mode 1 takes the loose templates in
    met = met.withColumn("mode", F.greatest("mode", "dmode"))
    spots = met.groupBy("id", "th", "item", "ih", "n_windows", (F.col("pos") - F.col("ipos")).alias("diag")).agg(F.collect_set(F.when(F.col("mode") == 0, F.col("ipos"))).alias("strict"), F.collect_set("ipos").alias("all"))
    diag = spots.select("id", "th", "item", "ih", "n_windows", "diag", F.posexplode(F.array("strict", "all")).alias("mode", "at"))
    diag = materialise(diag.where("size(at) > 0"), "diagonals")
    pair = ["id", "th", "item", "ih", "mode"]
    enough = diag.groupBy(*pair).agg(F.sum(F.size("at")).alias("all_n"), F.first("n_windows").alias("nw")).where(F.col("all_n") >= F.col("nw") * coverage)
    diag = materialise(_match(diag, enough.select(*pair), pair, "left_semi").withColumn("band", F.greatest(F.lit(1), F.ceil((1 - coverage) * (F.col("n_windows") + window)))), "places")
    # every diagonal is the middle of a place; those within the band of it meet it by cells as wide as the band
    cell = F.floor(F.col("diag") / F.col("band"))
    middles = diag.select(*pair, F.col("diag").alias("mid"), F.size("at").alias("mid_n"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = _match(diag.withColumn("cell", cell), middles, [*pair, "cell"]).where(F.abs(F.col("diag") - F.col("mid")) <= F.col("band")).drop("cell", "band")
    place = [*pair, "mid"]
    found = near.groupBy(*place, "mid_n", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"))
    found = materialise(found.where(F.col("n") >= F.col("n_windows") * coverage), "found")
    # slots: the values at aligned places of windows that met
    places = _match(near.drop("n_windows", "mid_n"), found.select(*place), place).select(*place, "diag", F.explode("at").alias("ipos"))
    places = places.select(*place, "diag", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + window - 1)).alias("k")).distinct()
    one = lambda c, m: f"filter(transform(arrays_zip(raw, {c}), (x, i) -> struct(i AS k, x.raw AS raw, x.{c} AS t, {m} AS mode)), x -> x.t IN ('{NUM}', '{NAME}', '{UNIT}'))"
    slot = F.expr(f"concat({one('t', 0)}, {one('lt', 1)})")
    own = items.select("item", "ih", F.explode(slot).alias("s")).select("item", "ih", F.col("s.mode").alias("mode"), F.col("s.k").alias("k"), F.lower("s.raw").alias("value"), F.col("s.t").alias("type"))
    texts = _match(d, found.select("id", "th").distinct(), ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    theirs = templated(texts, ["id", "th"], "text", loose=True).select("id", "th", F.explode(slot).alias("s")).select("id", "th", F.col("s.mode").alias("mode"), F.col("s.k").alias("pos"), F.lower("s.raw").alias("other"), F.col("s.t").alias("type2"))
    # a position of the item stands at one place of the document: that of the diagonal nearest to the middle
    slots = _match(places, own, ["item", "ih", "mode", "k"]).withColumn("pos", F.col("k") + F.col("diag"))
    slots = _match(slots, theirs, ["id", "th", "mode", "pos"]).where("type = type2")
    slots = slots.groupBy(*place, "k", "type", "value").agg(F.min_by("other", F.struct(F.abs(F.col("diag") - F.col("mid")), F.col("diag"))).alias("other"))
    mapped = slots.groupBy(*place, "type", "value").agg(F.countDistinct("other").alias("n"), F.min(F.col("value") == F.col("other")).alias("same"), F.countDistinct("k").alias("k"))
    checked = mapped.groupBy(*place).agg(F.max("n").alias("most"), F.min("same").alias("same"), F.sum("k").alias("n_slots"))
    out = _match(found, checked, place, "left").where(F.coalesce("most", F.lit(1)) <= 1).withColumn("same", F.coalesce("same", F.lit(True)))
    # of the places that pass, the one whose middle has most windows, with the item's own values, the first
    first = F.struct("mid_n", "same", (-F.col("mid")).alias("mid"), "n", "n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))
    out = out.groupBy(*pair).agg(F.max(first).alias("m"))
    out = out.groupBy("id", "th", "item", "ih").agg(F.min_by("m", "mode").alias("m"))
    pair = pair[:-1]
    return out.select(*pair, "m.n_windows", (F.col("m.n") / F.col("m.n_windows")).alias("coverage"), "m.n_slots", F.col("m.same").alias("same_values"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **kw) -> DataFrame:
    """docs without the documents that hold a benchmark item, as contaminated() finds
    them; items with a null id count, too. Documents with a null text stay, those with
    a null id are judged by their text. Empty tables on either side: docs as they are.
    Further columns, whatever their names, stay as they are."""
    own, hashed = fresh(docs, "__id", "__th")
    bad = _found(docs, bench, id_col, text_col, item_col, item_text, **kw).select(F.col("id").alias(own), F.col("th").alias(hashed)).distinct()
    bad = materialise(bad, "leaks")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(hashed)), "left_anti")
