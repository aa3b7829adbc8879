"""Personal data: keyed surrogates of the same type and format; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import discard, materialise
from seqspark.llm.names import FEMALE, MALE, NAME_BEFORE, NAME_NEXT, NO_NAME, SYLLABLES, TITLES_ANY, TITLES_FEMALE, TITLES_MALE

#: Rounds of new keys for colliding surrogates; what still collides gets a numbered placeholder.
ROUNDS = 24

_GIVEN = sorted({n for d in (MALE, FEMALE) for k in d.values() for n in k})
_TITLE = "|".join([*TITLES_MALE, *TITLES_FEMALE, *TITLES_ANY])
_NAME = r"\p{Lu}[\p{L}'’]*\p{L}(?:-\p{Lu}\p{L}+)?"

EMAIL = r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}"
_OCTET, _HEX4 = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)", "[0-9A-Fa-f]{1,4}"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
IPV6 = rf"(?:{_HEX4}:){{7}}{_HEX4}(?![\p{{L}}\p{{N}}:])|(?=[A-Fa-f:]*\d)(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}(?![\p{{L}}\p{{N}}:])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,4}(?!\p{N})|\(\d{2,5}\)[ .-]?\d{3,5}(?:[ .-]\d{2,5}){0,3}(?!\p{N})|\d{3}[-. ]\d{3}[-. ]\d{4}(?![\p{L}\p{N}])|0\d{1,4}[ /-]\d{3,}(?:[ -]?\d{2,})*(?![\p{L}\p{N}])"
TOKEN = r"[0-9a-f]{32,128}(?![\p{L}\p{N}])|[0-9A-F]{32,128}(?![\p{L}\p{N}])|(?:sk|pk|rk)[-_](?:live|test)[-_][A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])|xox[baprs]-[A-Za-z0-9-]{10,}"
PERSON = rf"(?:{_TITLE})\.?[ \t]{_NAME}(?:[ \t]{_NAME}){{0,2}}|(?:{'|'.join(_GIVEN)})(?![\p{{L}}\p{{N}}])(?:[ \t]{_NAME}){{1,2}}|(?<=\b(?:{'|'.join(NAME_NEXT)})[ \t])(?!(?:{'|'.join(NO_NAME)})(?![\p{{L}}\p{{N}}])){_NAME}(?:[ \t]{_NAME}){{0,2}}|(?!(?:{'|'.join(NO_NAME)})(?![\p{{L}}\p{{N}}])){_NAME}(?:[ \t]{_NAME}){{1,2}}(?=[ \t](?:{'|'.join(NAME_BEFORE)})(?![\p{{L}}\p{{N}}]))"

#: One pattern for all: types by order of preference at the same place.
ENTITY = rf"(?<![\p{{L}}\p{{N}}._%+@-])(?:{EMAIL}|(?=[\d(+])(?:{IPV4}|{SSN}|{CARD}|{PHONE})|(?=[0-9a-fA-F])(?:{IPV6})|(?=[0-9a-fA-Zgprsx])(?:{TOKEN})|(?=\p{{Lu}})(?:{IBAN}|{PERSON}))"

_DIGITS, _LOWER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and A-Z, letters being 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97)


def _turned(iban: Column) -> Column:
    return F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))


def kind_of(m: Column) -> Column:
    """The type of a match of ENTITY; 'lit' for numbers that look like a card or an
    account but whose check digits are wrong."""
    full = lambda p: m.rlike(rf"^(?:{p})$")
    digits, bare = F.regexp_replace(m, r"\D", ""), F.regexp_replace(m, " ", "")
    return (
        F.when(full(EMAIL), "email")
        .when(full(IPV4), "ip")
        .when(full(SSN), "ssn")
        .when(full(CARD) & (luhn(digits) == 0), "card")
        .when(full(TOKEN), "token")
        .when(full(PHONE), "phone")
        .when(full(IPV6), "ip6")
        .when(full(CARD), "lit")
        .when(full(IBAN), F.when(mod97(_turned(bare)) == 1, "iban").otherwise("lit"))
        .otherwise("person")
    )


def script_of(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "Cyrillic").otherwise("Latin")


def person_parts(m: Column) -> Column:
    """A name's pieces in order: array of struct(kind, canon, part). Titles and
    spaces stay as they are; a given name's gender comes from its title, else
    from the lists of given names."""
    names = lambda d: ", ".join("'" + n.lower().replace("'", "''") + "'" for k in d.values() for n in k)
    titles = lambda t: ", ".join(f"'{x}'" for x in t)
    return F.expr(
        """
        transform(p.words, (w, i) -> struct(
          CASE WHEN p.title AND i = 0 OR w RLIKE '^[ \\t]$' THEN 'lit'
               WHEN lower(w) IN (%(male)s) AND (i < size(p.words) - 1 OR size(p.words) = 1) THEN 'male'
               WHEN lower(w) IN (%(female)s) AND (i < size(p.words) - 1 OR size(p.words) = 1) THEN 'female'
               WHEN i = size(p.words) - 1 THEN 'family'
               WHEN p.gender = 'm' THEN 'male' WHEN p.gender = 'f' THEN 'female'
               ELSE 'given' END AS kind,
          lower(w) AS canon, w AS part))
        """
        % {"male": names(MALE), "female": names(FEMALE)}
    ).alias("parts"), F.struct(
        F.regexp_extract_all(m, F.lit(r"[ \t]|[^ \t]+"), F.lit(0)).alias("words"),
        m.rlike(rf"^(?:{_TITLE})\.?[ \t]").alias("title"),
        F.when(F.regexp_extract(m, r"^([^ \t.]+)", 1).isin(*TITLES_MALE), "m").when(F.regexp_extract(m, r"^([^ \t.]+)", 1).isin(*TITLES_FEMALE), "f").alias("gender"),
    ).alias("p")


def surrogate(kind: Column, canon: Column, turn: Column, key: str) -> Column:
    """The surrogate of a canonical value: each letter or digit gives way to a
    keyed one of its class, so length, script and separators stay."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, turn.cast("string"))
    h = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("|+")), 512))  # 128 bytes as hex
    byte = lambda i: F.conv(F.substring(h, F.lit(1) + 2 * F.pmod(i, F.lit(128)), F.lit(2)), 16, 10).cast("int")
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), F.pmod(byte(i), F.lit(len(alphabet))) + 1, F.lit(1))
    digit = lambda c, i: F.when((i == 0) & (c != "0"), F.substring(F.lit("123456789"), F.pmod(byte(i), F.lit(9)) + 1, F.lit(1))).otherwise(pick(_DIGITS, i))
    chars = F.split(canon, "")
    tld = F.length(canon) - F.length(F.regexp_extract(canon, r"\.\p{L}+$", 0))

    def swap(c, i, hexa):
        return (
            F.when(c.rlike(r"\d"), pick(_HEX, i) if hexa else digit(c, i))
            .when(c.rlike("[a-z]"), pick(_HEX if hexa else _LOWER, i))
            .when(c.rlike("[A-Z]"), pick(_HEX.upper() if hexa else _LOWER.upper(), i))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(_CYRILLIC, i))
            .when(c.rlike(r"\p{L}"), pick(_LOWER, i))
            .otherwise(c)
        )

    joined = lambda f: F.array_join(F.transform(chars, f), "")
    more = F.when(turn >= 8, F.concat(pick(_LOWER, F.lit(120)), pick(_LOWER, F.lit(121)), pick(_LOWER, F.lit(122)))).otherwise("")
    octets = F.transform(F.split(canon, r"\."), lambda o, i: F.when((turn >= 8) | (F.length(o) == 3), 100 + F.pmod(byte(2 * i) * 256 + byte(2 * i + 1), F.lit(155))).when(F.length(o) == 2, 10 + F.pmod(byte(i), F.lit(90))).otherwise(1 + F.pmod(byte(i), F.lit(9))).cast("string"))
    script = script_of(canon)
    wide = lambda i: byte(2 * i) * 256 + byte(2 * i + 1)
    of_list = lambda names, i: F.element_at(F.array(*(F.lit(n.lower()) for n in names)), F.pmod(wide(i), F.lit(len(names))) + 1)

    def given(pools):
        def name(s):
            first, second, third = (of_list(pools[s], F.lit(i)) for i in (3, 4, 5))
            return F.when(turn == 0, first).when(turn < 4, F.concat_ws("-", first, second)).otherwise(F.concat_ws("-", first, second, third))

        return F.when(script == "Cyrillic", name("Cyrillic")).otherwise(name("Latin"))

    def family(s):
        # longer with each round, so the names never run out
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.least(turn, F.lit(4))), lambda i: of_list(SYLLABLES[s], 7 + i)), "")

    body = F.array_join(F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), digit), "")
    card = F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    account = F.array_join(F.transform(F.filter(chars, lambda c, i: i >= 4), lambda c, i: swap(c, i + 4, False)), "")
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    return (
        F.when(kind == "email", F.concat(more, joined(lambda c, i: F.when(i >= tld, c).otherwise(swap(c, i, False)))))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "phone", joined(lambda c, i: F.when(canon.startswith("+") & (i < F.when(canon.startswith("+1"), 2).otherwise(3)), c).otherwise(digit(c, i))))
        .when(kind == "ssn", joined(lambda c, i: digit(c, i)))
        .when(kind == "card", card)
        .when(kind == "ip6", joined(lambda c, i: swap(c, i, True)))
        .when((kind == "token") & canon.rlike("^([0-9a-f]+|[0-9A-F]+)$"), joined(lambda c, i: swap(c, i, True)))
        .when(kind == "token", joined(lambda c, i: F.when(i < 4, c).otherwise(swap(c, i, False))))
        .when(kind == "iban", iban)
        .when(kind == "male", given(MALE))
        .when(kind == "female", given(FEMALE))
        .when(kind == "given", given({s: [*MALE[s], *FEMALE[s]] for s in MALE}))
        .otherwise(F.when(script == "Cyrillic", family("Cyrillic")).otherwise(family("Latin")))
    )


def canonical(kind: Column, m: Column) -> Column:
    """What mentions of one entity have in common: the digits of numbers, the lower case of an address."""
    digits = F.regexp_replace(m, r"\D", "")
    return F.when(kind.isin("ssn", "card"), digits).when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits)).when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)


def resolve(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, sur): distinct surrogates for distinct entities.

    All entities of a kind get a surrogate. Of those that share one, the first in
    order keeps it; the rest, and any that fell on an entity that the data really
    holds, draw again with the next turn, until none is left. What still collides
    after the last round gets a numbered placeholder.
    """
    pool = F.when(F.col("kind").isin("male", "female", "given"), "given").otherwise(F.col("kind"))
    draw = entities.select("kind", "canon", pool.alias("pool"), F.lit(0).alias("turn"))
    real = entities.select(pool.alias("pool"), F.lower("canon").alias("sur"), F.lit(True).alias("real")).distinct()
    at = materialise(draw.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.col("turn"), key)), "surrogates")
    for turn in range(1, rounds + 1):
        lowest = at.groupBy("pool", "sur").agg(F.min(F.struct("turn", "kind", "canon")).alias("m"), F.count(F.lit(1)).alias("n"))
        clash = lowest.join(real.withColumn("sur2", F.col("sur")).drop("sur"), (lowest.pool == real.pool) & (F.lower(lowest.sur) == F.col("sur2")), "left").select(lowest.pool, lowest.sur, "m", "n", "real")
        clash = materialise(clash.where("n > 1 OR real"), "clashes")
        if clash.isEmpty():
            break
        joined = at.join(clash, ["pool", "sur"], "left")
        again = F.col("m").isNotNull() & (F.coalesce("real", F.lit(False)) | ~((F.col("m.kind") == F.col("kind")) & (F.col("m.canon") == F.col("canon")) & (F.col("m.turn") == F.col("turn"))))
        if turn == rounds:
            new = F.concat(F.lit("["), F.upper("kind"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon"), 256), 1, 32), F.lit("]"))
        else:
            new = surrogate(F.col("kind"), F.col("canon"), F.lit(turn), key)
        before, at = at, materialise(joined.select("kind", "canon", "pool", F.when(again, F.lit(turn)).otherwise(F.col("turn")).alias("turn"), F.when(again, new).otherwise(F.col("sur")).alias("sur")), "surrogates")
        discard(before, clash)
    return at.select("kind", "canon", "sur")


def dressed(kind: Column, part: Column, sur: Column) -> Column:
    """A surrogate in the format of one mention: separators and capitals as there."""
    figures = F.regexp_replace(sur, r"\D", "")
    numbers = F.aggregate(
        F.split(part, ""),
        F.struct(F.lit("").alias("o"), F.lit(1).alias("k")),
        lambda a, c: F.struct(F.when(c.rlike(r"\d"), F.concat(a["o"], F.substring(figures, a["k"], F.lit(1)))).otherwise(F.concat(a["o"], c)).alias("o"), (a["k"] + F.when(c.rlike(r"\d"), 1).otherwise(0)).alias("k")),
        lambda a: a["o"],
    )
    spaced = F.aggregate(
        F.split(part, ""),
        F.struct(F.lit("").alias("o"), F.lit(1).alias("k")),
        lambda a, c: F.struct(F.when(c == " ", F.concat(a["o"], c)).otherwise(F.concat(a["o"], F.substring(sur, a["k"], F.lit(1)))).alias("o"), (a["k"] + F.when(c == " ", 0).otherwise(1)).alias("k")),
        lambda a: a["o"],
    )
    same = F.length(part) == F.length(sur)
    cased = F.when(same, F.array_join(F.zip_with(F.split(part, ""), F.split(sur, ""), lambda a, b: F.when(a.rlike(r"\p{Lu}"), F.upper(b)).otherwise(b)), "")).otherwise(sur)
    capital = F.array_join(F.transform(F.split(sur, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "-")
    named = F.when((F.length(part) > 1) & (part == F.upper(part)), F.upper(sur)).otherwise(capital)
    return (
        F.when(sur.isNull(), part)
        .when(sur.startswith("["), sur)
        .when(kind.isin("ssn", "card", "phone"), numbers)
        .when(kind == "iban", spaced)
        .when(kind == "email", cased)
        .when((kind == "ip6") & (part == F.upper(part)), F.upper(sur))
        .when(kind.isin("male", "female", "given", "family"), named)
        .otherwise(sur)
    )


def renamed(piece: Column, names: Column) -> Column:
    """Text between entities with bare names of its document's persons replaced: whole
    words, as in the full mention, in capitals, or with a capital first."""
    edge = r"(?<![\p{L}\p{N}])\Q", r"\E(?![\p{L}\p{N}])"
    put = lambda text, form, by: F.regexp_replace(text, F.concat(F.lit(edge[0]), form, F.lit(edge[1])), by)
    one = lambda text, n: put(put(text, n["form"], n["by"]), F.upper(n["form"]), F.upper(n["by"]))
    return F.when(F.size(names) == 0, piece).otherwise(F.aggregate(names, piece, one))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """df with every detected entity of text_col replaced by its surrogate; all
    columns stay as they are, count_col (if named) is added: entities replaced.

    Detected: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, card numbers
    that pass the Luhn check, account numbers whose check digits are right (IBAN),
    social security numbers, access tokens, and names: after a title, beginning with
    a known given name, or by the words around them (NAME_NEXT, NAME_BEFORE). Names
    that a document has once in full are replaced where they stand alone in it, too.
    Surrogates are drawn with `key` from the entity alone: the same entity has the
    same surrogate in every row and spelling (numbers by their digits, names by their
    words), different entities have different ones, and none is an entity that the
    data holds. Type, script, gender, length of numbers and addresses, check digits,
    separators and capitals stay.

    A null text stays null, an empty one empty; an empty table gives no rows; repeated
    rows get equal results; ids play no part. Of types that match at one place, the
    first in the order of ENTITY counts. Rows without entities are passed through
    unread by any join. Texts of any length: a row's own entities meet in one row.
    """
    # inner names that no column of df has
    prefix = "__pii"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    uid, hits, out_col, names_col, n_col = (f"{prefix}{x}" for x in ("uid", "hits", "out", "names", "n"))
    found = F.regexp_extract_all(F.col(text_col), F.lit(ENTITY), F.lit(0))
    own = df.columns
    rest = df.where(~F.coalesce(F.col(text_col).rlike(ENTITY), F.lit(False)))
    with_ = df.where(F.col(text_col).rlike(ENTITY)).withColumn(hits, found).withColumn(uid, F.monotonically_increasing_id())
    with_ = materialise(with_, "pii")
    each = with_.select(F.col(uid).alias("uid"), F.posexplode(hits).alias("pos", "m")).withColumn("kind", kind_of(F.col("m")))
    parts_of, p = person_parts(F.col("m"))
    single = F.array(F.struct(F.col("kind").alias("kind"), canonical(F.col("kind"), F.col("m")).alias("canon"), F.col("m").alias("part")))
    each = each.withColumn("p", p).withColumn("parts", F.when(F.col("kind") == "person", parts_of).otherwise(single))
    parts = each.select("uid", "pos", F.posexplode("parts").alias("idx", "x")).select("uid", "pos", "idx", "x.kind", "x.canon", "x.part")
    parts = materialise(parts, "parts")
    table = resolve(parts.where("kind <> 'lit'").select("kind", "canon").distinct(), key)
    filled = parts.join(table, ["kind", "canon"], "left").select("uid", "pos", "idx", "kind", "part", dressed(F.col("kind"), F.col("part"), F.col("sur")).alias("o"))
    names = F.struct(F.col("part").alias("form"), F.col("o").alias("by"))
    filled = filled.withColumn("name", F.when(F.col("kind").isin("male", "female", "given", "family") & F.col("o").isNotNull() & (F.length("part") > 1), names))
    whole = filled.groupBy("uid", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "o"))), lambda x: x["o"]), "").alias("o"), F.collect_set("name").alias("names"), F.max(F.col("kind") != "lit").cast("int").alias("is"))
    # a document's mentions; its names in their own form, in capitals and with a capital, family names last
    by_row = whole.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]).alias(out_col), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(names_col), F.sum("is").cast("bigint").alias(n_col))
    done = with_.join(by_row.withColumnRenamed("uid", uid), uid)
    between = F.transform(F.split(F.col(text_col), ENTITY, -1), lambda piece: renamed(piece, F.col(names_col)))
    text = F.array_join(F.zip_with(between, F.col(out_col), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    add = lambda n: [n.alias(count_col)] if count_col else []
    changed = done.select(*[text.alias(c) if c == text_col else F.col(c) for c in own], *add(F.col(n_col)))
    return rest.select(*own, *add(F.lit(0).cast("bigint"))).union(changed)
