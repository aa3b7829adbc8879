"""The collocations of documents in SQL: every n-gram counted, then cuts, longer phrases and ranks."""

COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m AS size, array_to_string(w[CAST(i AS BIGINT):CAST(i + m - 1 AS BIGINT)], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
k AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT c.*, unnest(range(1, size)) AS k FROM c)),
s AS MATERIALIZED (SELECT k.lang, k.phrase, k.a, k.k, h.n AS l, t.n AS r, CAST(1000000 * k.a::HUGEINT * k.a // (h.n::HUGEINT * t.n) AS BIGINT) AS score FROM k
    JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f t ON t.lang = k.lang AND t.phrase = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3),
m AS (SELECT lang, phrase, max(a) AS f FROM i GROUP BY ALL),
x AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE coalesce(100 * m.f < 50 * b.a, true)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM x)
SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""
