"""SQL for the benchmark leaks, from the same token pattern, word lists and parameters."""

from __future__ import annotations

from seqspark.llm.decontaminate import COVERAGE, NAME, NUM, TOKEN, UNIT, WINDOW, _sql_list
from seqspark.llm.names import FEMALE, MALE, NUMBERS, SIGNS, UNITS, UNITS_SHORT

_ENDS = "('.', '!', '?', chr(10))"
_DIGIT = lambda x: f"({x} >= '0' AND {x} < ':' OR {x} > '~' AND regexp_matches({x}, '^\\p{{N}}'))"
_AFTER = f"i > 1 AND ({_DIGIT('a[i - 1]')} OR lower(a[i - 1]) IN ({_sql_list(NUMBERS)}))"
_CLEAR = [*(u for u in UNITS if u not in UNITS_SHORT), *SIGNS]
_PLAIN = f"CASE WHEN lower(x) IN ({_sql_list(_CLEAR)}) THEN '{UNIT}' WHEN lower(x) IN ({_sql_list(NUMBERS)}) THEN '{NUM}' WHEN lower(x) IN ({_sql_list(UNITS_SHORT)}) AND {_AFTER} THEN '{UNIT}' ELSE lower(x) END"
_GIVEN = _sql_list(sorted({n for d in (MALE, FEMALE) for k in d.values() for n in k}))
_FORMS = {
    True: f"CASE WHEN {_DIGIT('x')} THEN '{NUM}' WHEN x = lower(x) THEN {_PLAIN} WHEN x IN ({_GIVEN}) OR (i > 1 AND length(x) > 1 AND substr(x, 2) = lower(substr(x, 2)) AND a[i - 1] NOT IN {_ENDS}) THEN '{NAME}' ELSE {_PLAIN} END",
    False: f"CASE WHEN {_DIGIT('x')} THEN '{NUM}' ELSE {_PLAIN} END",
}


def _templates(source: str, names: bool) -> str:
    """(id, raw, t) of (id, text): tokens and their template forms, sentence ends left out."""
    pattern = TOKEN.replace("'", "''")
    return f"""SELECT id, list_transform(z, lambda p: p.r) AS raw, list_transform(z, lambda p: p.f) AS t FROM (
        SELECT id, list_filter(list_transform(a, lambda x, i: {{'r': x, 'f': {_FORMS[names]}}}), lambda p: p.r NOT IN {_ENDS}) AS z
        FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS a FROM ({source})))"""


def _windows(rows: str, pos: str) -> str:
    w = f"array_to_string(t[{pos} + 1:{pos} + {WINDOW}], chr(31))"
    return f"SELECT id, {pos}, greatest(len(t) - {WINDOW} + 1, 1) AS n_windows, {w} AS h FROM (SELECT id, t, unnest(range(0, greatest(len(t) - {WINDOW}, 0) + 1)) AS {pos} FROM {rows} WHERE len(t) > 0)"


_ITEMS = "SELECT item_id AS id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY 1"
_SLOTS = f"('{NUM}', '{NAME}', '{UNIT}')"

LEAKS = f"""WITH docs AS MATERIALIZED ({_templates("SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL", True)}),
items AS MATERIALIZED ({_templates(_ITEMS, True)}), words AS MATERIALIZED ({_templates(_ITEMS, False)}),
asked AS MATERIALIZED ({_windows("items", "ipos")} UNION {_windows("words", "ipos")}),
met AS (SELECT d.id, a.id AS item, a.n_windows, d.pos - a.ipos AS diag, a.ipos FROM ({_windows("docs", "pos")}) d JOIN asked a USING (h)),
diag AS MATERIALIZED (SELECT id, item, n_windows, diag, list(DISTINCT ipos) AS spots FROM met GROUP BY ALL),
best AS (SELECT id, item, diag AS best FROM (SELECT *, row_number() OVER (PARTITION BY id, item ORDER BY len(spots) DESC, diag) AS r, sum(len(spots)) OVER (PARTITION BY id, item) AS all_n FROM diag)
         WHERE r = 1 AND all_n >= n_windows * CAST({COVERAGE} AS DOUBLE)),
near AS MATERIALIZED (SELECT g.* FROM diag g JOIN best b USING (id, item) WHERE abs(diag - best) <= greatest(1, ceil(CAST({1 - COVERAGE!r} AS DOUBLE) * (n_windows + {WINDOW})))),
found AS MATERIALIZED (SELECT id, item, n_windows, count(DISTINCT p) AS n FROM (SELECT id, item, n_windows, unnest(spots) AS p FROM near) GROUP BY ALL HAVING count(DISTINCT p) >= n_windows * CAST({COVERAGE} AS DOUBLE)),
places AS (SELECT DISTINCT id, item, diag, unnest(range(p, p + {WINDOW})) AS k FROM (SELECT id, item, diag, unnest(spots) AS p FROM near SEMI JOIN found USING (id, item))),
own AS (SELECT id AS item, i AS k, lower(raw[i + 1]) AS value, t[i + 1] AS type FROM (SELECT *, unnest(range(0, len(t))) AS i FROM items) WHERE t[i + 1] IN {_SLOTS}),
theirs AS (SELECT id, i AS pos, lower(raw[i + 1]) AS other, t[i + 1] AS type FROM (SELECT *, unnest(range(0, len(t))) AS i FROM docs SEMI JOIN found USING (id)) WHERE t[i + 1] IN {_SLOTS}),
slots AS (SELECT DISTINCT p.id, p.item, p.k, o.type, o.value, x.other FROM places p JOIN own o USING (item, k) JOIN theirs x ON x.id = p.id AND x.pos = p.k + p.diag AND x.type = o.type),
mapped AS (SELECT id, item, type, value, count(DISTINCT other) AS n, bool_and(value = other) AS same, count(DISTINCT k) AS k FROM slots GROUP BY ALL),
checked AS (SELECT id, item, max(n) AS most, bool_and(same) AS same, sum(k) AS n_slots FROM mapped GROUP BY ALL)
SELECT f.id AS doc_id, f.item AS item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n AS DOUBLE) / n_windows AS coverage, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, coalesce(same, true) AS same_values
FROM found f LEFT JOIN checked c USING (id, item) WHERE coalesce(most, 1) <= 1"""
