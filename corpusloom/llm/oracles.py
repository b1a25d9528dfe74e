"""DuckDB SQL of the vector code and conversation queries, from their definitions."""

from __future__ import annotations

PARTS, ENTRIES, ROUNDS = 8, 16, 6


def vector_codes_sql() -> str:
    """Rounds unrolled: assignments a1, a2, .. by codebooks c0, c1, ..; the least of distance * entries + index is the nearest, first of equals."""
    steps = []
    for k in range(ROUNDS + 1):
        distance = "CAST(list_sum(list_transform(list_zip(s.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        steps.append(f"a{k + 1} AS MATERIALIZED (SELECT s.rid, s.p, any_value(s.x) AS x, min({distance} * {ENTRIES} + c.e) AS m FROM s JOIN c{k} c ON c.p = s.p GROUP BY s.rid, s.p)")
        if k < ROUNDS:
            means = f"SELECT p, m % {ENTRIES} AS e, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS t FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS j FROM a{k + 1}) GROUP BY p, m % {ENTRIES}, j"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM c{k} b LEFT JOIN (SELECT p, e, list(t ORDER BY j) AS c FROM ({means}) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT rid, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM (SELECT *, unnest(range({PARTS})) AS p FROM k)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e FROM s) WHERE e < {ENTRIES}),
{", ".join(steps)},
r AS (SELECT rid, string_agg(format('{{:02x}}', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS + 1} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), h"""


def _inserted(best: str) -> str:
    """What none, one or two inserts make of each of ``best``."""
    one, two = "[2, 2, 3, 2][b.state + 1]", "[3, 3, 2, 3][b.state + 1]"
    line = lambda state: f"chr(10) || ['', '', 'user', 'assistant'][{state} + 1] || ':'"
    ways = ", ".join([
        "{'cost': b.cost, 'audit': b.audit, 'state': b.state, 'out': b.out}",
        f"{{'cost': b.cost + 5, 'audit': b.audit || 'I', 'state': {one}, 'out': b.out || {line(one)}}}",
        f"{{'cost': b.cost + 10, 'audit': b.audit || 'II', 'state': {two}, 'out': b.out || {line(one)} || {line(two)}}}",
    ])
    return f"flatten(list_transform({best}, lambda b: [{ways}]))"


def conversations_sql() -> str:
    """Damage, faults, and for each row the cheapest edits for every role that the output may end in, ties by their letters."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a // 256, tbl[xor(a % 256, b) + 1])), 4294967295)"
    kept = "CASE WHEN b.state = 0 AND n.r = 0 THEN 1 WHEN b.state <> 2 AND n.r = 1 THEN 2 WHEN b.state = 2 AND n.r = 2 THEN 3 END"
    more, gone, after = "(CASE WHEN n.f = 3 THEN 5 ELSE 0 END)", "n.f IN (1, 2)", "[2, 2, 3, 2][b.state + 1]"
    moves = ", ".join([
        "{'cost': b.cost + 2, 'audit': b.audit || 'D', 'state': b.state, 'out': b.out}",
        f"{{'cost': b.cost + 1 + {more}, 'audit': b.audit || 'R', 'state': CASE WHEN NOT ({gone}) THEN {after} END, 'out': b.out || chr(10) || ['', '', 'user', 'assistant'][{after} + 1] || ':' || n.text}}",
        f"{{'cost': b.cost + {more}, 'audit': b.audit || 'K', 'state': CASE WHEN NOT ({gone}) THEN {kept} END, 'out': b.out || chr(10) || n.role || ':' || n.text}}",
    ])
    all_moves = f"flatten(list_transform({_inserted('g.best')}, lambda b: [{moves}]))"
    best = "list_filter(list_transform([0, 1, 2, 3], lambda st: list_sort(list_filter(moves, lambda m: m.state = st))[1]), lambda m: m IS NOT NULL)"
    return f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, j: {step}) AS v FROM range(256) q(i))),
d AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations, t),
x AS (SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM d WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, again) AS seen,
      rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body, left(role, 1) AS initial FROM x),
n AS MATERIALIZED (SELECT c, i, turn, role, text, CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS r,
      CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS f,
      i > 1 AND lag(initial) OVER (PARTITION BY c ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS bad FROM o),
g AS (SELECT c, CAST(0 AS BIGINT) AS i, [{{'cost': 0, 'audit': '', 'state': 0, 'out': ''}}] AS best FROM (SELECT DISTINCT conv_id AS c FROM conversations)
  UNION ALL
  SELECT c, i, {best} AS best FROM (SELECT g.c, n.i, {all_moves} AS moves FROM g JOIN n ON n.c IS NOT DISTINCT FROM g.c AND n.i = g.i + 1)),
z AS (SELECT c, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM n GROUP BY c),
e AS (SELECT g.c, z.* EXCLUDE (c), list_sort(list_filter({_inserted('g.best')}, lambda m: m.state IN (0, 3)))[1] AS w FROM g LEFT JOIN z ON z.c IS NOT DISTINCT FROM g.c WHERE g.i = coalesce(z.last, 0))
SELECT c AS conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
       CAST(w.cost AS BIGINT) AS cost, w.audit AS audit, sha256(substr(w.out, 2)) AS repaired_sha256 FROM e"""
