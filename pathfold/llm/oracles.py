"""SQL of the newer operators' queries, for DuckDB."""

from __future__ import annotations

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
WITH RECURSIVE
crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations),
dealt AS (
    SELECT n.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: ascii(x))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS part
    FROM named n, crc),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (
    SELECT i.c, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
        CASE part WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN part = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM dealt d JOIN ids i ON d.conv_id IS NOT DISTINCT FROM i.conv_id WHERE part <> 0),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
        rtrim(text, {BLANK}) AS body FROM damaged),
judged AS (
    SELECT *, body = '' AS blank, right(body, 1) NOT IN ('.', '!', '?') AS cut,
        row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS again,
        left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n) AS before
    FROM numbered),
facts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
        count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS size
    FROM judged GROUP BY c),
inserts(p, q, cost, edits) AS (
    VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'),
        (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edits(must, initial, p, q, cost, edit) AS (
    VALUES (NULL, NULL, 0, 0, 2, 'D'), (NULL, NULL, 1, 1, 2, 'D'), (NULL, NULL, 2, 2, 2, 'D'), (NULL, NULL, 3, 3, 2, 'D'),
        (false, 's', 0, 1, 0, 'K'), (false, 'u', 0, 2, 0, 'K'), (false, 'u', 1, 2, 0, 'K'), (false, 'u', 3, 2, 0, 'K'),
        (false, 'a', 2, 3, 0, 'K'), (false, NULL, 0, 2, 1, 'R'), (false, NULL, 1, 2, 1, 'R'), (false, NULL, 3, 2, 1, 'R'),
        (false, NULL, 2, 3, 1, 'R')),
options AS (
    SELECT j.c, j.n, i.p, e.q, i.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.cut THEN 5 ELSE 0 END AS cost, i.edits || e.edit AS edits
    FROM judged j JOIN edits e ON (e.must IS NULL OR NOT (j.blank OR j.again)) AND (e.initial IS NULL OR e.initial = j.initial)
        JOIN inserts i ON i.q = e.p),
front AS (
    SELECT c, CAST(0 AS BIGINT) AS n, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM facts
    UNION ALL
    SELECT f.c, o.n, o.q, min({{'cost': CAST(f.best.cost + o.cost AS BIGINT), 'audit': f.best.audit || o.edits}}) AS best
    FROM front f JOIN options o ON o.c = f.c AND o.n = f.n + 1 AND o.p = f.q GROUP BY f.c, o.n, o.q),
ends AS (
    SELECT f.c, min({{'cost': f.best.cost + i.cost, 'audit': f.best.audit || i.edits}}) AS best
    FROM front f JOIN facts x ON x.c = f.c AND f.n = x.size JOIN inserts i ON i.p = f.q AND i.q IN (0, 3) GROUP BY f.c),
letters AS (
    SELECT c, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM ends),
placed AS (
    SELECT c, edit, pos, count(*) FILTER (edit <> 'I') OVER told AS n, count(*) FILTER (edit <> 'D') OVER told AS place
    FROM letters WINDOW told AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)),
kept AS (
    SELECT p.*, j.role, j.text, bool_or(edit = 'K' AND place = 1 AND j.initial = 's') OVER (PARTITION BY p.c) AS led
    FROM placed p LEFT JOIN judged j ON j.c = p.c AND j.n = p.n AND p.edit <> 'I' WHERE edit IN ('K', 'R', 'I')),
told AS (
    SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body FROM kept GROUP BY c)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
    coalesce(e.best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids i LEFT JOIN facts f ON f.c = i.c LEFT JOIN ends e ON e.c = i.c LEFT JOIN told t ON t.c = i.c
"""


def vector_codes(entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and means, one pair of tables for each."""
    gap = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT a.r, a.p, min({{'far': CAST({gap} AS BIGINT), 'e': b.e}}) AS best
    FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (
    SELECT a.p, n.best.e AS e, i, CAST(sum(a.v[i]) AS BIGINT) AS s, count(*) AS n
    FROM parts a JOIN near{k} n ON a.r = n.r AND a.p = n.p, unnest(range(1, CAST(len(a.v) AS BIGINT) + 1)) AS t(i) GROUP BY ALL),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v,
        row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
    FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT r, p, v[CAST(p * len(v) // 4 + 1 AS BIGINT):CAST((p + 1) * len(v) // 4 AS BIGINT)] AS v FROM kept, unnest(range(4)) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {entries}),
{", ".join(steps)},
codes AS (
    SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256
    FROM book{rounds}),
labelled AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN codes USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept k JOIN codes USING (r) JOIN labelled l ON l.label IS NOT DISTINCT FROM k.label, digest
"""
