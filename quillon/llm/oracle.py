"""Reference SQL for the queries that SQL can express."""

from __future__ import annotations

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
f AS (SELECT s, min(page_id) AS m FROM d WHERE n >= 100 GROUP BY s)
SELECT page_id, n AS payload_bytes, d.s AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM d LEFT JOIN f ON d.s = f.s"""

OP8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i, ws FROM b
    WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM v),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n),
t AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM p),
o AS (SELECT doc_id, t.n, i, item_id FROM t JOIN win ON t.t = win.t AND t.n = win.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)"""



OP7 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, role, text, coalesce(role = perspective, false) AS own,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' WHEN role IS NULL THEN '<|user|>'
      ELSE '<|user name=' || url_encode(role) || '|>' END || chr(10)
      || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS segment
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) AS stop FROM r
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, seq, turn, role, segment, stop - length(segment) AS start, stop AS "end",
  CASE WHEN own THEN stop - length(segment) + 14 END AS mask_start, CASE WHEN own THEN stop - 1 END AS mask_end FROM p"""


# What op3 looks for, stated here on its own, so that a wrong pattern of the operator shows.
SECRETS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "id": r"""(?i:access_?key_?id|client_?id|account_?id|tenant_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "endpoint": r"""(?i:https?|ftps?|ssh|s3|jdbc:[a-z]{2,12}|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""",
    "key": r"[A-Za-z0-9+/_=-]{20,}",
}
SECRET_SCOPE = 200


def _secret_sql() -> str:
    """Base and weak spans, positions from the text between the matches."""
    found, steps = [], []
    for k, pattern in enumerate(SECRETS.values()):
        quoted = "'" + pattern.replace("'", "''") + "'"
        steps.append(f"""m{k} AS (SELECT r, generate_subscripts(ms, 1) AS i, ms, gaps FROM (SELECT r,
            regexp_extract_all(t, {quoted}) AS ms, string_split_regex(t, {quoted}) AS gaps FROM d) WHERE len(ms) > 0)""")
        value = f"length(regexp_extract(ms[i], {quoted}, 1)) >= 8" if k == 0 else "length(ms[i]) >= 16" if k == 1 else "true"
        if k == 5:
            value = ("regexp_matches(ms[i], '[0-9]') AND regexp_matches(ms[i], '[A-Z]') AND regexp_matches(ms[i], '[a-z]')"
                     " AND len(list_distinct(string_split(ms[i], ''))) >= 10")
        found.append(f"""SELECT r, {k} AS k, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(ms[i]) AS n
            FROM m{k} WHERE {value}""")
    names = "[" + ", ".join(f"'{k}'" for k in SECRETS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(steps)},
spans AS (SELECT r, k, s, s + n AS e FROM ({" UNION ALL ".join(found)})),
base AS (SELECT * FROM spans WHERE k < 3),
places AS (SELECT * FROM spans WHERE k IN (3, 4)),
apart AS (SELECT * FROM spans w WHERE k >= 3 AND NOT (k = 5 AND EXISTS (SELECT 1 FROM places p
    WHERE p.r = w.r AND p.s < w.e AND w.s < p.e))),
weak AS (SELECT * FROM apart w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
kept AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts o WHERE o.r = w.r
    AND (o.k IN (0, 2, 5)) <> (w.k IN (0, 2, 5)) AND o.s - {SECRET_SCOPE} <= w.e AND w.s <= o.e + {SECRET_SCOPE})),
listed AS (SELECT r, k, s, {names}[k + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM kept)),
one AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM listed GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN one USING (r)"""


OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INT) AS mask FROM t LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt FROM m GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT list_aggregate(list_transform(fs, lambda x: chr(CAST(65 + x AS INT))), 'string_agg', '') AS filter_order, CAST(k AS INT) AS step,
    CAST(list_sum(list_transform(fs[1:k - 1], lambda x: 1 << x)) AS BIGINT) AS before, 1 << fs[k] AS bit
    FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN ng ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN nt ELSE 0 END) AS toxic_lost
    FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

OP12 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""

OP13 = r"""
WITH RECURSIVE k AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda v, b: list_reduce(list_prepend(xor(v, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda y, u: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS fate FROM k),
w AS (SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM z WHERE fate <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM w),
d AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, left(role, 1) AS h,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM q),
x AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM d GROUP BY c),
ins(i, j, cost, way) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'),
    (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
ed(i, j, role, letter) AS (VALUES (0, 1, 's', 'K'), (0, 2, 'u', 'K'), (1, 2, 'u', 'K'), (2, 3, 'a', 'K'), (3, 2, 'u', 'K'),
    (0, 2, NULL, 'R'), (1, 2, NULL, 'R'), (2, 3, NULL, 'R'), (3, 2, NULL, 'R'),
    (0, 0, NULL, 'D'), (1, 1, NULL, 'D'), (2, 2, NULL, 'D'), (3, 3, NULL, 'D')),
mv AS (SELECT ins.i, ed.j, role, letter, cost, way || letter AS way FROM ins JOIN ed ON ins.j = ed.i),
r AS (SELECT c, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM x
  UNION ALL
  SELECT r.c, r.i + 1, mv.j, min({'cost': r.best.cost + mv.cost + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
      + CASE WHEN letter <> 'D' AND d.cut THEN 3 ELSE 0 END, 'audit': r.best.audit || mv.way})
  FROM r JOIN d ON d.c = r.c AND d.i = r.i + 1 JOIN mv ON mv.i = r.state
  WHERE letter = 'D' OR (NOT d.blank AND NOT d.again AND (letter = 'R' OR mv.role = d.h))
  GROUP BY r.c, r.i, mv.j),
e AS (SELECT r.c, min({'cost': r.best.cost + ins.cost, 'audit': r.best.audit || ins.way}) AS best
  FROM r JOIN x ON x.c = r.c AND x.n = r.i JOIN ins ON ins.i = r.state WHERE ins.j IN (0, 3) GROUP BY r.c),
a AS (SELECT c, letter, k, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY k) AS i FROM (
    SELECT c, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS k
    FROM e WHERE best.audit <> '')),
p AS (SELECT a.*, d.role, d.text, CASE WHEN (coalesce(sum(CASE WHEN letter = 'D' OR (letter = 'K' AND d.h = 's') THEN 0 ELSE 1 END)
      OVER (PARTITION BY a.c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 0 THEN 'user' ELSE 'assistant' END AS due
    FROM a LEFT JOIN d ON d.c = a.c AND d.i = a.i),
y AS (SELECT c, string_agg(CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN due || ':' || text ELSE due || ':' END, chr(10) ORDER BY k) AS t
    FROM p WHERE letter <> 'D' GROUP BY c)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM k) v LEFT JOIN x USING (c) LEFT JOIN e USING (c) LEFT JOIN y USING (c)"""


ORACLE = {"op3_secret_links": _secret_sql(), "op7_perspectives": OP7, "op8_decontaminate": OP8, "op10_warc_chunks": OP10,
          "op11_filter_audit": OP11, "op12_chunk_recipes": OP12, "op13_conversation_repair": OP13}
