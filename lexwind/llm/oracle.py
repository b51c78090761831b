"""DuckDB SQL of the queries that SQL can express, formulated with relations where the operators use arrays."""

from __future__ import annotations

# Patterns and names of the secret scan, stated here a second time, so that a slip in the operator shows.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
WORDY = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""((?i:passw(?:or)?d|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?({WORDY}+)"""
ACCESS = "AKIA[0-9A-Z]+"
HEX = "[a-f0-9]{24,}"
WEAK_ID = r"""(?i:access_?key_?id|client_?id|account(?:_?name)?|user(?:_?name)?|login)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9@+/_.-]{3,})"""
WEAK_SECRET = "[0-9A-Za-z_/+-]{20,}={0,2}"
ENDPOINT = r"(?:http|https|ftp|ssh|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[0-9A-Za-z%=;,+*()&$!@#?/:~_.-]+"

URLS = r"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, url FROM pages),
asked AS (SELECT *, lower(regexp_extract(url, '^(?s:(.*?))://', 1)) AS scheme,
  list_sort(list_filter(string_split(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '')) AS parameters FROM parsed),
keyed AS (SELECT page_id, host, path, url, CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
  || regexp_replace(path, '(\.html)?/*$', '') || CASE WHEN len(parameters) > 0 THEN '?' || array_to_string(parameters, '&') ELSE '' END AS key FROM asked),
listed AS (SELECT DISTINCT key FROM keyed WHERE url LIKE 'http://%' AND key <> ''),
rules(verdict, rule, rule_host, rule_path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
won AS (
  SELECT page_id, host, path, key, (SELECT rule FROM rules r WHERE (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path)
    ORDER BY length(rule) DESC LIMIT 1) AS rule FROM keyed k)
SELECT page_id, host, path, w.rule, coalesce(r.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM won w LEFT JOIN rules r ON w.rule = r.rule LEFT JOIN listed l ON l.key = w.key"""


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


CHAT = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made AS (SELECT *, '<turn ' || {escaped("role")} || '>' || {escaped("text")} || '</turn>' || chr(10) AS out, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM turns),
counted AS (SELECT *, strlen(out) AS tokens, nth = 1 AND role = 'system' AS is_system FROM made),
summed AS (SELECT *, first_value(CASE WHEN is_system THEN tokens ELSE 0 END) OVER c AS system_tokens, first_value(CASE WHEN is_system THEN length(out) ELSE 0 END) OVER c AS system_chars,
  coalesce(sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM counted WINDOW c AS (PARTITION BY conv_id ORDER BY nth)),
room AS (SELECT *, greatest(2, 2688 - system_tokens) AS room FROM summed),
grid AS (SELECT *, 2 * tokens > room AS large FROM room),
placed AS (SELECT *, floor(CAST(start AS DOUBLE) / (room - coalesce(max(tokens) FILTER (NOT large AND NOT is_system) OVER (PARTITION BY conv_id), 0))) AS cell FROM grid),
opened AS (SELECT *, CASE WHEN nth > 1 AND NOT lag(is_system, 1, false) OVER c AND (lag(cell) OVER c <> cell OR large OR lag(large) OVER c) THEN 1 ELSE 0 END AS opens FROM placed WINDOW c AS (PARTITION BY conv_id ORDER BY nth)),
windowed AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY nth) AS window_id FROM opened),
ended AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, window_id ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS to_end, max(window_id) OVER (PARTITION BY conv_id) AS last_window FROM windowed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(out)) + coalesce(sum(length(out)) FILTER (NOT is_system AND to_end <= 384 AND window_id < last_window), 0) + max(last_window) * max(system_chars) AS BIGINT) AS formatted_chars
FROM ended GROUP BY conv_id"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

HARD_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.row <> c.row),
p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.row = s.row AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def located(pattern: str, kind: int, group: int = 0) -> str:
    """Rows (rid, kind, s, e, v) of a pattern's matches; positions from the lengths of gaps and matches."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {kind} AS kind, u.s AS s, u.e AS e, u.v AS v FROM (SELECT rid, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
  's': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
  'e': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS BIGINT), 'v': w[i]}})) AS u
  FROM (SELECT rid, regexp_extract_all(t, {p}) AS h, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, {group}) AS w FROM d))"""


APART = "NOT EXISTS (SELECT 1 FROM {other} b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)"
NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({located(ASSIGN, 0, 2)}) WHERE length(v) >= 6 UNION ALL SELECT * FROM ({located(ACCESS, 1)}) WHERE e - s >= 20 UNION ALL {located(HEX, 2)}),
ids AS (SELECT * FROM ({located(WEAK_ID, 3)}) x WHERE {APART.format(other="base")}),
linkable AS (SELECT rid FROM ids UNION SELECT rid FROM base WHERE kind = 1),
ends AS (SELECT * FROM ({located(ENDPOINT, 5)}) x WHERE {APART.format(other="base")} AND rid IN (SELECT rid FROM linkable)),
named AS (SELECT * FROM ids UNION ALL SELECT * FROM ends),
bare AS (SELECT * FROM ({located(WEAK_SECRET, 4)}) x WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND {APART.format(other="base")} AND {APART.format(other="named")} AND rid IN (SELECT rid FROM linkable)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM named UNION ALL SELECT * FROM bare),
broken AS (SELECT *, CASE WHEN s - coalesce(max(e) OVER (PARTITION BY rid ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 200 THEN 1 ELSE 0 END AS breaks FROM parts),
scoped AS (SELECT *, sum(breaks) OVER (PARTITION BY rid ORDER BY s, kind, e ROWS UNBOUNDED PRECEDING) AS scope FROM broken),
linked AS (SELECT rid, scope FROM scoped GROUP BY rid, scope HAVING bool_or(kind IN (1, 3)) AND bool_or(kind IN (0, 2, 4)) AND bool_or(kind IN (0, 1, 2, 5))),
spans AS (SELECT rid, s, kind, e FROM base UNION ALL SELECT rid, s, kind, e FROM scoped JOIN linked USING (rid, scope) WHERE kind >= 3),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS shown FROM base GROUP BY rid),
a AS (SELECT rid, string_agg({NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS shown FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.shown, '')) AS base_sha256, coalesce(a.shown, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""
