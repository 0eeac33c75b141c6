"""DuckDB SQL for the secret scan: every rule over every text, no index."""

from __future__ import annotations


def _spans(n: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {n} AS k, '{kind}' AS kind, gaps[i] + CASE WHEN i = 1 THEN 0 ELSE list_sum(gaps[1:i-1]) + list_sum(hits[1:i-1]) END AS s, hits[i] AS h
      FROM (SELECT rid, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT rid, [length(x) FOR x IN string_split_regex(text, {p})] AS gaps,
               [length(x) FOR x IN regexp_extract_all(text, {p}, 0)] AS hits,
               [length(x) FOR x IN regexp_extract_all(text, {p}, {group})] AS vals
        FROM d WHERE regexp_matches(text, {p}))) WHERE vals[i] >= {least}"""


_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("webhook", r"https://hooks\.[a-z]+\.com/services/[A-Za-z0-9/]{20,}", 0, 0),
)

SPANS_CTE = f"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(_spans(n, *r) for n, r in enumerate(_RULES))}),
per AS (SELECT rid,
    count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || (s + h), ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || (s + h), ',' ORDER BY s, k) AS spans
  FROM hits GROUP BY rid)"""

OP3_SQL = f"""WITH {SPANS_CTE}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""
