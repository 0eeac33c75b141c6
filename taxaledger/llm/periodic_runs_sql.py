"""DuckDB SQL for periodic runs: every pair of equal words of a text, stretches of each lag, and those without a smaller period."""

from __future__ import annotations

_CRC32 = """xor(list_reduce([ord(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda c, b: list_reduce(range(8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b)), 4294967295), 4294967295)"""

OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC32} AS h,
    [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
plan AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM d),
spot AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plan),
words AS MATERIALIZED (SELECT rid, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM spot)),
pairs AS (SELECT x.rid, x.i, x.i - y.i AS q FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i < x.i AND 3 * (x.i - y.i) <= x.n),
stretches AS (SELECT rid, q, min(i) - q AS s, count(*) + q AS len, max(i) AS e
  FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM pairs)
  GROUP BY rid, q, grp HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT * FROM stretches b WHERE NOT EXISTS (
  SELECT 1 FROM stretches x WHERE x.rid = b.rid AND x.q < b.q AND x.s <= b.s AND x.e >= b.e)),
per AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
best AS (SELECT rid, s, len, q FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.rid = r.rid
  AND (o.len * r.q > r.len * o.q OR (o.len * r.q = r.len * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS words FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, (1000 * len) // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""
