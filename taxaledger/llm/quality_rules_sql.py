"""DuckDB SQL for the quality rules: every word and window as a row."""

from __future__ import annotations

from taxaledger.llm import quality_rules as rules

_BLANK = r"[\x20\x09-\x0D]"
#: Characters of each class as the inside of a bracket; the last class is what is left.
_IN_CLASS = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r".,;:!?''\"()\-")
_ASCII = r"\x00-\x7F"


def _count(inside: str) -> str:
    return f"length(regexp_replace(text, '[^{inside}]+', '', 'g'))"


_SIGN = f"{_count(_ASCII)} - {' - '.join(_count(c) for c in _IN_CLASS)}"
_N = len(_IN_CLASS) + 2

OP13_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS word
  FROM (SELECT rid, [x FOR x IN string_split_regex(text, '{_BLANK}+') IF x <> ''] AS w FROM d)),
n AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY rid),
grams AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER t || ' ' || lead(word, 2) OVER t || ' ' || lead(word, 3) OVER t || ' ' || lead(word, 4) OVER t AS g
  FROM words WINDOW t AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM grams WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS o) GROUP BY rid),
lines AS (SELECT rid, sum(k - 1) AS n_dup_lines FROM (
  SELECT rid, line, count(*) AS k FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line) GROUP BY rid),
base AS MATERIALIZED (SELECT rid, doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, {_count('#*$%&|<>')} AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_words, 0) < {rules.LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {rules.MOST_REPEATED_PERCENT} * n_words AS base_failed, length(text) AS chars,
    [{', '.join(_count(c) for c in _IN_CLASS)}, {_SIGN}, length(text) - {_count(_ASCII)}] AS classes
  FROM d LEFT JOIN n USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
cells AS MATERIALIZED (SELECT rid, 'class' AS kind, CAST(unnest(range({_N})) AS VARCHAR) AS cell, unnest(classes) AS c FROM base
  UNION ALL SELECT rid, 'word', word, count(*) FROM words GROUP BY rid, word),
named AS (SELECT lang FROM base WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {rules.LANGUAGES}),
pooled AS MATERIALIZED (SELECT lang, kind, cell, sum(c) AS c FROM cells JOIN base USING (rid) JOIN named USING (lang) WHERE NOT base_failed GROUP BY lang, kind, cell),
chosen AS MATERIALIZED (SELECT *, c / sum(c) OVER (PARTITION BY lang, kind) AS share, row_number() OVER (PARTITION BY lang, kind ORDER BY c DESC, cell) AS place FROM pooled),
refs AS MATERIALIZED (SELECT lang, kind, cell, share FROM chosen WHERE kind = 'class' OR place <= {rules.COMMON}
  UNION ALL SELECT lang, kind, NULL, coalesce(sum(share) FILTER (place > {rules.COMMON}), 0) FROM chosen WHERE kind = 'word' GROUP BY lang, kind),
-- p: share in the document, q: in the reference
own AS (SELECT r.lang, x.rid, x.kind, r.share AS q, x.c / CASE x.kind WHEN 'class' THEN b.chars ELSE b.n_words END AS p
  FROM cells x JOIN base b USING (rid) JOIN refs r ON r.kind = x.kind AND r.cell = x.cell),
met AS (SELECT lang, rid, kind, sum(p) AS p_met, sum(q) AS q_met,
    sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) AS s FROM own GROUP BY lang, rid, kind),
all_of AS (SELECT lang, kind, sum(share) FILTER (cell IS NOT NULL) AS q_all, coalesce(max(share) FILTER (cell IS NULL), 0) AS q_rest FROM refs GROUP BY lang, kind),
dist AS (SELECT rid, lang, kind, chars, n_words, sqrt(greatest(0, (s
    -- reference cells that the document lacks, then all other words
    + q_all - q_met
    + CASE WHEN rest > 1e-12 THEN rest * log2(2 * rest / (rest + q_rest)) ELSE 0 END
    + CASE WHEN q_rest > 0 THEN q_rest * log2(2 * q_rest / (rest + q_rest)) ELSE 0 END) / 2)) AS js
  FROM (SELECT b.rid, a.lang, a.kind, b.chars, b.n_words, q_all, q_rest, coalesce(s, 0) AS s, coalesce(q_met, 0) AS q_met,
          CASE WHEN a.kind = 'word' THEN 1 - coalesce(p_met, 0) ELSE 0 END AS rest
        FROM base b CROSS JOIN all_of a LEFT JOIN met m ON m.rid = b.rid AND m.lang = a.lang AND m.kind = a.kind WHERE b.n_words > 0)),
near AS (SELECT DISTINCT rid FROM (SELECT rid, lang,
    bool_and(CASE kind WHEN 'class' THEN js <= {rules.CLASS_DISTANCE} OR chars < {rules.CLASS_LEAST} ELSE js <= {rules.WORD_DISTANCE} OR n_words < {rules.WORD_LEAST} END) AS ok
  FROM dist GROUP BY rid, lang) WHERE ok)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (rid IN (SELECT rid FROM near) OR NOT EXISTS (SELECT 1 FROM refs)) AS kept
FROM base"""
