"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query. The postings of
the trigrams in use (trigram, doc_id) are written once; each clause intersects
its postings by counting them per document; candidates are verified by the
expression itself. Rules without a mandatory trigram scan every text.

Postings hold only trigrams that a rule asks for, so their number per document
is bounded by the rules, whatever its length. Candidates are written before the
join, so Spark sees their size: few are broadcast, many are joined by a shuffle.

Defined results: a null or empty text has no spans; rows with a null doc_id are
verified against every rule; rows of equal doc_id share candidates and are each
verified; positions count code points, ends are exclusive; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.trigram_query import ANY, trigram_query
from taxaledger.session import write_stage


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order of their kinds. In the second and third the
#: length is part of the pattern: a run of such letters that is too short has no
#: long enough part, so the matches are those of the open pattern, less the short.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Further kinds of well-known form.
RULES = (*BASE, Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), Rule("webhook", r"https://hooks\.[a-z]+\.com/services/[A-Za-z0-9/]{20,}"))

#: Matches per step of the running length.
_STEP = 256


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of a rule's matches in the column ``text``.

    The texts between matches and the matches alternate; a start is the running
    length of both, summed in steps so that it is linear in the matches.
    """
    pattern = _quoted(rule.pattern)
    found = f"""transform(array(named_struct(
        'gap', transform(split({text}, {pattern}, -1), x -> length(x)),
        'hit', transform(regexp_extract_all({text}, {pattern}, 0), x -> length(x)),
        'val', transform(regexp_extract_all({text}, {pattern}, {rule.group}), x -> length(x)))),
        s -> named_struct('gap', s.gap, 'hit', s.hit, 'val', s.val, 'both', zip_with(slice(s.gap, 1, size(s.hit)), s.hit, (g, h) -> g + h)))"""
    sums = f"""transform({found}, s -> named_struct('gap', s.gap, 'hit', s.hit, 'val', s.val, 'both', s.both,
        'step', transform(sequence(0, (size(s.hit) - 1) div {_STEP}), b -> aggregate(slice(s.both, cast(b * {_STEP} + 1 as int), {_STEP}), 0, (a, x) -> a + x))))"""
    runs = f"""transform({sums}, s -> named_struct('gap', s.gap, 'hit', s.hit, 'val', s.val, 'both', s.both,
        'before', transform(s.step, (x, b) -> aggregate(slice(s.step, 1, b), 0, (a, y) -> a + y))))"""
    spans = f"""flatten(transform({runs}, s -> transform(s.hit, (h, i) -> named_struct(
        'start', element_at(s.before, cast(i div {_STEP} + 1 as int)) + aggregate(slice(s.both, cast((i div {_STEP}) * {_STEP} + 1 as int), i % {_STEP}), 0, (a, x) -> a + x) + s.gap[i],
        'hit', h, 'val', s.val[i]))))"""
    kept = f"filter({spans}, x -> x.val >= {rule.least})"
    return F.expr(f"transform({kept}, x -> named_struct('start', x.start, 'number', {number}, 'end', x.start + x.hit))")


_NO_SPANS = "cast(array() as array<struct<start: int, number: int, end: int>>)"


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(gram, doc_id) for every trigram that a rule's query holds."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for g in clause})
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("_folded"), g))
    folded = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("_folded"))
    return folded.select("doc_id", F.explode(present).alias("gram")).select("gram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules array<int>): intersected postings of each clause."""
    clauses = [(n, clause) for n, r in enumerate(rules) for clause in sorted(trigram_query(r.pattern), key=sorted) if clause]
    asked: dict[str, list[int]] = {}
    for k, (_, clause) in enumerate(clauses):
        for g in clause:
            asked.setdefault(g, []).append(k)
    if not clauses:
        return index.select("doc_id", F.array(F.lit(0)).alias("rules")).limit(0)
    of_gram = F.create_map(*[x for g, ks in sorted(asked.items()) for x in (F.lit(g), F.array(*map(F.lit, ks)))])
    needs = F.array(*[F.lit(len(clause)) for _, clause in clauses])
    rule_of = F.array(*[F.lit(n) for n, _ in clauses])
    met = (
        index.select("gram", "doc_id").distinct()
        .select("doc_id", F.explode(of_gram[F.col("gram")]).alias("clause"))
        .groupBy("doc_id", "clause").agg(F.count("*").alias("n"))
        .filter(F.col("n") == needs[F.col("clause")])
    )
    return met.groupBy("doc_id").agg(F.collect_set(rule_of[F.col("clause")]).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, spans, _keep0, ...): spans are sorted by start, then rule number."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(f"`{k}`").alias(f"_keep{i}") for i, k in enumerate(keep)])
    asked = write_stage(candidates(write_stage(postings(own, rules)), rules)).withColumnRenamed("doc_id", "_id")
    joined = own.join(asked, F.col("doc_id") == F.col("_id"), "left")
    everything = F.array(*[F.lit(n) for n in range(len(rules))])
    to_check = F.when(F.col("doc_id").isNull(), everything).otherwise(F.col("rules"))
    found = []
    for n, rule in enumerate(rules):
        full = trigram_query(rule.pattern) == ANY
        due = F.lit(True) if full else F.coalesce(F.array_contains(to_check, n), F.lit(False))
        found.append(F.when(due & F.col("text").rlike(rule.pattern), spans_of("text", rule, n)).otherwise(F.expr(_NO_SPANS)))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"), *[f"_keep{i}" for i in range(len(keep))])


def said(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each row of ``scan``."""
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["number"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def masked(mask: str = "[removed]") -> Column:
    """``text`` of a row of ``scan`` with every span replaced; overlapping spans count as one."""
    merged = """aggregate(spans, cast(array() as array<struct<a: int, b: int>>), (acc, s) ->
        if(size(acc) > 0 and s.start < element_at(acc, -1).b,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.end)))),
           concat(acc, array(named_struct('a', s.start, 'b', s.end)))))"""
    return F.expr(f"""if(size(spans) = 0, text, transform(array({merged}), m -> concat(
        array_join(transform(m, (s, i) -> concat(substring(text, if(i = 0, 0, get(m, i - 1).b) + 1, s.a - if(i = 0, 0, get(m, i - 1).b)), {_quoted(mask)})), ''),
        substring(text, element_at(m, -1).b + 1)))[0])""")
