"""Benchmark decontamination by winnowing.

From every ``w`` word k-grams in a row the one of least hash is kept, so two
texts that share ``k + w - 1`` words in a row keep a k-gram in common there:
every sufficiently long shared span is met. Fingerprints of training and test
texts are joined; each hit is extended word by word to both sides, and counts
if it reaches the window. A fingerprint carries the few words around it that
any window over it can hold, so no text is read again. Test texts shorter than
the window are one window each: for each such length all runs of that many
words are fingerprints.

Training fingerprints pass a bit array of fixed size with the test fingerprints
before they are shuffled. Both sides of the join are salted, so a passage that
a third of the documents hold is spread; equal test contexts are one row with
the list of their items.

Defined results: a null or empty text has no words and no hits; null item ids
are left out, items without words too; equal item ids are one item; rows of
equal doc_id are separate; null doc_ids stay null; other columns are not read;
an empty test table leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.key_bits import collect_bits, may_hold, unpacked
from taxaledger.llm.texts import slices
from taxaledger.llm.word_hashes import Words
from taxaledger.session import write_stage

WINDOW = 10
GRAM = 5
SALTS = 16

_MARKS = "array<struct<span: int, hash: long, pos: long, left: int, words: string>>"
_MARK = pa.list_(pa.struct([("span", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("words", pa.string())]))


def kept_grams(words: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of the k-grams that winnowing keeps for shared spans of ``span`` words."""
    grams, w = words.grams(k), span - k + 1
    n = len(words.hash) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for o in range(1, w):
        lower = grams[o : o + n] < least
        least[lower] = grams[o : o + n][lower]
        at[lower] = o
    inside = words.doc[:n] == words.doc[span - 1 :]
    kept = np.unique((np.arange(n) + at)[inside])
    return kept, grams[kept].view(np.int64)


def _marks(words: Words, spans: list[tuple[int, int]], bits: np.ndarray | None) -> list[list[dict]]:
    """The fingerprints of each text with their contexts."""
    out = [[] for _ in range(len(words.first) - 1)]
    for span, k in spans:
        at, hashes = kept_grams(words, span, k)
        if bits is not None:
            held = may_hold(bits, hashes)
            at, hashes = at[held], hashes[held]
        for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
            doc = words.doc[p]
            first, last = int(words.first[doc]), int(words.first[doc + 1])
            a, b = max(first, p - (span - k)), min(last, p + span)
            out[doc].append({"span": span, "hash": h, "pos": p - first, "left": p - a, "words": words.joined(a, b)})
    return out


def fingerprints(texts: DataFrame, spans: list[tuple[int, int]], bits=None) -> DataFrame:
    """(doc_id, rid, n_words, marks) of (doc_id, rid, text); ``bits``: a broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = unpacked(bits.value) if bits is not None else None
        for batch in slices(batches):
            words = Words([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rid"), pa.array(words.counts(), pa.int64()), pa.array(_marks(words, spans, seen), _MARK)],
                ["doc_id", "rid", "n_words", "marks"],
            )

    return texts.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id long, rid long, n_words long, marks {_MARKS}")


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of joined fingerprints whose equal words reach the window."""
    for batch in batches:
        rows = batch.to_pydict()
        rid, begin, end, items = [], [], [], []
        for i in range(batch.num_rows):
            mine, its = rows["words"][i].split(" "), rows["item_words"][i].split(" ")
            a, b, k, span = rows["left"][i], rows["item_left"][i], rows["k"][i], rows["span"][i]
            if mine[a : a + k] != its[b : b + k]:
                continue
            left = next((n for n in range(min(a, b)) if mine[a - 1 - n] != its[b - 1 - n]), min(a, b))
            most = min(len(mine) - a, len(its) - b)
            right = next((n for n in range(k, most) if mine[a + n] != its[b + n]), most)
            if left + right >= span:
                rid.append(rows["rid"][i])
                begin.append(rows["pos"][i] - left)
                end.append(rows["pos"][i] + right)
                items.append(rows["items"][i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["rid", "begin", "end", "items"]
        )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, gram: int = GRAM, row_col: str | None = None) -> DataFrame:
    """(doc_id, n_words, spans array<struct<begin, end>>, items array<string>, rid) of every document.

    Spans are runs of hit words, merged and in order; items are sorted as strings.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"))
    tests = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    tests = write_stage(tests.withColumn("rid", F.monotonically_increasing_id()))

    # The lengths below the window that items have: at most window - 1 numbers.
    counted = fingerprints(tests.select(F.lit(None).cast("long").alias("doc_id"), "rid", "text"), []).select("rid", "n_words")
    short = sorted(r[0] for r in counted.filter((F.col("n_words") > 0) & (F.col("n_words") < window)).select("n_words").distinct().collect())
    spans = [(window, gram), *((n, n) for n in short)]
    k_of = F.when(F.col("span") == window, gram).otherwise(F.col("span"))

    marked = fingerprints(tests.select(F.lit(None).cast("long").alias("doc_id"), "rid", "text"), spans)
    # An item is met by its own length only: short ones whole, others by the window.
    own_span = F.when(F.col("n_words") < window, F.col("n_words")).otherwise(window)
    contexts = (
        marked.select("rid", own_span.alias("own"), F.explode("marks").alias("m")).filter(F.col("m.span") == F.col("own"))
        .join(tests.select("rid", "item"), "rid")
        .groupBy(F.col("m.span").alias("span"), F.col("m.hash").alias("hash"), F.col("m.left").alias("item_left"), F.col("m.words").alias("item_words"))
        .agg(F.collect_set("item").alias("items"))
    )
    contexts = write_stage(contexts)
    bits = spark.sparkContext.broadcast(collect_bits(contexts.select("hash")))

    texts = write_stage(fingerprints(own, spans, bits))
    salt = F.pmod(F.hash("rid", "pos"), F.lit(SALTS))
    marks = texts.select("rid", F.inline("marks")).withColumn("salt", salt)
    salted = contexts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = marks.join(salted, ["span", "hash", "salt"]).withColumn("k", k_of)
    hits = met.select("rid", "pos", "left", "words", "item_left", "item_words", "items", "k", "span").mapInArrow(_extended, "rid long, begin long, end long, items array<string>")
    merged = F.expr("""aggregate(array_sort(collect_set(struct(begin, end))), cast(array() as array<struct<begin: bigint, end: bigint>>), (acc, s) ->
        if(size(acc) > 0 and s.begin <= element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(s))))""")
    per_text = hits.groupBy("rid").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return texts.select("rid", "doc_id", "n_words").join(per_text, "rid", "left").select(
        "doc_id", "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "rid",
    )


def digests(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(words), {WINDOW}) AS n, unnest([array_to_string(words[s:s + least(len(words), {WINDOW}) - 1], ' ') FOR s IN range(1, greatest(1, len(words) - {WINDOW} + 1) + 1)]) AS win
  FROM i WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM iw),
starts AS (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, lengths WHERE len(words) >= n),
dw AS (SELECT rid, n, s, array_to_string(words[s:s + n - 1], ' ') AS win FROM starts),
hits AS (SELECT rid, s, n, item FROM dw JOIN iw USING (n, win)),
per AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (rid) LEFT JOIN its USING (rid)"""
