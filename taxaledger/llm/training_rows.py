"""Bounded, balanced training rows for the classifiers; their texts are taken whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaledger.session import write_stage


def thinned(marks: DataFrame, per_label: int, *key: str) -> DataFrame:
    """About 1.2 times ``per_label`` rows of each ``label``, chosen by a hash of ``key``, which becomes ``dice``."""
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    counts = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    share: Column = F.lit(0.0)
    if counts:
        share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.2 * per_label / n)))])[F.col("label")]
    dice = F.pmod(F.xxhash64(*key, F.lit("training rows")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return marks.withColumn("dice", dice).filter(F.col("dice") < share)


def training_texts(chosen: DataFrame, per_label: int, chars: int) -> list[tuple]:
    """(label, text) of thinned rows (label, dice, text).

    Bounds, by label: 1.5 times ``per_label`` rows (only ids or texts that
    repeat reach it) and ``chars`` characters in all. A row is taken whole or
    not at all; one of more than a quarter of ``chars`` is not taken.
    """
    size = F.length("text")
    taken = write_stage(chosen.filter((size > 0) & (size <= chars // 4)).select("label", "dice", "text"))
    order = Window.partitionBy("label").orderBy("dice", "text").rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for label in sorted(r[0] for r in taken.select("label").distinct().collect()):
        rows = taken.filter(F.col("label") == F.lit(label)).orderBy("dice", "text").limit(int(1.5 * per_label))
        rows = rows.withColumn("so_far", F.sum(size).over(order)).filter(F.col("so_far") <= chars)
        out += [(label, r[0]) for r in rows.orderBy("dice", "text").select("text").collect()]
    return out
