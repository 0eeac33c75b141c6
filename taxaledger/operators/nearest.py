"""The closest name of each source to names that no exact key answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.bases import NameSource
from .answers import fuzzy_targets
from .fuzzy import REMNANT_EDITS, edit_budget, is_short, remnant_pairs, segment_pairs


def fuzzy_best(queries: DataFrame, sources: Sequence[NameSource]) -> DataFrame:
    """Closest name per query and source: distance, non-synonym, source order.

    ``queries`` has ``query_name`` and ``ask``, a bit per source. Short queries
    are searched one edit at a time: what a source answers within one edit is
    not searched in it within two, where names of a crowded genus have many
    more neighbours.
    """
    # Read in each round, and for the rows behind the chosen names.
    targets = write_stage(reduce(
        DataFrame.unionByName,
        [fuzzy_targets(s).withColumn("src", F.lit(i)) for i, s in enumerate(sources)],
    ))
    budgets = {s.max_distance for s in sources}
    if len(budgets) != 1:
        raise ValueError("sources resolved together must share one max_distance")
    most = budgets.pop()
    # Sources share most spellings: each is searched once, with a bit per source.
    spellings = write_stage(targets.where(F.col("target").isNotNull()).groupBy("target").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("src"))).alias("srcs")))
    asked = F.col("ask").bitwiseAND(F.col("srcs")) != 0

    def closest(pairs: DataFrame) -> DataFrame:
        slim = targets.select("target", "synonym", "seq", "src")
        met = pairs.drop("srcs").join(slim, "target").where(F.getbit(F.col("ask"), F.col("src")) == 1)
        return met.groupBy("query_name", "src").agg(F.min(F.struct("distance", "synonym", "seq", "target")).alias("_near"))

    queries = write_stage(queries)
    short = is_short(F.col("query_name"), most)
    rounds, left = [], queries.where(short)
    for edits in range(1, REMNANT_EDITS + 1):
        if rounds:
            answered = rounds[-1].groupBy("query_name").agg(
                F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("src"))).alias("_had"))
            left = left.join(answered, "query_name", "left").withColumn(
                "ask", F.col("ask").bitwiseAND(F.bitwise_not(F.coalesce("_had", F.lit(0))))).drop("_had")
            left = write_stage(left.where((F.col("ask") != 0) & (edit_budget(F.col("query_name"), most) >= edits)))
        pairs = remnant_pairs(left, spellings, "query_name", "target", edits, most, keep=asked)
        rounds.append(write_stage(closest(pairs.distinct())))
    long = queries.where(~short)
    if not long.isEmpty():
        rounds.append(closest(segment_pairs(long, spellings, "query_name", "target", most, keep=asked).distinct()))
    nearest = reduce(DataFrame.unionByName, rounds)
    found = nearest.select("query_name", "src", F.col("_near.target").alias("target"),
                           F.col("_near.distance").alias("distance"), F.col("_near.seq").alias("seq"))
    return found.join(targets.select("src", "target", "seq", "row"), ["src", "target", "seq"])
