"""Accepted name and distribution of a name, from the checklists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_tokens, match_key, trimmed
from ..sources.bases import NameSource, status_meaning


def accepted_names(source: NameSource) -> DataFrame:
    """``mk, acceptedName``: the one accepted name of each synonym key.

    A key that is also an accepted name (a homonym), or whose synonym rows
    disagree, has none: a wrong accepted name is worse than no name.
    """
    column = source.accepted_column
    status = status_meaning(source, F.col("taxonomicStatus"))
    base = source.table.select(
        "mk", "seq", status.alias("status"), trimmed(column).alias("acceptedName")
    )
    is_accepted = F.coalesce(F.col("status").isin("accepted", "valid"), F.lit(False))
    is_synonym = F.coalesce((F.col("status") == "synonym") & (F.col("acceptedName") != ""), F.lit(False))
    # One aggregate instead of an anti join: the agreement test needs only the
    # least and the greatest key.
    key = F.when(is_synonym, match_key("acceptedName"))
    grouped = base.groupBy("mk").agg(
        F.max(is_accepted).alias("homonym"),
        F.min(key).alias("low"), F.max(key).alias("high"),
        F.min_by("acceptedName", F.when(is_synonym, F.col("seq"))).alias("acceptedName"),
    )
    return grouped.where(~F.col("homonym") & (F.col("low") == F.col("high"))).select("mk", "acceptedName")


def knows_accepted_names(sources: Sequence[NameSource]) -> bool:
    return any(s.accepted_column is not None for s in sources)


def agreed_accepted_names(sources: Sequence[NameSource]) -> DataFrame:
    """``mk, acceptedName`` where all sources that answer agree on one name."""
    answers = [
        accepted_names(s).withColumn("_ord", F.lit(i))
        for i, s in enumerate(sources) if s.accepted_column is not None
    ]
    if not answers:
        raise ValueError("no source knows accepted names")
    stacked = reduce(DataFrame.unionByName, answers).withColumn("_key", match_key("acceptedName"))
    grouped = stacked.groupBy("mk").agg(
        F.min("_key").alias("low"), F.max("_key").alias("high"),
        F.min_by("acceptedName", "_ord").alias("acceptedName"),
    )
    return grouped.where("low = high").select("mk", "acceptedName")


def distribution_tokens(source: NameSource) -> DataFrame:
    """``mk, states, biomes``: tokens over all rows of a key, sorted."""
    base = source.table
    tokens = base.select(
        "mk",
        F.explode(
            F.concat(
                F.transform(list_tokens("states"), lambda t: F.struct(F.lit("s").alias("d"), t.alias("t"))),
                F.transform(list_tokens("biome"), lambda t: F.struct(F.lit("b").alias("d"), t.alias("t"))),
            )
        ).alias("x"),
    )
    return _union_tokens(tokens.select("mk", "x.d", "x.t"))


def _union_tokens(tokens: DataFrame) -> DataFrame:
    """Distinct tokens per key; a vocabulary of places bounds each list."""
    return tokens.groupBy("mk").agg(
        F.sort_array(F.collect_set(F.when(F.col("d") == "s", F.col("t")))).alias("states"),
        F.sort_array(F.collect_set(F.when(F.col("d") == "b", F.col("t")))).alias("biomes"),
    )


def distributions(sources: Sequence[NameSource]) -> DataFrame:
    """Distribution per key over every source that has one."""
    held = [distribution_tokens(s) for s in sources if s.distribution]
    if not held:
        raise ValueError("no source has a distribution")
    flat = [
        d.select("mk", F.explode(F.concat(
            F.transform("states", lambda t: F.struct(F.lit("s").alias("d"), t.alias("t"))),
            F.transform("biomes", lambda t: F.struct(F.lit("b").alias("d"), t.alias("t"))),
        )).alias("x")).select("mk", "x.d", "x.t")
        for d in held
    ]
    return _union_tokens(reduce(DataFrame.unionByName, flat))


def _joined(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.array_join(tokens, ";"))


def lookup_distribution(names: DataFrame, table: DataFrame) -> DataFrame:
    """``query_name, states, biomes`` per name, null where nothing is known."""
    out = names.withColumn("mk", match_key("query_name")).join(table, "mk", "left")
    return out.select("query_name", _joined(F.col("states")).alias("states"), _joined(F.col("biomes")).alias("biomes"))


def lookup_accepted(names: DataFrame, table: DataFrame) -> DataFrame:
    """``query_name, acceptedName`` per name."""
    keyed = names.withColumn("mk", match_key("query_name"))
    return keyed.join(table, "mk", "left").select(*names.columns, "acceptedName")
