"""Which record belongs to which study area, and which names each area holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.text import area_key, area_slug, is_filled, trimmed
from ..session import write_stage
from .joins import first_per_key, hot_keys, lookup_join


def locality_owners(areas: DataFrame) -> DataFrame:
    """``locality_key, area``: a locality claimed by two areas belongs to none."""
    claims = areas.select("area", F.explode("localities").alias("locality")).where(is_filled("locality"))
    return (
        claims.groupBy(area_key("locality").alias("locality_key"))
        .agg(F.min("area").alias("area"), F.max("area").alias("_other"))
        .where(F.col("area") == F.col("_other"))
        .drop("_other")
    )


def link_localities(localities: DataFrame, areas: DataFrame, locality: str = "locality") -> DataFrame:
    """Adds ``area`` to a table with a locality column.

    Without any locality link, a single area claims everything and several areas
    claim nothing; the record count never changes.
    """
    has_column = locality in localities.columns
    facts = areas.agg(
        F.count(F.lit(1)).alias("n"), F.min("area").alias("only"),
        F.max(F.size(F.filter("localities", lambda x: is_filled(x))) > 0).alias("linked"),
    )
    fallback = facts.select(
        F.when((F.col("n") == 1) & (F.lit(not has_column) | ~F.coalesce("linked", F.lit(False))), F.col("only"))
    ).scalar()
    if not has_column:
        return localities.withColumn("area", fallback)
    owners = locality_owners(areas)
    keyed = localities.withColumn("_lk", area_key(locality))
    linked = keyed.join(owners.withColumnRenamed("locality_key", "_lk"), "_lk", "left").drop("_lk")
    return linked.withColumn("area", F.coalesce("area", fallback))


def assign_areas(records: DataFrame, areas: DataFrame, locality: str = "locality") -> DataFrame:
    """Adds ``area`` to records: the few distinct localities are linked once.

    Localities repeat on millions of records, so the link is resolved per
    distinct locality and joined back.
    """
    if locality not in records.columns:
        return link_localities(records, areas, locality)
    weights = records.groupBy(locality).agg(F.count(F.lit(1)).alias("_w"))
    linked = write_stage(link_localities(weights, areas, locality))
    return lookup_join(
        records, linked.drop("_w"), [locality], hot=hot_keys(linked, [locality], weight="_w")
    )


def unlinked_localities(linked: DataFrame, locality: str = "locality") -> DataFrame:
    """Distinct localities of records that no area claims, sorted."""
    orphan = linked.where(F.col("area").isNull() & is_filled(locality))
    return orphan.select(trimmed(locality).alias(locality)).distinct().sort(locality)


def accepted_name_map(names: DataFrame, cascade: DataFrame) -> DataFrame:
    """``query_name, scientificName``: the resolved name, else the typed one.

    ``names`` has ``scientificName, query_name, seq``, one row per typed name;
    the first typed form of a name wins.
    """
    blank = F.coalesce(F.col("scientificName"), F.lit("")) == ""
    resolved = cascade.select(
        "query_name", F.when(blank, F.col("query_name")).otherwise(F.col("scientificName")).alias("_acc")
    )
    typed = first_per_key(
        names.where(is_filled("query_name")), ["query_name"], [F.col("seq")], ["scientificName"]
    )
    both = typed.join(resolved, "query_name", "full")
    return both.select("query_name", F.coalesce("_acc", "scientificName").alias("scientificName"))


def names_by_area(pairs: DataFrame, name_map: DataFrame) -> DataFrame:
    """``area, query_name, scientificName``: distinct names each area verifies.

    ``pairs`` has ``area, query_name`` (any number of rows per pair).
    """
    held = pairs.where(is_filled("area") & is_filled("query_name")).select("area", "query_name").distinct()
    return held.join(name_map, "query_name", "left").select(
        "area", "query_name",
        F.when(F.coalesce(F.col("scientificName"), F.lit("")) == "", F.col("query_name"))
        .otherwise(F.col("scientificName")).alias("scientificName"),
    )


def merge_areas(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace areas of the same slug in place, append the new ones.

    Both have ``area, seq`` and any other columns; the result keeps the position
    of a replaced area and numbers the new ones behind the held ones.
    """
    last = held.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m"))
    both = held.withColumn("_round", F.lit(0)).unionByName(
        incoming.withColumn("_round", F.lit(1)).withColumn("seq", F.col("seq") + 1 + last.scalar())
    ).withColumn("_slug", area_slug("area"))
    content = [c for c in held.columns if c != "seq"]
    merged = both.groupBy("_slug").agg(
        F.min("seq").alias("seq"),
        F.max_by(F.struct(*content), F.struct("_round", "seq")).alias("_a"),
    )
    return merged.select(*[F.col("seq") if c == "seq" else F.col(f"_a.{c}").alias(c) for c in held.columns])


def drop_area(held: DataFrame, slug: str) -> DataFrame:
    return held.where(area_slug("area") != slug)


def named_areas(areas: DataFrame) -> DataFrame:
    """Give areas without a name a default one, numbered when there are several."""
    count = areas.agg(F.count(F.lit(1)).alias("n")).scalar()
    default = F.when(count == 1, "Área de estudo").otherwise(
        F.concat(F.lit("Área "), (F.col("seq") + 1).cast("string"))
    )
    return areas.withColumn(
        "area", F.when(F.coalesce(F.col("area"), F.lit("")) == "", default).otherwise(F.col("area"))
    )


def typed_names(records: DataFrame, name_col: str = "scientificName", seq: str = "record_id") -> DataFrame:
    """``scientificName, query_name, seq``: one row per typed name."""
    raw = records.groupBy(F.col(name_col).alias("scientificName")).agg(F.min(seq).alias("seq"))
    return raw.where(is_filled("scientificName")).select(
        "scientificName", normalize_name("scientificName").alias("query_name"), "seq"
    )
