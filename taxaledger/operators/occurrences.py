"""Occurrence points: parsing, taxon roll-up, duplicates, counts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_filled
from ..session import write_stage
from .joins import first_per_key, hot_keys, lookup_join, split_join

# A record belongs to a search on any of these keys.
TAXON_FIELDS = (
    "taxonKey", "acceptedTaxonKey", "kingdomKey", "phylumKey", "classKey",
    "orderKey", "familyKey", "genusKey", "speciesKey",
)


def parse_occurrences(df: DataFrame) -> DataFrame:
    """Numeric coordinates, text keys; rows lacking a coordinate are dropped."""
    keys = [F.col(c).cast("string").alias(c) for c in TAXON_FIELDS if c in df.columns]
    return df.select(
        F.col("decimalLongitude").try_cast("double").alias("decimalLongitude"),
        F.col("decimalLatitude").try_cast("double").alias("decimalLatitude"),
        F.col("datasetKey").cast("string").alias("datasetKey"),
        F.col("key").cast("string").alias("key"),
        *keys,
    ).dropna(subset=["decimalLongitude", "decimalLatitude"])


def by_taxon(occ: DataFrame) -> DataFrame:
    """One row per record and distinct taxon key: children count for parents."""
    fields = [c for c in TAXON_FIELDS if c in occ.columns]
    keys = F.filter(F.array_distinct(F.array(*fields)), lambda k: is_filled(k))
    return occ.select(*[c for c in occ.columns if c not in fields], F.explode(keys).alias("taxon"))


def dedupe(points: DataFrame, group: list[str]) -> DataFrame:
    """One row per record within a group (area and taxon).

    By ``key`` where every row of the group has one, else by the whole row; the
    least coordinates and dataset win. Groups with a keyless row are rare, so
    they are found first and every row then carries its own identity.
    """
    keyless = points.where(~is_filled("key")).select(*group).distinct().withColumn("_whole", F.lit(True))
    rest = [c for c in points.columns if c not in group]
    marked = lookup_join(points, write_stage(keyless), group)
    same = F.when(F.col("_whole"), F.to_json(F.struct(*rest))).otherwise(F.col("key"))
    marked = marked.select(*points.columns, same.alias("_id"))
    order = [F.col(c) for c in ("decimalLongitude", "decimalLatitude", "datasetKey")]
    return first_per_key(marked, [*group, "_id"], order, rest).select(*points.columns)


def distinct_counts(points: DataFrame, group: list[str]) -> DataFrame:
    """Records per group after ``dedupe``, without building the rows."""
    rest = [c for c in points.columns if c not in group]
    slim = points.select(*group, F.when(is_filled("key"), F.col("key")).alias("_k"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])
    # Two levels: first one row per identity, then the group.
    return (
        slim.groupBy(*slim.columns).agg(F.lit(1).alias("_one"))
        .groupBy(*group, "_k").agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*group).agg(
            F.count(F.lit(1)).alias("_ids"), F.sum("_rows").alias("_rows"),
            F.max(F.col("_k").isNull()).alias("_keyless"),
        )
        .select(*group, F.when(F.col("_keyless"), F.col("_rows")).otherwise(F.col("_ids")).alias("gbif_count"))
    )


def taxon_counts(points: DataFrame) -> DataFrame:
    """``area, taxon, n``: raw records per taxon, children counted in parents."""
    return by_taxon(points).groupBy("area", "taxon").agg(F.count(F.lit(1)).alias("n"))


def first_page(points: DataFrame, group: list[str], page: int) -> DataFrame:
    """At most ``page`` records per group, with ``gbif_status``.

    A service that pages answers hands out no more than this; the status says
    whether the group was cut. The per-key limit is applied before the shuffle
    (``row_number() <= n`` becomes a group limit), the totals are an aggregate.
    """
    order = Window.partitionBy(*group).orderBy("key", "decimalLongitude", "decimalLatitude", "datasetKey")
    kept = points.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= page).drop("_rn")
    totals = points.groupBy(*group).agg(
        F.when(F.count(F.lit(1)) > page, "truncated").otherwise("complete").alias("gbif_status")
    )
    return kept.join(totals, group)


def points_of_names(points: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """Points of the asked taxa, labelled with the name that asked.

    ``points`` comes from ``by_taxon``; ``wanted`` has the group columns and
    ``scientificName``. A taxon may hold most of the records, so its rows are
    split over tasks.
    """
    asked = wanted.select(*group, "scientificName").distinct()
    hot = hot_keys(points, group)
    return split_join(points, asked, group, hot, how="inner", nulls=False).withColumnRenamed("scientificName", "species")


def map_points(points: DataFrame, species: DataFrame | None = None, areas: list[str] | None = None) -> DataFrame:
    """Points limited to selected species and areas; no selection keeps all."""
    out = points
    if species is not None:
        out = out.join(species.select("species").distinct(), "species", "left_semi")
    if areas:
        out = out.where(F.col("area").isin(*areas))
    return out
