"""Check every (area, name) pair against occurrences and distribution.

One plan for all areas: ``area`` is a column from the first step on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import dimension_match, distribution_flag, presence
from ..functions.text import match_key
from ..operators.accepted import distributions
from ..operators.joins import fits_broadcast, lookup_join
from ..operators.occurrences import (
    by_taxon, dedupe, distinct_counts, first_page, points_of_names,
)
from ..operators.spatial import (
    area_cells, area_zone, areas_over_regions, points_near, region_lists,
)
from ..operators.threat import backbone_keys
from ..schema import BUFFER_METRES
from ..session import write_stage
from ..sources.bases import BACKBONE, NameSource


@dataclass(frozen=True)
class GeoResult:
    """``per_species``: one row per (area, name); ``areas``: region lists per
    area; ``points``: the taxon-labelled points behind the counts."""

    per_species: DataFrame
    areas: DataFrame
    points: DataFrame
    wanted: DataFrame


def buffer_cells(area_parts: DataFrame, metres: float = BUFFER_METRES) -> DataFrame:
    """The written cell table of the areas, each in its own metric zone."""
    # Read for the cells near edges and for those inside.
    zoned = write_stage(area_parts.join(area_zone(area_parts), "area"))
    # Edges are few bytes and many cells: by their size they would go to too few tasks.
    tasks = 4 * area_parts.sparkSession.sparkContext.defaultParallelism
    return write_stage(area_cells(zoned.repartition(tasks, "area"), metres))


def occurrences_near(occ: DataFrame, cells: DataFrame, metres: float = BUFFER_METRES) -> DataFrame:
    """``area`` and the parsed occurrence columns, once per record and area."""
    return points_near(occ, cells, metres)


def verify_distribution(
    area_parts: DataFrame, names: DataFrame, occ: DataFrame, region_parts: DataFrame,
    sources: Sequence[NameSource], metres: float = BUFFER_METRES,
    page: int | None = None, coverage: DataFrame | None = None,
) -> GeoResult:
    """``names`` has ``area, query_name, scientificName`` (distinct pairs).

    ``page`` reproduces a service that returns at most that many records per
    taxon; the default counts every record. ``coverage`` (``area, taxon,
    status``) marks taxa whose records could not be had (``failed``) or only in
    part (``truncated``): no point found then means "not known", not "absent".
    So does a missing backbone, without which no name has a taxon.
    """
    backbone = next((s for s in sources if s.kind == BACKBONE), None)
    if backbone is None:
        wanted = write_stage(names.withColumn("taxon", F.lit(None).cast("string")))
    else:
        accepted = names.select("scientificName").distinct()
        keys = backbone_keys(accepted, backbone).select("scientificName", F.col("occurrenceKey").alias("taxon"))
        wanted = write_stage(names.join(keys, "scientificName", "left"))
    taxa = wanted.where(F.col("taxon").isNotNull()).select("area", "taxon").distinct()

    near = by_taxon(occurrences_near(occ, buffer_cells(area_parts, metres), metres))
    taxa = write_stage(taxa)
    if not fits_broadcast(taxa):
        # The split join looks at its left side twice; scan the occurrences once.
        near = write_stage(near)
    found = lookup_join(near, taxa, ["area", "taxon"], how="left_semi", nulls=False)
    if page is not None:
        found = first_page(found, ["area", "taxon"], page)
        cut = found.select("area", "taxon", "gbif_status").distinct()
        found = found.drop("gbif_status")
    found = write_stage(found)
    counts = distinct_counts(found, ["area", "taxon"])

    rows = wanted.join(counts, ["area", "taxon"], "left")
    status = F.lit("failed" if backbone is None else "complete")
    if page is not None:
        rows = rows.join(cut, ["area", "taxon"], "left")
        status = F.coalesce("gbif_status", status)
    if coverage is not None:
        rows = rows.join(coverage.select("area", "taxon", F.col("status").alias("_cov")), ["area", "taxon"], "left")
        status = F.coalesce("_cov", status)

    places = region_lists(area_parts, areas_over_regions(area_parts, region_parts))
    rows = rows.join(places, "area", "left")
    if any(s.distribution for s in sources):
        dist = distributions(sources).select(F.col("mk").alias("_mk"), "states", "biomes")
        rows = rows.withColumn("_mk", match_key("scientificName")).join(dist, "_mk", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("array<string>") for c in ("states", "biomes")})
    rows = rows.withColumn("gbif_status", status).withColumn(
        "_n", F.coalesce("gbif_count", F.lit(0))
    )
    unknown = (F.col("gbif_status") != "complete") & (F.col("_n") == 0)
    none = F.array().cast("array<string>")
    rows = rows.select(
        "area", "query_name", "scientificName",
        F.when(~unknown, F.col("_n") > 0).alias("has_gbif"),
        F.when(~unknown, F.col("_n")).cast("int").alias("gbif_count"),
        (F.col("gbif_status") == "failed").alias("gbif_failed"),
        "gbif_status",
        dimension_match(F.col("area_states"), F.coalesce("states", none)).alias("state_match"),
        dimension_match(F.col("area_biomes"), F.coalesce("biomes", none)).alias("biome_match"),
    )
    rows = rows.withColumn("present", presence("state_match", "biome_match"))
    rows = rows.withColumn("distributionFlag", distribution_flag("has_gbif", "present"))
    return GeoResult(per_species=rows, areas=places, points=found, wanted=wanted)


def geo_points(geo: GeoResult) -> DataFrame:
    """The points of every verified name, one row per record, area and name."""
    asked = geo.wanted.where(F.col("taxon").isNotNull()).select("area", "taxon", "scientificName").distinct()
    points = points_of_names(dedupe(geo.points, ["area", "taxon"]), asked, ["area", "taxon"])
    return points.drop("taxon")


def union_over_areas(geo: GeoResult) -> DataFrame:
    """One row: sorted states and biomes over all areas, and names not checked."""
    a = geo.areas.select(F.explode_outer("area_states").alias("s"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("f"))
    b = geo.areas.select(F.lit(None).cast("string").alias("s"), F.explode_outer("area_biomes").alias("b"), F.lit(None).cast("string").alias("f"))
    f = geo.per_species.where("gbif_failed").select(
        F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("b"), F.col("scientificName").alias("f")
    )
    return a.unionByName(b).unionByName(f).agg(
        *[F.sort_array(F.collect_set(c)).alias(n) for c, n in (("s", "area_states"), ("b", "area_biomes"), ("f", "gbif_failed"))]
    )
