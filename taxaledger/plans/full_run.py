"""The whole run: records and areas in, standardized tables out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import invasive_key
from ..functions.text import is_filled
from ..operators.area_links import (
    accepted_name_map, link_localities, names_by_area, unlinked_localities,
)
from ..operators.audit import attach_geo, attach_invasive, audit_table, original_names, unresolved
from ..operators.joins import hot_keys
from ..operators.records import answers_for, name_weights, names_to_resolve, parsed_names, standardize
from ..operators.results import run_summary, view_answers, view_of
from ..operators.threat import invasive_lookup, threatened_for_names
from ..session import write_stage
from ..sources.bases import NameSource, store_sources
from .resolve import resolve_names, source_failures
from .threat_status import threat_status
from .verify import GeoResult, verify_distribution


@dataclass(frozen=True)
class Reference:
    """The tables a run checks against."""

    sources: Sequence[NameSource]
    threatened: DataFrame
    invasive: DataFrame
    redlist_by_key: DataFrame | None = None
    assessments: DataFrame | None = None


@dataclass(frozen=True)
class Geography:
    """Study areas (``area, localities``), their parts, regions, occurrences."""

    areas: DataFrame
    area_parts: DataFrame
    region_parts: DataFrame
    occurrences: DataFrame


@dataclass(frozen=True)
class RunResult:
    cascade: DataFrame
    standardized: DataFrame
    audit: DataFrame
    geo: GeoResult | None
    linked: DataFrame
    failures: DataFrame
    make_view: Callable[[], DataFrame]

    @property
    def unresolved(self) -> DataFrame:
        return unresolved(self.audit)

    @property
    def unlinked(self) -> DataFrame:
        return unlinked_localities(self.linked)

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.standardized, self.cascade, self.geo.per_species if self.geo else None)

    @property
    def view(self) -> DataFrame:
        return self.make_view()


def run_all(records: DataFrame, reference: Reference, geography: Geography | None = None,
            seq: str = "record_id", model_columns: list[str] | None = None) -> RunResult:
    """Standardize, audit and verify a table of records.

    The records are read twice: once reduced to their distinct (name, locality)
    pairs, on which all the work happens, and once to write the answers back in
    a single join. ``standardized`` carries ``area`` behind the model columns
    when areas are given.
    """
    model = list(model_columns or [c for c in records.columns if c != seq])
    keys = ["scientificName", *(["locality"] if geography and "locality" in records.columns else [])]
    pairs = write_stage(name_weights(records, keys, seq))
    sources, failures = store_sources(reference.sources)
    typed = parsed_names(pairs)
    fresh = typed.where(F.col("new_seq").isNotNull())
    cascade = resolve_names(names_to_resolve(typed), sources)
    cascade = write_stage(threat_status(
        write_stage(cascade), reference.threatened, sources, reference.redlist_by_key, reference.assessments
    ))

    names = typed.where(is_filled("query_name")).select("query_name").distinct()
    listed = threatened_for_names(names, reference.threatened, sources, "query_name", normalized=True)
    # The list key is written with the map: keeping only the hits would else
    # repeat the name parsing in the filter of the join.
    name_map = accepted_name_map(typed.where(is_filled("scientificName")), cascade)
    name_map = write_stage(name_map.withColumn("_key", invasive_key("scientificName")))
    invasive = write_stage(
        invasive_lookup(name_map, reference.invasive, key="_key").where("invasive").select("query_name", "invasiveSource")
    )
    name_map = name_map.drop("_key")

    # Names are parsed once each; the pairs, several to a name, take the parsed one along.
    geo, linked = None, pairs.join(typed.select("scientificName", "query_name"), "scientificName", "left")
    if geography is not None:
        linked = write_stage(link_localities(linked, geography.areas))
        geo = verify_distribution(
            geography.area_parts, names_by_area(linked, name_map), geography.occurrences,
            geography.region_parts, sources,
        )
        geo = GeoResult(write_stage(geo.per_species), write_stage(geo.areas), geo.points, geo.wanted)

    answers = write_stage(answers_for(
        linked, cascade, listed, invasive, geo.per_species.select("area", "query_name", "distributionFlag") if geo else None
    ))
    keep = (seq, *(("area",) if geo else ()))
    hot = hot_keys(answers, keys, weight="n")
    standardized = standardize(records, answers, keys, model, hot=hot, keep=keep)

    def make_view() -> DataFrame:
        shown = write_stage(view_answers(answers, cascade, geo.per_species if geo else None))
        return view_of(standardize(records, shown, keys, model, hot=hot, keep=keep))


    originals = original_names(fresh.select("scientificName", "query_name", F.col("new_seq").alias("seq")))
    audit = attach_invasive(audit_table(cascade, originals), invasive)
    if geo is not None:
        audit = attach_geo(audit, geo.per_species, geo.areas)
    return RunResult(cascade, standardized, audit, geo, linked, source_failures(records.sparkSession, failures), make_view)
