"""Conservation status: the threatened list, Red List category and criteria."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import invasive_key, normalize_name
from ..functions.status import (
    CRITERIA_CATEGORIES, is_stale_source, severity, status_label,
)
from ..functions.text import filled_or, is_filled, match_key
from ..schema import REPLACED_SOURCES
from ..session import write_stage
from ..sources.bases import NameSource
from .accepted import agreed_accepted_names, knows_accepted_names
from .answers import backbone_rows
from .joins import first_per_key
from .nearest import fuzzy_best


def most_restrictive(listed: DataFrame) -> DataFrame:
    """``match_key, category, source``: most severe row per key, first on ties."""
    return first_per_key(
        listed.where(is_filled("match_key")), ["match_key"],
        [-severity("category"), F.col("seq")], ["category", "source"],
    )


def threatened_lookup(names: DataFrame, listed: DataFrame, name: str = "query_name",
                      accepted: str | None = "acceptedName") -> DataFrame:
    """Status and source per name: its own key, else that of its accepted name.

    The source then says which accepted name it came through. Adds
    ``statusMMA`` and ``statusSourceMMA``.
    """
    reduced = most_restrictive(listed)
    own = reduced.select(F.col("match_key").alias("_k"), F.col("category").alias("_c"), F.col("source").alias("_s"))
    out = names.withColumn("_k", match_key(name)).join(own, "_k", "left")
    if accepted is None:
        return out.select(*names.columns, F.col("_c").alias("statusMMA"), F.col("_s").alias("statusSourceMMA"))
    via = reduced.select(F.col("match_key").alias("_ak"), F.col("category").alias("_ac"), F.col("source").alias("_as"))
    key = match_key(accepted)
    out = out.withColumn("_ak", F.when(F.col("_c").isNull() & (key != F.col("_k")), key)).join(via, "_ak", "left")
    return out.select(
        *names.columns,
        F.coalesce("_c", "_ac").alias("statusMMA"),
        F.coalesce(
            F.col("_s"),
            F.concat(F.col("_as"), F.lit(" (nome aceito: "), F.col(accepted), F.lit(")")),
        ).alias("statusSourceMMA"),
    )


def threatened_for_names(names: DataFrame, listed: DataFrame, sources: Sequence[NameSource],
                         name: str = "scientificName", normalized: bool = False) -> DataFrame:
    """The lookup for names, with the accepted-name route.

    ``names`` has one row per distinct name; its columns are kept. Typed names
    carry authors and are normalized first, unless they already are.
    """
    query = F.col(name) if normalized else normalize_name(name)
    keyed = names.withColumn("_q", query)
    if not knows_accepted_names(sources):
        return threatened_lookup(keyed, listed, "_q", accepted=None).select(*names.columns, "statusMMA", "statusSourceMMA")
    table = agreed_accepted_names(sources)
    keyed = keyed.withColumn("_mk", match_key("_q"))
    keyed = keyed.join(table.select(F.col("mk").alias("_mk"), "acceptedName"), "_mk", "left").drop("_mk")
    out = threatened_lookup(keyed, listed, name="_q")
    return out.select(*names.columns, "statusMMA", "statusSourceMMA")


def backbone_keys(names: DataFrame, backbone: NameSource, name: str = "scientificName") -> DataFrame:
    """Adds ``usageKey`` (the name itself) and ``occurrenceKey`` (the taxon that
    holds its records: the accepted one for a synonym)."""
    keys = backbone_rows(backbone).select(
        F.col("mk").alias("_mk"),
        F.col("row.taxonID").alias("usageKey"),
        F.coalesce("row.acceptedNameUsageID", "row.taxonID").alias("occurrenceKey"),
    )
    return names.withColumn("_mk", match_key(name)).join(keys, "_mk", "left").drop("_mk")


def with_near_keys(keyed: DataFrame, backbone: NameSource, name: str = "scientificName") -> DataFrame:
    """Fill the keys that ``backbone_keys`` left open from the closest backbone name.

    A misspelled species keeps its key; only a name that the backbone knows by
    its genus alone has none. The closest names are searched once per distinct
    open name. ``keyed`` is a written table.
    """
    open_names = keyed.where(F.col("usageKey").isNull() & is_filled(name)).select(F.col(name).alias("query_name")).distinct()
    best = fuzzy_best(write_stage(open_names.withColumn("ask", F.lit(1))), [backbone])
    near = best.select(
        F.col("query_name").alias(name), F.col("row.taxonID").alias("_near"),
        F.coalesce("row.acceptedNameUsageID", "row.taxonID").alias("_near_accepted"),
    )
    filled = {"usageKey": "_near", "occurrenceKey": "_near_accepted"}
    return keyed.join(near, name, "left").select(
        *[F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in keyed.columns])


def redlist_category(rows: DataFrame, backbone: NameSource, by_key: DataFrame, near: bool = True) -> DataFrame:
    """Adds ``iucnCategory``.

    A ``taxonID`` is a backbone key only on rows the backbone answered: there
    the cascade has handed on the key it matched, exactly or not. Every other
    row goes by name. ``by_key`` has ``usageKey, code``. ``near``: names without
    an exact key take that of the closest backbone name; only names whose row
    has no key yet are searched.
    """
    own = F.when((F.col("provider") == backbone.id) & (F.coalesce("taxonID", F.lit("")) != ""), F.col("taxonID"))
    keyed = backbone_keys(rows, backbone).withColumn("usageKey", F.coalesce(own.cast("string"), F.col("usageKey").cast("string")))
    if near:
        keyed = with_near_keys(write_stage(keyed), backbone)
    codes = by_key.select(F.col("usageKey").cast("string").alias("usageKey"), F.col("code").alias("iucnCategory"))
    return keyed.join(codes, "usageKey", "left").select(*rows.columns, "iucnCategory")


def may_have_criteria() -> Column:
    """Rows worth a criteria lookup: a category that carries criteria, a listed
    species, or no category at all."""
    return (
        F.coalesce(F.col("iucnCategory").isin(*CRITERIA_CATEGORIES), F.lit(False))
        | is_filled("statusMMA") | ~is_filled("iucnCategory")
    )


def redlist_criteria(rows: DataFrame, assessments: DataFrame) -> DataFrame:
    """Overrides ``iucnCategory`` where an assessment exists, adds criteria.

    ``assessments`` has ``genus, species, infra, category, criteria``, one row
    per triple; a blank infraspecific part is the species itself.
    """
    found = assessments.select(
        F.col("genus").alias("_g"), F.col("species").alias("_s"),
        F.when(is_filled("infra"), F.col("infra")).otherwise("").alias("_i"),
        F.col("category").alias("_cat"), F.col("criteria").alias("_crit"),
    )
    gate = may_have_criteria() & is_filled("genus") & is_filled("specificEpithet")
    keyed = rows.select(
        "*",
        F.when(gate, F.col("genus")).alias("_g"),
        F.when(gate, F.col("specificEpithet")).alias("_s"),
        F.when(is_filled("infraspecificEpithet"), F.col("infraspecificEpithet")).otherwise("").alias("_i"),
    )
    joined = keyed.join(found, ["_g", "_s", "_i"], "left")
    return joined.select(
        *[filled_or("_cat", c).alias(c) if c == "iucnCategory" else F.col(c) for c in rows.columns],
        F.col("_crit").alias("iucnCriteria"),
    )


def apply_threatened_status(records: DataFrame, category: str, source: str,
                            replaced=REPLACED_SOURCES, where: str | None = None) -> DataFrame:
    """Write the current list answer onto records (those ``where`` is true).

    A listed species gets the current label and source; an unlisted one loses a
    status whose source is a replaced list; everything else stays. Only columns
    the sheet already has are touched.
    """
    has_status, has_source = "status" in records.columns, "statusSource" in records.columns
    applies = F.lit(True) if where is None else F.col(where)
    label = F.when(applies, status_label(category))
    listed = label.isNotNull()
    stale = applies & is_stale_source("statusSource", replaced) if has_source else F.lit(False)
    new = {}
    if has_status:
        new["status"] = F.when(listed, label).when(~stale, F.col("status"))
    if has_source:
        new["statusSource"] = F.when(listed, F.col(source)).when(~stale, F.col("statusSource"))
    return records.select(*[new[c].alias(c) if c in new else F.col(c) for c in records.columns])


def invasive_lookup(names: DataFrame, invasive: DataFrame, name: str = "scientificName", key: str | None = None) -> DataFrame:
    """Adds ``invasive`` (true or null, never false) and ``invasiveSource``.

    ``key`` names a column that already holds the list key of the name.
    """
    table = invasive.where(is_filled("match_key")).select(
        F.col("match_key").alias("_ik"), F.lit(True).alias("invasive"), "invasiveSource"
    )
    keyed = names.withColumn("_ik", invasive_key(name) if key is None else F.col(key))
    return keyed.join(table, "_ik", "left").drop("_ik")
