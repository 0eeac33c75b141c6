"""What each kind of source answers: exact rows, fuzzy targets, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_authorship
from ..functions.status import (
    backbone_status, checklist_status, endemism_remark, establishment_means,
)
from ..functions.text import filled_or, match_key, token_count
from ..schema import CANONICAL_COLUMNS
from ..sources.bases import BACKBONE, NameSource, status_meaning
from .joins import first_per_key

# Fields of a source row, before a verdict is made of it.
ROW_FIELDS = tuple(
    c for c in CANONICAL_COLUMNS
    if c not in ("query_name", "validation_status", "match_count", "provider",
                 "specificEpithet", "infraspecificEpithet")
)


def _is_synonym(status: Column) -> Column:
    return F.coalesce(F.contains(F.lower(status), F.lit("synonym")), F.lit(False))


def _row(values: dict[str, Column]) -> Column:
    null = F.lit(None)
    return F.struct(*[values.get(f, null).cast("string").alias(f) for f in ROW_FIELDS])


def exact_names(names: DataFrame, base: DataFrame) -> DataFrame:
    """Names a checklist holds verbatim (on the match key)."""
    held = base.select("mk").distinct()
    return names.withColumn("mk", match_key("query_name")).join(held, "mk", "left_semi").drop("mk")


def base_taxonomy(base: DataFrame) -> DataFrame:
    """One taxonomy row per key: species rank first, then non-synonym, then order.

    A checklist files subspecies under their species, so the first row of a key
    is not always the species itself.
    """
    not_species = ~F.coalesce(F.lower("taxonRank") == "species", F.lit(False))
    return first_per_key(
        base, ["mk"], [not_species, _is_synonym(F.col("taxonomicStatus")), F.col("seq")]
    )


def _base_fields(default_kingdom: str | None, has_kingdom: bool = True) -> dict[str, Column]:
    kingdom = F.col("kingdom")
    if default_kingdom is not None:
        kingdom = filled_or(kingdom, F.lit(default_kingdom))
    return {
        "taxonID": F.col("id").cast("string"),
        "taxonRank": F.col("taxonRank"),
        "kingdom": kingdom,
        **{c: F.col(c) for c in ("phylum", "class", "order", "family", "genus", "vernacularName")},
        "scientificNameAuthorship": base_authorship("scientificName", "species"),
        "establishmentMeans": establishment_means("origin"),
        "taxonRemarks": endemism_remark("endemism"),
    }


def backfill_taxonomy(rows: DataFrame, base: DataFrame, default_kingdom: str | None = None) -> DataFrame:
    """Fill the blank taxonomy of rows from the base row of their name."""
    fields = _base_fields(default_kingdom)
    found = base_taxonomy(base).select(
        "mk", *[c.cast("string").alias(f"_b_{f}") for f, c in fields.items()]
    )
    missing = [f for f in fields if f not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(f) for f in missing])
    joined = rows.withColumn("mk", match_key("scientificName")).join(found, "mk", "left")
    return joined.select(
        *[filled_or(c, f"_b_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns]
    )


def _native_status(source: NameSource) -> Column:
    """The status that a row shows: a source's own word as it stands, else the usual one."""
    status = F.col("taxonomicStatus")
    return status if source.status_words else status_meaning(source, status)


def _synonym_row(source: NameSource) -> Column:
    return _is_synonym(status_meaning(source, F.col("taxonomicStatus")))


def checklist_rows(source: NameSource) -> DataFrame:
    """``mk, row``: the answer of a checklist to a name it holds.

    The verdict comes from the first non-synonym row of the key, the taxonomy
    from its species-rank row; both reductions share one aggregate.
    """
    base = source.table.withColumn("_status", _native_status(source))
    synonym = _synonym_row(source)
    not_species = ~F.coalesce(F.lower("taxonRank") == "species", F.lit(False))
    fields = _base_fields(source.default_kingdom)
    packed = base.select(
        "mk",
        F.struct(F.col("species").alias("s"), F.col("_status").alias("t"), F.col("family").alias("f")).alias("v"),
        F.struct(synonym.alias("a"), F.col("seq").alias("b")).alias("v_order"),
        F.struct(*[c.cast("string").alias(f) for f, c in fields.items()]).alias("b"),
        F.struct(not_species.alias("a"), synonym.alias("b"), F.col("seq").alias("c")).alias("b_order"),
    )
    best = packed.groupBy("mk").agg(
        F.min_by("v", "v_order").alias("v"), F.min_by("b", "b_order").alias("b")
    )
    values = {f: F.col(f"b.{f}") for f in fields}
    values["scientificName"] = F.col("v.s")
    values["taxonomicStatus"] = F.col("v.t")
    values["family"] = filled_or(F.col("v.f"), F.col("b.family"))
    return best.select("mk", _row(values).alias("row"))


def checklist_targets(source: NameSource) -> DataFrame:
    """``target, synonym, seq, row``: the names a typo can be corrected to."""
    base = source.table.withColumn("_status", _native_status(source))
    names = first_per_key(
        base.select("species", "mk", _synonym_row(source).cast("int").alias("synonym"),
                    F.col("seq"), "_status", "family"),
        ["species"], [F.col("synonym"), F.col("seq")],
    )
    taxonomy = checklist_rows(source)
    joined = names.join(taxonomy, "mk")
    values = {f: F.col(f"row.{f}") for f in ROW_FIELDS}
    values["scientificName"] = F.col("species")
    values["taxonomicStatus"] = F.col("_status")
    values["family"] = filled_or(F.col("family"), F.col("row.family"))
    return joined.select(
        F.col("species").alias("target"), "synonym", F.col("seq").cast("long").alias("seq"), _row(values).alias("row")
    )


def _backbone_row() -> Column:
    values = {
        "scientificName": F.when(F.coalesce(F.col("canonicalName"), F.lit("")) == "", F.col("scientificName"))
        .otherwise(F.col("canonicalName")),
        "taxonomicStatus": F.lower("status"),
        "taxonID": F.col("usageKey").cast("string"),
        "acceptedNameUsageID": F.col("acceptedUsageKey").cast("string"),
        "taxonRank": F.lower("rank"),
        **{c: F.col(c) for c in ("kingdom", "phylum", "class", "order", "family")},
        # A synonym carries the classification of its accepted taxon, so its
        # genus would contradict the name.
        "genus": F.when(~_is_synonym(F.col("status")), F.col("genus")),
        "scientificNameAuthorship": F.col("authorship"),
    }
    return _row(values)


def backbone_rows(source: NameSource) -> DataFrame:
    """``mk, row``: the backbone row that carries a name."""
    rows = source.table.select("mk", _backbone_row().alias("row"), _is_synonym(F.col("status")).alias("s"),
                               F.col("usageKey").alias("k"))
    return first_per_key(rows, ["mk"], [F.col("s"), F.col("k")], ["row"])


def backbone_parents(source: NameSource) -> DataFrame:
    """``mk, row``: genus rows, the answer to a name with no row of its own."""
    genera = source.table.where(F.upper("rank") == "GENUS")
    rows = genera.select("mk", _backbone_row().alias("row"), F.col("usageKey").alias("k"))
    return first_per_key(rows, ["mk"], [F.col("k")], ["row"])


def backbone_targets(source: NameSource) -> DataFrame:
    t = source.table
    return t.select(
        F.col("canonicalName").alias("target"), _is_synonym(F.col("status")).cast("int").alias("synonym"),
        F.col("usageKey").cast("long").alias("seq"), _backbone_row().alias("row"),
    )


def exact_rows(source: NameSource) -> DataFrame:
    return backbone_rows(source) if source.kind == BACKBONE else checklist_rows(source)


def fuzzy_targets(source: NameSource) -> DataFrame:
    return backbone_targets(source) if source.kind == BACKBONE else checklist_targets(source)


def is_usable(query: Column, suggestion: Column) -> Column:
    """A spelling correction keeps the number of tokens; anything else is
    another taxon."""
    return F.coalesce(token_count(suggestion) == token_count(query), F.lit(False))


# Fields that follow the name, and fields that follow its classification.
CLASS_FIELDS = ("kingdom", "phylum", "class", "order", "family")


def _verdict(status: Column, name: Column, ids: Column, classes: Column) -> Column:
    return F.struct(
        status.alias("status"), name.alias("name"), ids.alias("ids"), classes.alias("classes")
    )


def checklist_verdict(query: Column, row: Column, spelling: str, exact: bool, source: NameSource | None = None) -> Column:
    """Status of a checklist answer, and which parts of its row may be used.

    A refused suggestion describes another taxon, so nothing of it is kept; an
    exact key still owns its taxonomy. A source with its own status words
    answers what they mean, and nothing for a word it does not define.
    """
    usable = is_usable(query, row["scientificName"])
    meant = checklist_status(F.lit(spelling), row["taxonomicStatus"])
    if exact and source is not None and source.status_words:
        meant = F.coalesce(status_meaning(source, row["taxonomicStatus"]), F.lit("not_found"))
    status = F.when(usable, meant).otherwise("not_found")
    return _verdict(status, usable, F.lit(True) if exact else usable, F.lit(True) if exact else usable)


def backbone_verdict(query: Column, row: Column, kind: Column) -> Column:
    """Status of a backbone answer of a match kind, and its usable parts.

    HIGHERRANK with another name is the parent of the name, not the name: the
    input stays, unresolved, and only an accepted parent lends its
    classification.
    """
    status = F.upper(row["taxonomicStatus"])
    parent = (kind == "HIGHERRANK") & F.coalesce(
        match_key(row["scientificName"]) != match_key(query), F.lit(False)
    )
    foreign = parent & ~F.coalesce(status == "ACCEPTED", F.lit(False))
    return _verdict(
        F.when(parent, "not_found").otherwise(backbone_status(status, kind)), ~parent, ~parent, ~foreign
    )


def apply_verdict(query: Column, row: Column, verdict: Column) -> dict[str, Column]:
    """The canonical values a verdict leaves of a row."""
    out = {}
    for f in ROW_FIELDS:
        if f == "scientificName":
            out[f] = F.coalesce(F.when(verdict["name"], row[f]), query)
        elif f == "taxonomicStatus":
            out[f] = F.when(verdict["name"], row[f])
        else:
            out[f] = F.when(verdict["classes" if f in CLASS_FIELDS else "ids"], row[f])
    return out
