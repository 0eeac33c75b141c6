"""Builders of the threatened and invasive lists, labels and table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.status import severity
from ..functions.text import filled_or, is_filled, match_key, trimmed
from ..operators.joins import first_per_key
from ..session import write_stage

# Annex number of the threatened list and the act it belongs to.
ANNEX_SOURCES = {
    "1": "Portaria 1.783/2026",
    "2": "Portaria 1.704/2026",
    "3": "Portaria 1.667/2026",
}

# Fixed value: categories a row of the threatened list may end with.
_CATEGORY = r"^(VU|EN|CR|CR \(PE\)|CR \(PEX\))$"

# Biome names of the map layer and the checklist vocabulary.
BIOME_LABELS = {
    "Amazônia": "Amazon",
    "Mata Atlântica": "Atlantic_Forest",
    "Caatinga": "Caatinga",
    "Cerrado": "Cerrado",
    "Pampa": "Pampa",
    "Pantanal": "Pantanal",
    "Sistema Costeiro": "Coastal_System",
}

# Header labels that show up as names in the source lists.
LABEL_ROWS = ("nome cientifico", "scientificname", "supplied name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of text files; ``line_no`` grows along each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"),
                                         F.col("_metadata.file_block_start").alias("b"))
    lines = lines.withColumn("i", F.monotonically_increasing_id())
    first = lines.groupBy("f", "b").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    # Blocks are few; lines before a block is a running sum over them.
    w = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offset = first.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return lines.join(offset, ["f", "b"]).select(
        F.col("f").alias("file"),
        (F.col("before") + F.col("i") - F.col("first")).alias("line_no"),
        F.regexp_replace("value", "^﻿", "").alias("value"),
    )


def carry_forward(lines: DataFrame, marker: Column, name: str, chunk_lines: int = 100_000) -> DataFrame:
    """Adds ``name``: the last non-null ``marker`` at or before each line of its file.

    A file is cut into chunks of lines. Each chunk hands its last marker to
    the later ones through a table with one row per chunk, so no task ever
    sees more than a chunk.
    """
    lines = lines.withColumn("_m", marker).withColumn("_chunk", F.floor(F.col("line_no") / chunk_lines))
    ends = lines.groupBy("file", "_chunk").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col("line_no"))).alias("_end"))
    earlier = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("file", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.join(ends, ["file", "_chunk"]).withColumn(
        name, F.coalesce(F.last("_m", ignorenulls=True).over(inside), F.col("_before"))
    )
    return out.drop("_m", "_chunk", "_before")


def threatened_rows(lines: DataFrame, annexes: dict[str, str] = ANNEX_SOURCES) -> DataFrame:
    """``file, line_no, scientificName, match_key, category, source`` of list text.

    A row is ``| id | ... | species | category |``; the annex marker above it
    says which act it belongs to. Anything else is skipped.
    """
    marker = F.regexp_extract("value", r"^ANEXO\s+([123])\s*$", 1)
    acts = F.create_map(*[F.lit(x) for pair in annexes.items() for x in pair])
    lines = carry_forward(lines, F.when(marker != "", F.element_at(acts, marker)), "source")
    rows = lines.where(F.contains("value", F.lit("|")))
    # Leading one blank cell and trailing blank cells fall away.
    cells = F.transform(F.split("value", r"\|"), lambda c: trimmed(c))
    rows = rows.withColumn("_c", cells)
    rows = rows.withColumn("_c", F.when(F.get("_c", F.lit(0)) == "", F.slice("_c", 2, F.size("_c"))).otherwise(F.col("_c")))
    last = F.array_max(F.transform("_c", lambda c, i: F.when(c != "", i)))
    rows = rows.withColumn("_n", F.coalesce(last, F.lit(-1)) + 1).where("_n >= 3")
    rows = rows.select(
        "file", "line_no", "source", F.get("_c", F.lit(0)).alias("_id"),
        F.get("_c", F.col("_n") - 2).alias("scientificName"), F.get("_c", F.col("_n") - 1).alias("category"),
    )
    rows = rows.where(
        F.col("_id").rlike("^[0-9]+$") & F.col("category").rlike(_CATEGORY)
        & F.col("scientificName").rlike(r"^[A-Z]\S*\s+\S")
    )
    return rows.select(
        "file", "line_no", "scientificName", match_key(normalize_name("scientificName")).alias("match_key"),
        F.when(F.col("category") == "CR (PE)", "CR (PEX)").otherwise(F.col("category")).alias("category"), "source",
    )


def count_mismatches(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """``source, expected, found`` of the sources whose row count is off."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()), "source string, expected long")
    got = rows.groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    return want.join(got, "source", "left").select(
        "source", "expected", F.coalesce("found", F.lit(0)).alias("found")
    ).where("expected <> found")


def threatened_list(rows: DataFrame) -> DataFrame:
    """``match_key, scientificName, category, source``: most severe per key."""
    # In this list NT does not occur, so the general severity order holds.
    return first_per_key(
        rows.where(is_filled("match_key")), ["match_key"],
        [-severity("category"), F.col("scientificName")], ["scientificName", "category", "source"],
    )


def invasive_list(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``match_key, scientificName, invasiveSource`` over several lists.

    ``sources`` are ``(label, table)`` in order; a table has ``scientificName``
    or ``Supplied Name`` and a ``seq``. Header labels listed as names and names
    without a key are dropped; sources are named once each, in order.
    """
    def one(place: int, label: str, df: DataFrame) -> DataFrame:
        def column(name: str) -> Column:
            return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

        return df.select(
            filled_or(column("scientificName"), column("Supplied Name")).alias("raw"),
            F.lit(label).alias("label"), F.lit(place).alias("place"), F.col("seq").alias("seq"),
        )

    rows = reduce(DataFrame.unionByName, [one(i, label, df) for i, (label, df) in enumerate(sources)])
    rows = rows.where(~F.coalesce(match_key("raw").isin(*LABEL_ROWS), F.lit(False)))
    # Written before the key is tested: a test on the parsed name would be
    # repeated inside every branch of the union.
    rows = rows.withColumn("scientificName", normalize_name("raw"))
    rows = write_stage(rows.select("*", match_key("scientificName").alias("match_key")))
    rows = rows.where(is_filled("match_key"))
    grouped = rows.groupBy("match_key").agg(
        F.min_by("scientificName", F.struct("place", "seq")).alias("scientificName"),
        # As many entries as there are lists, however often a name is listed.
        F.sort_array(F.collect_set(F.struct("place", "label"))).alias("_s"),
    )
    return grouped.select(
        "match_key", "scientificName",
        F.array_join(F.transform("_s", lambda s: s["label"]), "; ").alias("invasiveSource"),
    )


def harmonize_labels(layer: DataFrame, column: str, labels: dict[str, str] = BIOME_LABELS) -> tuple[DataFrame, DataFrame]:
    """The layer with mapped labels, and the labels that have no mapping.

    The second table must be empty before the first may be used.
    """
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    mapped = layer.withColumn("_label", F.element_at(table, F.col(column)))
    unmapped = mapped.where(F.col("_label").isNull()).select(column).distinct()
    return mapped.withColumn(column, F.col("_label")).drop("_label"), unmapped


def require_labels(layer: DataFrame, column: str, labels: dict[str, str] = BIOME_LABELS) -> DataFrame:
    """The layer with mapped labels; a label without a mapping is an error."""
    mapped, unmapped = harmonize_labels(layer, column, labels)
    missing = [r[0] for r in unmapped.limit(5).collect()]
    if missing:
        raise ValueError(f"labels without a mapping: {missing}")
    return mapped


def reference_profile(tables: dict[str, tuple[DataFrame, Column, str | None]]) -> DataFrame:
    """``label, source, n_rows, n_taxa, version`` per table and source.

    ``tables`` maps a label to (table with ``match_key``, source column,
    version); an unknown version shows as a dash.
    """
    def one(label: str, df: DataFrame, source: Column, version: str | None) -> DataFrame:
        shown = version if version and version.strip() else "—"
        return df.groupBy(source.cast("string").alias("source")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("match_key").alias("n_taxa")
        ).select(F.lit(label).alias("label"), "source", "n_rows", "n_taxa", F.lit(shown).alias("version"))

    return reduce(DataFrame.unionByName, [one(k, *v) for k, v in tables.items()])
