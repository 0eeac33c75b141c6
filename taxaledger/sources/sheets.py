"""Species sheets: folders of delimited text files, each with its own layout.

A first job looks at the head of every file and works out its delimiter, header
row and columns. Files of one layout are then read together by Spark's CSV
reader, so the number of reads is the number of layouts, not of files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_filled, trimmed
from ..session import write_stage
from .listing import empty_files

NAME_KEY = "scientificName"
# Delimiters in order of preference, and how far to look.
DELIMITERS = ("\t", ";", ",", "|")
PROBE_LINES = 20
HEADER_ROWS = 30


@dataclass(frozen=True)
class Sheets:
    """``records`` (text columns, ``source_file``, ``seq``), one ``layouts`` row
    per accepted file, one ``rejects`` row (``source_file, reason``) per other."""

    records: DataFrame
    layouts: DataFrame
    rejects: DataFrame


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    ).withColumn("id", F.monotonically_increasing_id())


def file_heads(lines: DataFrame) -> DataFrame:
    """``source_file, lines``: the lines of each file's first rows, in order, no BOM.

    A row ends at a line where all quotes are closed, however many lines its
    cells take; blank rows do not count. Rows are counted over the first block
    of the file, so what one task holds of a file is a block at most.
    """
    upto = Window.partitionBy("source_file").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source_file").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = lines.where("block = 0").withColumn("_open", F.sum(quotes).over(upto) % 2)
    ends = F.when((F.col("_open") == 0) & is_filled("value"), 1).otherwise(0)
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy("source_file").orderBy("id")))
    first = first.withColumn("_rows", F.coalesce(F.sum(ends).over(before), F.lit(0))).where(F.col("_rows") < HEADER_ROWS)
    heads = first.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("l"))
    return heads.select(
        "source_file",
        F.transform("l", lambda x: F.when(x["rn"] == 1, F.regexp_replace(x["value"], "^﻿", "")).otherwise(x["value"])).alias("lines"),
    )


def _median(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def sniff_delimiter(lines: Column, extension: Column, key: str = NAME_KEY) -> Column:
    """Delimiter of a file out of its first lines.

    The delimiter with the highest median count per line wins, quoted text left
    out; one that yields the name column beats one that does not.
    """
    probe = F.slice(F.filter(lines, lambda x: is_filled(x)), 1, PROBE_LINES)
    bare = F.split(F.regexp_replace(F.array_join(probe, "\n"), '"[^"]*"', ""), "\n")
    has, score = {}, {}
    for d in DELIMITERS:
        parts = F.lit(f"\\Q{d}\\E")
        has[d] = F.exists(probe, lambda x: F.exists(
            F.split(x, parts), lambda c: F.regexp_replace(trimmed(c), '^"|"$', "") == key))
        count = _median(F.transform(bare, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))))
        score[d] = count
    any_key = reduce(lambda a, b: a | b, has.values())
    ranked = {d: F.when(any_key & ~has[d], -1.0).otherwise(score[d]) for d in DELIMITERS}
    top = F.greatest(*ranked.values())
    best = F.coalesce(*[F.when(ranked[d] == top, d) for d in DELIMITERS])
    keyed = F.coalesce(*[F.when(has[d], d) for d in DELIMITERS], F.lit(","))
    return (
        F.when(F.size(probe) == 0, ",")
        .when((extension == "tsv") & has["\t"], "\t")
        .when(top <= 0, keyed)
        .otherwise(best)
    )


def _rows(lines: Column) -> Column:
    """Rows of a text: line breaks inside quotes do not end a row."""
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    rows = F.regexp_extract_all(text, F.lit('((?:[^"\\n]++|"[^"]*+")*+)\\n'), F.lit(1))
    return F.filter(rows, lambda r: is_filled(r))


def _cells(row: Column, delimiter: Column) -> Column:
    d = F.when(delimiter == "|", "\\|").otherwise(delimiter)
    pattern = F.concat(F.lit('((?:[^"'), d, F.lit(']++|"[^"]*+")*+)'), d)
    cells = F.regexp_extract_all(F.concat(row, delimiter), pattern, F.lit(1))
    return F.transform(cells, lambda c: trimmed(F.replace(
        F.regexp_replace(trimmed(c), '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))))


def detect_layouts(spark: SparkSession, path: str, key: str = NAME_KEY) -> DataFrame:
    """One row per file: delimiter, header position, columns, labels, verdict."""
    lines = _lines(spark, path)
    ext = F.lower(F.regexp_extract("source_file", r"\.([^./]+)$", 1))
    # A quote left open at a line end means rows span lines; only such files
    # need the reader that cannot split a file.
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    spans = lines.groupBy("source_file").agg((F.max(quotes % 2) == 1).alias("multi_line"))
    heads = file_heads(lines).join(spans, "source_file").withColumn("extension", ext)
    # Each step is written (one row per file): later tests on its result would
    # otherwise be moved in front of it and repeat the text work.
    heads = write_stage(heads.withColumn("delimiter", sniff_delimiter(F.col("lines"), F.col("extension"), key)))
    grid = heads.withColumn("grid", F.transform(F.slice(_rows(F.col("lines")), 1, HEADER_ROWS), lambda r: _cells(r, F.col("delimiter"))))
    at = F.array_position(F.transform("grid", lambda r: F.array_contains(r, key)), True)
    grid = write_stage(grid).withColumn("header_row", F.when(at > 0, at).cast("int"))
    header = F.get("grid", F.col("header_row") - 1)
    labels = F.when(F.col("header_row") > 1, F.get("grid", F.col("header_row") - 2))
    grid = grid.select(
        "source_file", "extension", "delimiter", "multi_line", "header_row", F.size("lines").alias("n"),
        F.filter(F.transform(header, lambda c, i: F.struct(c.alias("name"), i.alias("pos"))), lambda x: x["name"] != "").alias("columns"),
        labels.alias("labels"), F.exists("lines", lambda x: is_filled(x)).alias("filled"),
    )
    names = F.transform("columns", lambda x: x["name"])
    repeated = F.filter(F.array_distinct(names), lambda n: F.size(F.filter(F.col("columns"), lambda x: x["name"] == n)) > 1)
    where = F.transform(repeated, lambda n: F.concat(n, F.lit(" (colunas "), F.array_join(F.transform(
        F.filter(F.col("columns"), lambda x: x["name"] == n), lambda x: (x["pos"] + 1).cast("string")), ", "), F.lit(")")))
    reason = (
        F.when(~F.col("extension").isin("csv", "tsv", "txt"), F.concat(F.lit("unsupported format: "), "extension"))
        .when(~F.col("filled"), "empty file")
        .when(F.col("header_row").isNull(), f"no header row with a {key} column")
        .when(F.size(repeated) > 0, F.concat(F.lit("repeated columns: "), F.array_join(where, "; ")))
    )
    return write_stage(grid.select(
        "source_file", "delimiter", "multi_line", "header_row", "columns",
        F.transform("columns", lambda x: F.get(F.col("labels"), x["pos"])).alias("labels"), reason.alias("reason"),
    ))


def _read_layout(spark: SparkSession, paths: list[str], delimiter: str, multi_line: bool,
                 header_row: int, columns: list[tuple[str, int]]) -> DataFrame:
    width = max(pos for _, pos in columns) + 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    rows = spark.read.schema(schema).csv(paths, sep=delimiter, quote='"', escape='"', multiLine=multi_line)
    rows = rows.select(
        *[F.col(f"_c{pos}").alias(name) for name, pos in columns],
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_id", F.monotonically_increasing_id()).withColumn("_header", F.lit(header_row))
    return rows


def _numbered(rows: DataFrame, model: list[str]) -> DataFrame:
    """Records below each header, with a ``seq`` that is unique over all files.

    Rows of a block are numbered in order within one task. What stands before a
    block is a running sum over the blocks, which are few; a row meets its
    block's line, so no key holds more than a block.
    """
    block = ["source_file", "_block"]
    blocks = rows.groupBy(*block).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = rows.join(blocks, block).withColumn("_at", F.col("_id") - F.col("_first"))
    body = placed.where((F.col("_block") > 0) | (F.col("_at") >= F.col("_header")))
    kept = body.where(reduce(lambda a, b: a | b, [is_filled(F.col(f"`{n}`")) for n in model]))
    return kept.select(*[F.col(f"`{n}`") for n in model], "source_file", (F.col("_before") + F.col("_at")).alias("seq"))


def read_sheets(spark: SparkSession, path: str, key: str = NAME_KEY) -> Sheets:
    """Read every sheet under ``path``; files that cannot be read are reported.

    Columns keep their order of first appearance over the layouts.
    """
    found = detect_layouts(spark, path, key)
    layouts = found.where(F.col("reason").isNull()).drop("reason")
    rejects = found.where(F.col("reason").isNotNull()).select("source_file", "reason")
    void = empty_files(spark.read.text(path), found, "source_file")
    rejects = rejects.unionByName(void.select("source_file", F.lit("empty file").alias("reason")))
    # A read needs its paths and options on the driver: file names, no content.
    groups = layouts.groupBy("delimiter", "multi_line", "header_row", "columns").agg(
        F.sort_array(F.collect_list("source_file")).alias("paths")
    ).collect()
    groups = sorted(groups, key=lambda g: g["paths"][0])
    if not groups:
        empty = T.StructType([T.StructField(key, T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("seq", T.LongType())])
        return Sheets(spark.createDataFrame([], empty), layouts, rejects)
    parts = [
        _read_layout(spark, g["paths"], g["delimiter"], g["multi_line"], g["header_row"], [(c["name"], c["pos"]) for c in g["columns"]])
        for g in groups
    ]
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    model = [c for c in records.columns if c not in ("source_file", "_block", "_id", "_header")]
    # A column's label is that of the first file that has one.
    said = layouts.select("source_file", F.explode(F.arrays_zip(F.col("columns.name").alias("name"), "labels")).alias("x"))
    said = said.where(is_filled("x.labels")).groupBy("x.name").agg(F.min_by("x.labels", "source_file").alias("label"))
    labels = {r["name"]: r["label"] for r in said.collect()}
    return Sheets(with_labels(_numbered(records, model), labels), layouts, rejects)


def with_labels(records: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach the row above the header as column metadata (``label``)."""
    return records.select(*[
        F.col(f"`{c}`").alias(c, metadata={"label": labels[c]}) if labels.get(c) else F.col(f"`{c}`") for c in records.columns
    ])
