"""Study areas from folders of KML files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_filled
from ..session import write_stage
from .listing import empty_files

MAX_BYTES = 200 * 1024 * 1024

# Words, in lower case, that no area file may hold.
BANNED_WORDS = ("<!doctype", "<!entity", "ogrvrtdatasource", "networklink")

_RING = "struct<LinearRing: struct<coordinates: string>>"
_POLYGON = f"struct<outerBoundaryIs: {_RING}, innerBoundaryIs: array<{_RING}>>"
_POINT = "struct<coordinates: string>"
PLACEMARK = (
    f"name string, Polygon array<{_POLYGON}>, Point array<{_POINT}>, "
    f"MultiGeometry struct<Polygon: array<{_POLYGON}>, Point: array<{_POINT}>>"
)


@dataclass(frozen=True)
class AreaFiles:
    """``vertices`` (``area, part, ring, seq, lon, lat``) and ``rejects``
    (``file, reason``); a bad file never hides a good one."""

    vertices: DataFrame
    rejects: DataFrame


def file_name(path: Column) -> Column:
    """Last part of a file path, which Spark reports in URL encoding."""
    base = F.regexp_replace(path, r"^.*/", "")
    return F.url_decode(F.replace(base, F.lit("+"), F.lit("%2B")))


def folder_name(column: str) -> Callable[[Column], Column]:
    """Name of an upload that lies in a folder ``column=<name>`` of its own, as Spark's writers make it.

    The path reports the folder in URL encoding, and signs that a folder may
    not hold are escaped once more.
    """

    def name(path: Column) -> Column:
        folder = F.regexp_extract(path, rf"/{column}=([^/]*)/[^/]*$", 1)
        for _ in range(2):
            folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
        return folder

    return name


def area_name(name: Column) -> Column:
    """Name of an area: the name of its file without the extension."""
    return F.regexp_replace(name, r"(?i)\.(zip|kmz|kml)$", "")


def check_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, name: Callable[[Column], Column] = file_name) -> DataFrame:
    """``path, reason`` per file; the reason is null where the file may be read.

    Content is only loaded for files whose size passed. ``name`` gives the
    name of the upload, which carries its format.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("path", F.col("_metadata.file_path"))
    kml = F.lower(name(F.col("path"))).endswith(".kml")
    # Read twice: opening many small files costs more than their rows.
    sized = write_stage(files.select("path", "length").select(
        "path",
        F.when(~kml, "unsupported format").when(F.col("length") > max_bytes, "file too large").alias("reason"),
    ))
    text = F.replace(F.decode("content", "UTF-8"), F.lit("\u0000"), F.lit(""))
    head = F.regexp_replace(text, r"(?s)<\?.*?\?>|<!--.*?-->", "")
    # The first tag's name, without its prefix.
    tag = F.regexp_extract(F.regexp_replace(head, "^﻿", ""), r"^\s*<([^\s>/]+)", 1)
    root = F.element_at(F.split(tag, ":"), -1) == "kml"
    lowered = F.lower(text)
    banned = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in BANNED_WORDS])
    content = files.where(kml & F.col("length").between(1, max_bytes)).select(
        "path", F.when(~root, "not a KML document").when(banned, "has a DTD, an entity, a VRT or a NetworkLink").alias("content_reason"),
    )
    checked = sized.join(content, "path", "left").select("path", F.coalesce("reason", "content_reason").alias("reason"))
    empty = empty_files(files, sized, "path").select("path", F.lit("empty file").alias("reason"))
    return checked.unionByName(empty)


def _ring(text: Column) -> Column:
    """Longitude and latitude of each tuple; an altitude falls away."""
    tuples = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: t != "")
    return F.transform(tuples, lambda t: F.struct(
        F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"), F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat")))


def placemark_vertices(marks: DataFrame) -> DataFrame:
    """``path, part, ring, seq, lon, lat``: vertices of all placemarks of each file.

    ``marks`` has ``path``, ``place`` (orders the placemarks of a file) and the
    columns of ``PLACEMARK``. A file with any polygon gives its polygons only; a file with none gives its
    points, each a part of one vertex.
    """
    none_p, none_q = F.array().cast(f"array<{_POLYGON}>"), F.array().cast(f"array<{_POINT}>")
    polygons = F.concat(F.coalesce("Polygon", none_p), F.coalesce("MultiGeometry.Polygon", none_p))
    points = F.concat(F.coalesce("Point", none_q), F.coalesce("MultiGeometry.Point", none_q))
    inner = F.array().cast(f"array<{_RING}>")
    shapes = F.concat(
        F.transform(polygons, lambda p: F.struct(F.lit(True).alias("polygon"), F.transform(
            F.concat(F.array(p["outerBoundaryIs"]), F.coalesce(p["innerBoundaryIs"], inner)), lambda r: _ring(r["LinearRing"]["coordinates"])).alias("rings"))),
        F.transform(points, lambda p: F.struct(F.lit(False).alias("polygon"), F.array(_ring(p["coordinates"])).alias("rings"))),
    )
    # Read twice, and by each result: the files themselves are parsed once.
    parts = write_stage(marks.select("path", "place", F.posexplode(shapes).alias("i", "s")))
    outlined = parts.groupBy("path").agg(F.max("s.polygon").alias("outlined"))
    parts = parts.join(outlined, "path").where(F.col("s.polygon") == F.col("outlined"))
    # Shapes of a file in the order of its placemarks: one file's shapes at a time.
    order = Window.partitionBy("path").orderBy("place", "i")
    rings = parts.withColumn("part", F.row_number().over(order) - 1).select("path", "part", F.posexplode("s.rings").alias("ring", "r"))
    return rings.select("path", "part", "ring", F.posexplode("r").alias("seq", "v")).select(
        "path", "part", "ring", "seq", "v.lon", "v.lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def read_areas(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES,
               name: Callable[[Column], Column] = file_name, glob: str = "*.[kK][mM][lL]") -> AreaFiles:
    """All areas of a folder, and the files that were refused and why.

    ``max_bytes``: larger files are refused and reported. ``name`` gives the
    name of an upload from its path, ``glob`` the files that may hold one:
    uploads that lie under other names, such as ``part-*``, are named by their
    folder (``folder_name``).
    """
    checked = write_stage(check_files(spark, path, max_bytes, name))
    marks = (
        spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").schema(PLACEMARK).load(path)
        # The place of a placemark in its file, while rows still come in its order.
        .select("*", F.col("_metadata.file_path").alias("path"),
                F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    )
    good = checked.where(F.col("reason").isNull()).select("path")
    vertices = placemark_vertices(marks.join(good, "path", "left_semi"))
    rejects = checked.where(is_filled("reason"))
    empty = good.join(vertices.select("path").distinct(), "path", "left_anti")
    rejects = rejects.unionByName(empty.select("path", F.lit("no geometry").alias("reason")))
    upload = name(F.col("path"))
    return AreaFiles(
        vertices.select(area_name(upload).alias("area"), "part", "ring", "seq", "lon", "lat"),
        rejects.select(upload.alias("file"), "reason"),
    )
