import os

import pytest
from pyspark.sql import functions as F

from taxaledger.operators import spatial
from taxaledger.sources import area_files, bases, lists, sheets, sinks


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_sheets_of_many_layouts(spark, tmp_path):
    d = str(tmp_path)
    put(d, "double.csv", "Nome científico;Local\nscientificName;locality\nAus bus;Fazenda 1\n;\nCus dus;\"Fazenda; 2\"\n")
    put(d, "double2.csv", "Nome científico;Local\nscientificName;locality\nEus fus;x\n")
    put(d, "tab.tsv", "preamble, with commas, here\n\nscientificName\ttaxonID\nGus hus\t7\n")
    put(d, "bom.csv", "﻿scientificName,locality\nIus jus,\"line\nbreak\"\nKus lus,\"say \"\"hi\"\"\"\n")
    put(d, "pipe.txt", "scientificName|locality\nMus nus|P\n")
    put(d, "single.csv", "scientificName\nOus pus\n")
    put(d, "dup.csv", "scientificName,locality,locality\nA b,1,2\n")
    put(d, "none.csv", "species,locality\nA b,1\n")
    put(d, "blank.csv", "   \n\n")
    put(d, "zero.csv", "")
    put(d, "book.xlsx", "scientificName\nA b\n")
    out = sheets.read_sheets(spark, d)
    rows = {r["scientificName"]: r for r in out.records.collect()}
    assert set(rows) == {"Aus bus", "Cus dus", "Eus fus", "Gus hus", "Ius jus", "Kus lus", "Mus nus", "Ous pus"}
    assert rows["Cus dus"]["locality"] == "Fazenda; 2"
    assert rows["Gus hus"]["taxonID"] == "7" and rows["Gus hus"]["locality"] is None
    assert rows["Ius jus"]["locality"] == "line\nbreak"
    assert rows["Kus lus"]["locality"] == 'say "hi"'
    reasons = {os.path.basename(r["source_file"]): r["reason"] for r in out.rejects.collect()}
    assert reasons["dup.csv"] == "repeated columns: locality (colunas 2, 3)"
    assert set(reasons) == {"dup.csv", "none.csv", "blank.csv", "book.xlsx", "zero.csv"}
    layout = {os.path.basename(r["source_file"]): r for r in out.layouts.collect()}
    assert layout["double.csv"]["labels"] == ["Nome científico", "Local"]
    assert layout["bom.csv"]["multi_line"] and not layout["double.csv"]["multi_line"]
    assert layout["tab.tsv"]["delimiter"] == "\t" and layout["tab.tsv"]["header_row"] == 2


def test_split_file_skips_only_its_header(spark, tmp_path):
    d = str(tmp_path)
    put(d, "big.csv", "label,label2\nscientificName,locality\n" + "".join(f"Aus b{i},scientificName\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert sheets.read_sheets(spark, d).records.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


KML = """<?xml version="1.0" encoding="UTF-8"?>
<!-- two
lines -->
<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>{}</Folder></Document></kml>"""


def polygon(ring, hole=""):
    inner = f"<innerBoundaryIs><LinearRing><coordinates>{hole}</coordinates></LinearRing></innerBoundaryIs>" if hole else ""
    return f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs>{inner}</Polygon>"


SQUARE = "-50,-20,0 -49,-20,0 -49,-19,0 -50,-19,0 -50,-20,0"
HOLE = "-49.6,-19.6 -49.4,-19.6 -49.4,-19.4 -49.6,-19.4 -49.6,-19.6"


def test_kml_areas_and_rejects(spark, tmp_path):
    d = str(tmp_path)
    put(d, "Fazenda A.kml", KML.format(
        f"<Placemark><name>p</name>{polygon(SQUARE, HOLE)}</Placemark><Placemark><Point><coordinates>-40,-10</coordinates></Point></Placemark>"))
    put(d, "dots.kml", KML.format("<Placemark><Point><coordinates>-47,-22</coordinates></Point></Placemark>"))
    put(d, "multi.kml", KML.format(f"<Placemark><MultiGeometry>{polygon(SQUARE)}{polygon(HOLE)}</MultiGeometry></Placemark>"))
    put(d, "evil.kml", KML.format("<NetworkLink/>"))
    put(d, "dtd.kml", "<!DOCTYPE kml [<!ENTITY x 'y'>]><kml/>")
    put(d, "html.kml", "<html></html>")
    put(d, "void.kml", "")
    put(d, "hollow.kml", KML.format(""))
    put(d, "shape.zip", "x")
    out = area_files.read_areas(spark, d)
    v = out.vertices.groupBy("area").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.max("ring").alias("r")).collect()
    got = {r["area"]: (r["n"], r["parts"], r["r"]) for r in v}
    assert got == {"Fazenda A": (10, 1, 1), "dots": (1, 1, 0), "multi": (10, 2, 0)}
    assert {r["file"] for r in out.rejects.collect()} == {"evil.kml", "dtd.kml", "html.kml", "void.kml", "hollow.kml", "shape.zip"}
    parts = spatial.polygon_edges(out.vertices, ["area"])
    points = spark.createDataFrame([(-49.5, -19.5), (-49.8, -19.8), (-47.0, -22.0)], "decimalLongitude double, decimalLatitude double")
    cells = spatial.area_cells(parts.where("area = 'Fazenda A'").withColumn("epsg", F.lit(5880)), 0)
    assert [tuple(r)[:2] for r in spatial.points_near(points, cells, 0).collect()] == [(-49.8, -19.8)]


def test_threatened_text_and_counts(spark, tmp_path):
    d = str(tmp_path)
    put(d, "list.txt", "﻿ANEXO 1\n| 1 | Fam | Aus bus Mart. | CR (PE) |\n| x | Fam | Aus cus | EN |\ntext\n"
        "ANEXO 2\n|2|Fam|Dus eus|VU| |\n| 3 | Fam | Genus | VU |\n| 4 | Fam | aus minor | VU |\n")
    rows = lists.threatened_rows(lists.numbered_lines(spark, d))
    got = [(r["scientificName"], r["match_key"], r["category"], r["source"]) for r in rows.orderBy("line_no").collect()]
    assert got == [
        ("Aus bus Mart.", "aus bus", "CR (PEX)", "Portaria 1.783/2026"), ("Dus eus", "dus eus", "VU", "Portaria 1.704/2026"),
    ]
    off = lists.count_mismatches(rows, {"Portaria 1.783/2026": 2, "Portaria 1.704/2026": 1}).collect()
    assert [(r["source"], r["expected"], r["found"]) for r in off] == [("Portaria 1.783/2026", 2, 1)]


def test_carry_forward_over_chunks(spark):
    lines = spark.createDataFrame([(i, "m%d" % i if i in (3, 17) else None) for i in range(40)], "line_no long, m string").withColumn("file", F.lit("f"))
    out = {r["line_no"]: r["got"] for r in lists.carry_forward(lines, F.col("m"), "got", chunk_lines=4).collect()}
    assert [out[i] for i in (0, 3, 8, 16, 17, 39)] == [None, "m3", "m3", "m3", "m17", "m17"]


def test_label_harmonization(spark):
    layer = spark.createDataFrame([("Amazônia",), ("Mangue",)], "biome string")
    mapped, unmapped = lists.harmonize_labels(layer, "biome")
    assert [r["biome"] for r in unmapped.collect()] == ["Mangue"]
    assert {r["biome"] for r in mapped.collect()} == {"Amazon", None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Aus bus", None, 1)], "scientificName string, locality string, n int")
    df = sheets.with_labels(df, {"scientificName": "Nome", "locality": "...2"})
    out = str(tmp_path / "o")
    sinks.write_standardized(df, out, ["scientificName", "locality", "criteria"])
    rows = spark.read.csv(f"{out}/rows", header=True).collect()
    assert rows[0].asDict() == {"scientificName": "Aus bus", "locality": None, "criteria": None}
    assert [tuple(r) for r in sinks.label_row(df).collect()] == [("Nome", "", "")]


def test_failing_source_is_reported(spark):
    def good(s):
        return bases.checklist("a", "A", 1, s.createDataFrame([("Aus bus", "Accepted")], "species string, taxonomicStatus string"))

    def bad(s):
        return bases.checklist("b", "B", 2, s.read.parquet("/tmp/no-such-folder-taxaledger"))

    held, failures = bases.load_sources(spark, {"b": bad, "a": good})
    assert [s.id for s in held] == ["a"]
    assert [r["provider"] for r in failures.collect()] == ["b"]


def test_annex_stays_in_its_file(spark, tmp_path):
    put(str(tmp_path), "a.txt", "ANEXO 1\n| 1 | Fam | Aus bus Mart. | VU |\n")
    put(str(tmp_path), "b.txt", "| 2 | Fam | Cus dus | EN |\nANEXO 2\n| 3 | Fam | Eus fus | EN |\n")
    rows = lists.threatened_rows(lists.numbered_lines(spark, str(tmp_path))).collect()
    assert {(r["scientificName"], r["source"]) for r in rows} == {("Aus bus Mart.", "Portaria 1.783/2026"), ("Cus dus", None), ("Eus fus", "Portaria 1.704/2026")}


def test_unmapped_labels_are_an_error(spark):
    layer = spark.createDataFrame([("Cerrado",), ("Atlantis",)], "biome string")
    with pytest.raises(ValueError, match="Atlantis"):
        lists.require_labels(layer, "biome")
    assert lists.require_labels(layer.limit(1), "biome").first()[0] == "Cerrado"


def test_long_quoted_preamble(spark, tmp_path):
    """Rows count, not lines: one cell of 421 lines stands above the header."""
    put(str(tmp_path), "long.csv", '"' + "about\n" * 421 + '"\nscientificName,locality\nAus bus,x\n')
    out = sheets.read_sheets(spark, str(tmp_path))
    assert [r["scientificName"] for r in out.records.collect()] == ["Aus bus"] and out.rejects.count() == 0


def test_seq_is_unique_and_labels_are_attached(spark, tmp_path):
    put(str(tmp_path), "a.csv", "Nome;Local\nscientificName;locality\nA b;1\nC d;2\n")
    put(str(tmp_path), "b.csv", "scientificName,locality\nE f,1\nG h,2\n")
    rows = sheets.read_sheets(spark, str(tmp_path)).records
    assert len({r["seq"] for r in rows.collect()}) == 4
    assert {f.name: f.metadata.get("label") for f in rows.schema.fields}["locality"] == "Local"


def test_many_shapes_stay_apart(spark):
    marks = spark.range(12_000).selectExpr(
        "'f.kml' as path", "id as place", "'n' as name",
        "array(named_struct('outerBoundaryIs', named_struct('LinearRing', named_struct('coordinates', '0,0 0,1 1,1 0,0')), 'innerBoundaryIs', cast(null as array<struct<LinearRing: struct<coordinates: string>>>))) as Polygon",
        "cast(null as array<struct<coordinates: string>>) as Point", f"cast(null as struct<Polygon: array<{area_files._POLYGON}>, Point: array<{area_files._POINT}>>) as MultiGeometry")
    assert area_files.placemark_vertices(marks).select("part").distinct().count() == 12_000


def test_stages_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from taxaledger.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=context)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(session)
    context.getCheckpointDir = lambda: "hdfs://host/shared"
    assert shared_folder(session) == "hdfs://host/shared"


def test_uploads_named_by_their_folder(spark, tmp_path):
    """Names with signs that folders escape, and an extension in capitals."""
    names = ["Área + 1.KML", "50% #2.kml", "a=b.kml", "plan.shp"]
    spark.createDataFrame([(n, KML.format(f"<Placemark>{polygon(SQUARE)}</Placemark>")) for n in names], "file string, value string").write.partitionBy("file").text(f"{tmp_path}/up")
    out = area_files.read_areas(spark, f"{tmp_path}/up", name=area_files.folder_name("file"), glob="part-*")
    assert sorted(r["area"] for r in out.vertices.select("area").distinct().collect()) == ["50% #2", "a=b", "Área + 1"]
    assert [tuple(r) for r in out.rejects.collect()] == [("plan.shp", "unsupported format")]


def test_parts_follow_the_placemarks(spark, tmp_path):
    marks = "".join(f"<Placemark><Point><coordinates>{i},1</coordinates></Point></Placemark>" for i in range(300))
    put(str(tmp_path), "many.kml", KML.format(marks))
    got = area_files.read_areas(spark, str(tmp_path)).vertices.orderBy("part").collect()
    assert [(r["part"], r["lon"]) for r in got] == [(i, float(i)) for i in range(300)]


def test_uploads_are_opened_by_many_tasks_and_parsed_once(spark, tmp_path, monkeypatch):
    """Few bytes in many files: one task would open them all, one after the other."""
    from catalogue import queries as Q
    from catalogue.views import Inputs
    from taxaledger.sources import area_files

    folder, staged = str(tmp_path / "uploads"), []
    stage = area_files.write_stage
    monkeypatch.setattr(Q, "_folder", lambda v: folder)
    monkeypatch.setattr(area_files, "write_stage", lambda df: staged.append(df.columns) or stage(df))
    read = Q._uploads(Inputs(spark, "/root/testdata/sf0.01"))
    tasks = {p.name.split("-")[1] for p in (tmp_path / "uploads").rglob("part-*")}
    assert len(tasks) > 4
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in read.__dict__.values()]
    assert ["path", "place", "i", "s"] in staged and not any("Polygon" in p for p in plans)
