"""Sources that are stored once, fail, or leave a name to the closest key."""

import pytest
from pyspark.sql import functions as F

from taxaledger.operators import answers as A
from taxaledger.operators import records as R
from taxaledger.operators import threat as T
from taxaledger.plans.full_run import Geography, Reference, run_all
from taxaledger.plans.resolve import resolve_with_failures
from taxaledger.sources import bases


def checklist(spark, id, priority, rows, bad=False):
    df = spark.createDataFrame(rows, "seq long, species string, taxonomicStatus string, id string")
    df = df.withColumns({"scientificName": F.concat("species", F.lit(" L.")), "acceptedName": F.col("species"), "states": F.lit("SP"), "biome": F.lit(None).cast("string")})
    if bad:
        df = df.withColumn("id", F.when(F.col("seq") > 0, F.raise_error(F.lit("disk gone"))).otherwise(F.col("id")))
    return bases.checklist(id, id, priority, df, accepted_column="acceptedName", distribution=True)


def backbone(spark, priority=9):
    rows = [(1, "Aus bus", "ACCEPTED", None, "SPECIES", "Aus"), (2, "Longname speciosissimus", "ACCEPTED", None, "SPECIES", "Longname"), (3, "Cus", "ACCEPTED", None, "GENUS", "Cus")]
    return bases.backbone("gbif", "Backbone", priority, spark.createDataFrame(rows, "usageKey long, canonicalName string, status string, acceptedUsageKey long, rank string, genus string"))


def test_a_source_that_fails_while_read_is_skipped(spark):
    names = spark.createDataFrame([("Aus bus",), ("Dus eus",)], "query_name string")
    good = checklist(spark, "good", 2, [(1, "Dus eus", "Accepted", "g1")])
    bad = checklist(spark, "bad", 1, [(1, "Aus bus", "Accepted", "x"), (0, "Dus eus", "Accepted", "y")], bad=True)
    cascade, failures = resolve_with_failures(names, [bad, good, backbone(spark)])
    assert {(r["query_name"], r["provider"], r["validation_status"]) for r in cascade.collect()} == {("Aus bus", "gbif", "accepted"), ("Dus eus", "good", "accepted")}
    [failed] = failures.collect()
    assert failed["provider"] == "bad" and "disk gone" in failed["error"]
    cascade, failures = resolve_with_failures(names, [bad])
    assert {r["validation_status"] for r in cascade.collect()} == {"not_found"} and failures.count() == 1


def test_a_run_without_its_backbone_or_checklists(spark):
    """What could not be asked is not known, never absent."""
    square = [("Plot", 0, 0, i, -50.0 + x, -20.0 + y) for i, (x, y) in enumerate([(0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1), (0, 0)])]
    from taxaledger.operators.spatial import polygon_edges

    edges = polygon_edges(spark.createDataFrame(square, "area string, part int, ring int, seq int, lon double, lat double"), ["area"])
    regions = edges.select(F.lit("state").alias("kind"), F.lit("SP").alias("label"), *[c for c in edges.columns if c != "area"])
    points = spark.createDataFrame([("k", "1", "1", None, -49.95, -19.95, "d")], "key string, taxonKey string, speciesKey string, genusKey string, decimalLongitude double, decimalLatitude double, datasetKey string")
    records = spark.createDataFrame([(1, "Aus bus", None, None, "plot")], "record_id long, scientificName string, taxonID string, kingdom string, locality string")
    areas = spark.createDataFrame([("Plot", ["plot"])], "area string, localities array<string>")
    listed = spark.createDataFrame([(1, "Aus bus", "aus bus", "VU", "x")], "seq long, scientificName string, match_key string, category string, source string")
    invasive = spark.createDataFrame([], "scientificName string, match_key string, invasiveSource string")
    table = backbone(spark).table
    broken = bases.NameSource("gbif", "Backbone", bases.BACKBONE, 9, table.withColumn("family", F.raise_error(F.lit("no backbone"))))
    good = checklist(spark, "good", 1, [(1, "Aus bus", "Accepted", "g1")])

    def run(sources):
        return run_all(records, Reference(sources, listed, invasive), Geography(areas, edges, regions, points))

    whole = run([good, backbone(spark)])
    assert whole.geo.per_species.first()["gbif_count"] == 1 and whole.failures.count() == 0
    without = run([good, broken])
    row = without.geo.per_species.first()
    assert (row["gbif_count"], row["has_gbif"], row["gbif_failed"], row["state_match"]) == (None, None, True, True)
    assert without.standardized.count() == 1 and [r["provider"] for r in without.failures.collect()] == ["gbif"]
    alone = run([backbone(spark)])  # no accepted names, no distribution
    assert alone.cascade.first()["statusMMA"] is not None and alone.geo.per_species.first()["state_match"] is None


def test_lookups_in_stored_bases_need_no_exchange(spark):
    held = bases.store(checklist(spark, "a", 1, [(i, f"Aus b{i}", "Accepted", str(i)) for i in range(50)]), buckets=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(A.base_taxonomy(held.table))
    names = spark.createDataFrame([(f"Aus b{i}", f"aus b{i}") for i in range(0, 100, 2)], "query_name string, mk string").hint("merge")
    joined = names.join(A.base_taxonomy(held.table), "mk", "left")
    assert plan(joined).count("Exchange hashpartitioning") == 1  # the names
    assert joined.where("id is not null").count() == 25


def test_a_misspelled_name_of_a_checklist_has_a_category(spark):
    """The backbone answered the first row with its key; the second goes by name, the third has none."""
    rows = spark.createDataFrame([("Longname speciosissimuss", "gbif", "2"), ("Longname speciosisimus", "good", "g7"), ("Cus nowhere", "good", None), (None, "good", None)], "scientificName string, provider string, taxonID string")
    by_key = spark.createDataFrame([(2, "EN"), (1, "LC")], "usageKey long, code string")
    got = {r["scientificName"]: r["iucnCategory"] for r in T.redlist_category(rows, backbone(spark), by_key).collect()}
    assert got == {"Longname speciosissimuss": "EN", "Longname speciosisimus": "EN", "Cus nowhere": None, None: None}
    exact = {r["scientificName"]: r["iucnCategory"] for r in T.redlist_category(rows, backbone(spark), by_key, near=False).collect()}
    assert exact["Longname speciosisimus"] is None


@pytest.mark.parametrize("word, status", [("valid", "accepted"), ("junior synonym", "synonym"), ("Uncertain", "ambiguous"), ("doubtful", "not_found")])
def test_a_source_with_its_own_status_words(spark, word, status):
    base = spark.createDataFrame([(1, "Aus bus", word, "1")], "seq long, species string, taxonomicStatus string, id string")
    own = bases.checklist("own", "Own", 1, base.withColumn("scientificName", F.col("species")), status_words={"valid": "accepted", "junior synonym": "synonym", "uncertain": "ambiguous"})
    cascade, _ = resolve_with_failures(spark.createDataFrame([("Aus bus",)], "query_name string"), [own])
    assert [(r["validation_status"], r["provider"], r["taxonomicStatus"]) for r in cascade.collect()] == [(status, "own", word)]


def test_a_source_without_rows(spark):
    """It knows no name it is asked for; the empty answer has the canonical columns."""
    from taxaledger.operators.canonical import empty_result
    from taxaledger.schema import CANONICAL_COLUMNS

    empty = checklist(spark, "empty", 1, [])
    cascade, failures = resolve_with_failures(spark.createDataFrame([("Aus bus",)], "query_name string"), [empty])
    assert [(r["validation_status"], r["provider"]) for r in cascade.collect()] == [("not_found", "empty")] and failures.count() == 0
    assert tuple(empty_result(spark).columns) == tuple(CANONICAL_COLUMNS) and empty_result(spark).count() == 0


def test_answers_take_the_parsed_name_along(spark, monkeypatch):
    """Names parsed once are not parsed again for each (name, locality) pair."""
    monkeypatch.setattr(R, "normalize_name", None)
    pairs = spark.createDataFrame([("Aus bus L.", "Aus bus", "a"), ("Aus bus L.", "Aus bus", "b"), (None, None, "a")], "scientificName string, query_name string, locality string")
    cascade = spark.createDataFrame([("Aus bus", "Aus")], "query_name string, genus string")
    out = R.answers_for(pairs, cascade)
    assert out.columns == ["scientificName", "locality", "_c"]
    assert sorted((r["locality"], r["_c"] and r["_c"]["genus"]) for r in out.where("scientificName IS NOT NULL").collect()) == [("a", "Aus"), ("b", "Aus")]
    assert out.where("scientificName IS NULL").first()["_c"] is None


_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["map_points", "fuzzy_best", "iucn_category"])
def test_a_query_searches_its_names_once(spark, monkeypatch, name):
    """However many steps go on from the answers, the sources' closest names are searched once."""
    from catalogue import queries as Q

    asked = []
    search = Q.rsv.fuzzy_best
    monkeypatch.setattr(Q.rsv, "fuzzy_best", lambda *a: asked.append(1) or search(*a))
    Q.QUERIES[name](spark, _SMALL)
    assert len(asked) == 1


@pytest.mark.parametrize("name", ["names_by_area", "accepted_name_map", "audit"])
def test_plans_that_go_on_from_answers_parse_no_name(spark, name):
    """Typed names are parsed, and answers chosen, where they are written: not once per use in a later plan."""
    from catalogue import queries as Q

    plan = Q.QUERIES[name](spark, _SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "greatest(" not in plan and plan.count("regexp_replace") <= 4
