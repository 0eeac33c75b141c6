"""Joins and matchers that must stay exact when one key holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from taxaledger.functions.geodesy import project
from taxaledger.operators import joins as J
from taxaledger.operators import occurrences as O
from taxaledger.operators import spatial as G
from taxaledger.operators.fuzzy import fuzzy_pairs
from taxaledger.session import write_stage


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_hot_keys_are_few_and_right(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 900).alias("k"))
    assert [r["k"] for r in J.hot_keys(df, ["k"], rows=300).collect()] == [None]
    weighted = df.groupBy("k").agg(F.count("*").alias("n"))
    assert [r["k"] for r in J.hot_keys(weighted, ["k"], weight="n", rows=300).collect()] == [None]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows", [0, 1000])
def test_lookup_join_equals_plain_join(spark, how, rows):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"))
    left = left.withColumn("k", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("k")))
    right = spark.createDataFrame([(k, f"v{k}") for k in [None, 7, 3, 9, 99]], "k long, v string")
    got = J.lookup_join(left, right, ["k"], how=how, rows=rows)
    r = right.select(F.col("k").alias("k2"), "v")
    want = left.join(r, left["k"].eqNullSafe(r["k2"]), how).drop("k2")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_split_join_spreads_the_hot_key(spark):
    left = spark.range(0, 20000, 1, 4).select("id", F.lit(1).alias("k"))
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.split_join(left, right, ["k"], J.hot_keys(left, ["k"], rows=500))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20000 and max(sizes) < 12000


def test_both_sides_split_meet_once(spark):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(200).select(F.col("id").alias("j"), F.when(F.col("id") % 2 > 0, 1).otherwise(F.col("id") % 5).alias("k"))
    hot = J.both_hot(J.hot_keys(left, ["k"], rows=50), J.hot_keys(right, ["k"], rows=40), ["k"])
    assert {(r["k"], r["_splits"], r["_right_splits"]) for r in hot.collect()} == {(1, 5, 3)}
    got = J.split_join(left, right, ["k"], hot, how="inner").select("id", "j")
    want = left.join(right, "k").select("id", "j")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    targets = [f"Aus {word(rng.randint(1, 9))}" for _ in range(150)] + [word(rng.randint(1, 45)).capitalize() for _ in range(100)] + ["A"]

    def spoil(name):
        s = list(name)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(s) + 1)
            act = rng.randrange(3)
            if act == 0:
                s.insert(at, rng.choice("abcde"))
            elif s and at < len(s):
                s[at:at + 1] = [] if act == 1 else [rng.choice("abcde")]
        return "".join(s) or "A"

    queries = {spoil(rng.choice(targets)) for _ in range(250)}
    q = spark.createDataFrame([(x,) for x in queries], "q string")
    t = spark.createDataFrame([(x,) for x in set(targets)], "t string")
    got = {(r["q"], r["t"], r["distance"]) for r in fuzzy_pairs(q, t, "q", "t").collect()}
    want = {(a, b, edits(a, b)) for a in queries for b in set(targets) if edits(a, b) <= -(-len(a) // 10)}
    assert got == want


def test_nearest_of_each_source_equals_brute_force(spark):
    """Queries of one to four edits; sources that hold the same name, or none near."""
    from taxaledger.operators.nearest import fuzzy_best
    from taxaledger.sources import bases

    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    pool = [f"Aus {word(2, 9)}" for _ in range(60)] + [word(21, 36).capitalize() for _ in range(30)] + ["A", "Ab"]
    held = [sorted({rng.choice(pool) for _ in range(50)}) for _ in range(2)]
    queries = {}
    for name in pool * 2:
        at = rng.randrange(len(name))
        name = name[:at] + rng.choice(["", "a", "bc", "cab"]) + name[at + rng.randint(0, 1):]
        queries[name or "A"] = rng.randint(1, 3)
    asked = spark.createDataFrame(list(queries.items()), "query_name string, ask int")
    rows = [[(i, n, n, rng.choice(["accepted", "synonym"])) for i, n in enumerate(h)] for h in held]
    schema = "seq long, species string, scientificName string, taxonomicStatus string"
    src = [bases.checklist(f"s{i}", "S", i, spark.createDataFrame(r, schema)) for i, r in enumerate(rows)]
    got = {(r["query_name"], r["src"]): (r["distance"], r["seq"], r["target"]) for r in fuzzy_best(asked, src).collect()}
    want = {}
    for q, ask in queries.items():
        for i, r in enumerate(rows):
            near = [(edits(q, n), st == "synonym", seq, n) for seq, n, _, st in r if ask >> i & 1 and edits(q, n) <= -(-len(q) // 10)]
            if near:
                d, _, seq, n = min(near)
                want[q, i] = (d, seq, n)
    assert got == want and {d for d, _, _ in want.values()} >= {0, 1, 2, 3}


def test_names_of_one_crowded_genus_hardly_meet(spark):
    """Names that share a long genus alone are never compared, so the work does not grow with its square."""
    from taxaledger.operators import fuzzy

    rng = random.Random(4)
    names = sorted({"Large ring" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(r["t"] * r["q"])

    q = fuzzy.remnants(df.where("hash(n) % 4 = 0"), "n", 2).groupBy("_sig").agg(F.count("*").alias("q"))
    t = fuzzy.remnants(df, "n", 2).groupBy("_sig").agg(F.count("*").alias("t"))
    q.join(t, "_sig").foreachPartition(count)
    asked = df.where("hash(n) % 4 = 0").count()
    # Each meets itself on all its 137 remnants; on segments each would meet all 4,000 twice.
    assert seen.value < 400 * asked


def test_two_edits_meet_on_few_remnants_of_the_end(spark):
    """Edits at either end, in both parts and at the cut are found; a long name leaves 22 rows, not 137."""
    from taxaledger.operators import fuzzy

    rng = random.Random(6)
    heads = ["Large ring", "Large rin", "Barge ring", "Small ", "Sm", "Aaaaaaaa"]
    targets = sorted({rng.choice(heads) + "".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(160)})
    queries = set()
    for name in targets * 2:
        for _ in range(2):
            at = rng.choice([0, 1, len(name) - 7, len(name) - 6, len(name) - 5, len(name) - 1])
            name = name[:at] + rng.choice(["", "a", "b", "ab"]) + name[at + rng.randint(0, 1):]
        queries.add(name)
    queries = {q for q in queries if 11 <= len(q) <= 20}
    q = spark.createDataFrame([(x,) for x in queries], "q string")
    t = spark.createDataFrame([(x,) for x in targets], "t string")
    got = {(r["q"], r["t"], r["distance"]) for r in fuzzy.remnant_pairs(q, t, "q", "t", 2).collect()}
    assert got == {(a, b, edits(a, b)) for a in queries for b in targets if edits(a, b) <= 2}
    names = sorted({"Large ring" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    asked, held = fuzzy._tail_signatures(df.where("hash(n) % 4 = 0").withColumnRenamed("n", "q"), df, "q", "n", 2)
    assert held.count() == 22 * len(names)
    met = asked.groupBy("_sig").agg(F.count("*").alias("a")).join(held.groupBy("_sig").agg(F.count("*").alias("b")), "_sig")
    assert met.agg(F.sum(F.col("a") * F.col("b")).alias("n")).first()["n"] < 400 * df.where("hash(n) % 4 = 0").count()


def test_ends_left_alike_meet_within_the_edits_alone(spark):
    """Of a crowded genus no pair that meets is further apart than two edits: no distance is worked out in vain."""
    from taxaledger.operators import fuzzy

    rng = random.Random(11)
    names = sorted({"Large ring" + "".join(rng.choice("abcde") for _ in range(rng.choice([5, 6, 6, 6, 7]))) for _ in range(1500)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    asked, held = fuzzy._tail_signatures(df.where("hash(n) % 4 = 0").withColumnRenamed("n", "q"), df, "q", "n", 2)
    held = held.withColumnRenamed("_places", "_held")
    met = asked.join(held, "_sig").where(F.col("_places").bitwiseAND(F.col("_held")) != 0).select("q", "n").distinct()
    near = met.agg(F.count_if(F.levenshtein("q", "n") <= 2).alias("near"), F.count("*").alias("all")).first()
    q = df.where("hash(n) % 4 = 0").withColumnRenamed("n", "q")
    assert near["near"] == near["all"] == q.join(df, F.levenshtein("q", "n") <= 2).count() > 1000


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in J.first_per_key(df, ["k"], [F.col("o")], ["v"]).collect()} == {("a", "y"), ("b", "z")}


def test_dedupe_by_key_or_whole_row(spark):
    rows = [("a", "t", 1.0, 1.0, "d", "k1"), ("a", "t", 0.5, 1.0, "d", "k1"), ("a", "u", 1.0, 1.0, "d", "k1"),
            ("a", "u", 2.0, 1.0, "d", "k1"), ("a", "u", 2.0, 1.0, "d", "k1"), ("a", "u", 3.0, 1.0, "d", None)]
    df = spark.createDataFrame(rows, "area string, taxon string, decimalLongitude double, decimalLatitude double, datasetKey string, key string")
    got = sorted((r["taxon"], r["decimalLongitude"]) for r in O.dedupe(df, ["area", "taxon"]).collect())
    assert got == [("t", 0.5), ("u", 1.0), ("u", 2.0), ("u", 3.0)]
    counts = {r["taxon"]: r["gbif_count"] for r in O.distinct_counts(df, ["area", "taxon"]).collect()}
    assert counts == {"t": 1, "u": 3}


def test_projection_and_buffer_of_a_point(spark):
    # One degree of latitude on the central meridian of zone 23S (EPSG 31983).
    row = spark.range(1).select(project(F.lit(-45.0), F.lit(-20.0), F.lit(31983)).alias("a"), project(F.lit(-45.0), F.lit(-21.0), F.lit(31983)).alias("b")).first()
    assert row["a"]["x"] == pytest.approx(500000.0, abs=1e-6)
    assert row["a"]["y"] - row["b"]["y"] == pytest.approx(110704.3 * 0.9996, abs=15)
    vertices = spark.createDataFrame([("p", 0, 0, 0, -47.9, -15.8)], "area string, part int, ring int, seq int, lon double, lat double")
    parts = G.polygon_edges(vertices, ["area"])
    cells = G.area_cells(parts.join(G.area_zone(parts), "area"), 10_000.0)
    points = spark.createDataFrame([("in", -47.9, -15.8 + 9_900 / 110_650), ("out", -47.9, -15.8 + 10_100 / 110_650), ("east", -47.9 + 9_900 / 107_150, -15.8)],
                                   "key string, decimalLongitude double, decimalLatitude double")
    assert sorted(r["key"] for r in G.points_near(points, cells, 10_000.0).collect()) == ["east", "in"]


def test_a_centroid_on_the_border_of_two_zones(spark):
    """Squares around a border and around the equator, whatever the last digits of their sums."""
    rows = []
    for i, (x, y) in enumerate([(-84.0, -23.8), (-78.0, -10.0), (-48.0, -23.5), (-54.0, 3.3), (-50.0, 0.0)]):
        ring = [(-0.04, -0.04), (0.04, -0.04), (0.04, 0.04), (-0.04, 0.04), (-0.04, -0.04)]
        rows += [(f"p{i}", 0, 0, s, round(x + a, 2), round(y + b, 2)) for s, (a, b) in enumerate(ring)]
    zones = G.area_zone(G.polygon_edges(spark.createDataFrame(rows, _VERTEX), ["area"]))
    assert {r["area"]: r["epsg"] for r in zones.collect()} == {"p0": 31977, "p1": 31978, "p2": 31983, "p3": 31976, "p4": 31976}


def test_holes_and_cells(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    hole = [(x * 0.5 + 0.25, y * 0.5 + 0.25) for x, y in ring]
    rows = [("a", 0, r, i, -50 + x, -20 + y) for r, vs in enumerate((ring, hole)) for i, (x, y) in enumerate(vs)]
    v = spark.createDataFrame(rows, "area string, part int, ring int, seq int, lon double, lat double")
    cells = G.area_cells(G.polygon_edges(v, ["area"]).withColumn("epsg", F.lit(5880)), 0)
    rng = random.Random(1)
    pts = [(i, -50.2 + rng.random() * 1.4, -20.2 + rng.random() * 1.4) for i in range(400)]
    p = spark.createDataFrame(pts, "id int, decimalLongitude double, decimalLatitude double")
    got = {r["id"] for r in G.points_near(p, cells, 0).collect()}
    box = lambda x, y, a, b: a < x < b and a < y < b
    want = {i for i, x, y in pts if box(x + 50, y + 20, 0, 1) and not box(x + 50, y + 20, 0.25, 0.75)}
    assert got == want


def _square(area, part, ring, x, y, w):
    return [(area, part, ring, i, x + dx * w, y + dy * w) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]


_VERTEX = "area string, part int, ring int, seq int, lon double, lat double"


def test_a_record_counts_once_per_area(spark):
    """Two close parts: a record near both is one record, and a page keeps all."""
    from taxaledger.operators import occurrences as O

    rows = _square("A", 0, 0, -50.0, -20.0, 0.1) + _square("A", 1, 0, -49.88, -20.0, 0.1)
    parts = G.polygon_edges(spark.createDataFrame(rows, _VERTEX), ["area"])
    cells = G.area_cells(parts.join(G.area_zone(parts), "area"), 10_000.0)
    points = spark.createDataFrame([("1", -49.89, -19.95), ("2", -49.95, -19.95)], "key string, decimalLongitude double, decimalLatitude double")
    near = G.points_near(points, cells, 10_000.0).withColumn("taxon", F.lit("t")).withColumn("datasetKey", F.lit("d"))
    assert sorted(r["key"] for r in near.collect()) == ["1", "2"]
    page = O.first_page(near, ["area", "taxon"], 2).collect()
    assert sorted((r["key"], r["gbif_status"]) for r in page) == [("1", "complete"), ("2", "complete")]


def test_holes_and_their_winding(spark):
    """A hole counts off however it is wound, and a point deep in it is out."""
    hole = _square("A", 0, 1, -49.5, -20.0, 0.8)
    outer = _square("A", 0, 0, -50.0, -20.5, 1.6)
    points = spark.createDataFrame([("hole", -49.1, -19.6), ("rim", -49.9, -19.6)], "key string, decimalLongitude double, decimalLatitude double")
    for ring in (hole, [(a, p, r, 4 - i, x, y) for a, p, r, i, x, y in hole]):
        parts = G.polygon_edges(spark.createDataFrame(outer + ring, _VERTEX), ["area"])
        zoned = parts.join(G.area_zone(parts), "area")
        assert {r["epsg"] for r in zoned.collect()} == {31982}
        cells = G.area_cells(zoned, 10_000.0)
        assert [r["key"] for r in G.points_near(points, cells, 10_000.0).collect()] == ["rim"]


def test_occurrence_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "occ")
    spark.range(1000).selectExpr("cast(id as string) as key", "-60.0 + id / 50 as decimalLongitude", "-25.0 + id / 100 as decimalLatitude").write.parquet(path)
    parts = G.polygon_edges(spark.createDataFrame(_square("A", 0, 0, -50.0, -20.0, 0.1), _VERTEX), ["area"])
    cells = G.area_cells(parts.join(G.area_zone(parts), "area"), 10_000.0)
    plan = G.points_near(spark.read.parquet(path), cells, 10_000.0)._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(decimalLongitude" in pushed  # the rest of the list is cut in the text


def test_a_page_of_text_as_a_name(spark):
    """It makes signatures only for lengths that targets have."""
    from taxaledger.operators.fuzzy import query_signatures

    names = spark.createDataFrame([("x" * 10_000,), ("Aus bus",)], "n string")
    lengths = spark.createDataFrame([(7,), (8,)], "_n int")
    got = query_signatures(names, "n", 0.1, lengths)
    assert got.where("length(n) > 100").count() == 0 and got.count() > 0


def _even_odd(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                n += 1
    return n % 2 == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_equal_even_odd(spark, seed):
    """Ragged outlines with a hole and a detached part, some on the grid's own lines, against the plain rule."""
    rng = random.Random(seed)

    def star(cx, cy, r, n, snap):
        ring = [(cx + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        ring = [(round(x, 2), round(y, 2)) if snap else (x, y) for x, y in ring]
        return ring + ring[:1]

    parts = [[star(-50, -20, 0.8, 40, seed == 1), star(-50, -20, 0.25, 9, seed != 3)], [star(-48.5, -19.5, 0.3, 25, True)]]
    rows = [("A", p, r, i, float(x), float(y)) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    edges = G.polygon_edges(spark.createDataFrame(rows, _VERTEX), ["area"])
    pts = [(i, rng.uniform(-51, -48), rng.uniform(-21, -19)) for i in range(1500)]
    pts += [(2000 + i, rng.randrange(-1020, -960) / 20 + rng.choice([0, 1e-7]), rng.uniform(-21, -19)) for i in range(500)]
    p = spark.createDataFrame(pts, "id int, decimalLongitude double, decimalLatitude double")
    got = {r["id"] for r in G.points_near(p, G.area_cells(edges, 0.0), 0.0).collect()}
    assert got == {i for i, x, y in pts if any(_even_odd(rings, x, y) for rings in parts)}


def test_a_diagonal_takes_the_cells_it_crosses(spark):
    """Ten degrees: two cells a grid row, not the 40,000 of the box."""
    line = spark.createDataFrame([("a", 0, 0, 0, -50.013, -20.02, -40.001, -10.07)], "area string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    cells = G.edge_cells(line)
    rows = 10 * G.CELLS_PER_DEGREE
    assert 1.9 * rows < cells.select("cell_x", "cell_y").distinct().count() == cells.count() < 2.1 * rows


def test_an_outline_of_a_million_vertices(spark):
    """A flower of a million vertices: no row holds more than a cell's share of it."""
    n = 1_000_000
    radius = "(1.5 + 0.3 * sin(40 * 2 * pi() * pmod(id, {n}) / {n}))".format(n=n)
    vertices = spark.range(0, n + 1, 1, 16).selectExpr(
        "'A' as area", "0 as part", "0 as ring", "id as seq",
        f"-50 + {radius} * cos(2 * pi() * pmod(id, {n}) / {n}) as lon", f"-20 + {radius} * sin(2 * pi() * pmod(id, {n}) / {n}) as lat")
    cells = G.area_cells(G.polygon_edges(vertices, ["area"]), 0.0)
    cells = write_stage(cells)
    assert cells.selectExpr("max(aggregate(parts, 0, (n, p) -> n + size(p.edges))) as most").first()["most"] < n / 200
    rng = random.Random(4)
    pts = [(i, rng.uniform(-52, -48), rng.uniform(-22, -18)) for i in range(3000)]
    got = {r["id"] for r in G.points_near(spark.createDataFrame(pts, "id int, decimalLongitude double, decimalLatitude double"), cells, 0.0).collect()}
    side = lambda x, y: math.hypot(x + 50, y + 20) - (1.5 + 0.3 * math.sin(40 * math.atan2(y + 20, x + 50)))
    clear = {i: side(x, y) < 0 for i, x, y in pts if abs(side(x, y)) > 1e-6}
    assert all((i in got) == held for i, held in clear.items())


def test_hot_cells_are_split_on_both_sides(spark, monkeypatch):
    """Many short edges of both sides in one cell: the same answer from split keys."""
    monkeypatch.setattr(J, "TASK_ROWS", 20)
    areas = [(f"A{i}", 0, 0, s, -50.001 + i * 1e-4 + dx * 5e-5, -20.001 + dy * 5e-5) for i in range(40) for s, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])]
    regions = [("state", f"S{i}", 0, 0, s, -50.0012 + i * 2e-4 + dx * 2e-4, -20.002 + dy * 2e-3) for i in range(22) for s, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    a = G.polygon_edges(spark.createDataFrame(areas, _VERTEX), ["area"])
    r = G.polygon_edges(spark.createDataFrame(regions, "kind string, label string, " + _VERTEX.split(", ", 1)[1]), ["kind", "label"])
    got = {(x["area"], x["label"]) for x in G.areas_over_regions(a, r).collect()}
    box = lambda rows, at: (min(v[at] for v in rows), max(v[at] for v in rows))
    want = set()
    for i in range(40):
        lo, hi = box([v for v in areas if v[0] == f"A{i}"], 4)
        want |= {(f"A{i}", f"S{j}") for j in range(22) if (b := box([v for v in regions if v[1] == f"S{j}"], 5)) and lo <= b[1] and hi >= b[0]}
    assert got == want


def test_each_place_is_held_against_many_areas_once(spark, monkeypatch):
    """Areas past a broadcast: 2,000 records on four places cost the exact test of four."""
    from taxaledger.plans.verify import buffer_cells

    square = [(0, 0), (0.08, 0), (0.08, 0.08), (0, 0.08), (0, 0)]
    corners = [("west", -49.0, -20.0), ("east", -48.95, -20.02), ("far", -30.0, -20.0)]
    vertices = [(a, 0, 0, i, x + dx, y + dy) for a, x, y in corners for i, (dx, dy) in enumerate(square)]
    edges = G.polygon_edges(spark.createDataFrame(vertices, "area string, part int, ring int, seq int, lon double, lat double"), ["area"])
    cells = buffer_cells(edges)
    places = [(-48.96, -19.96), (-49.05, -19.95), (-48.8, -19.95), (-48.5, -20.0)]
    points = spark.range(2000).select(
        F.col("id").cast("string").alias("key"),
        *[F.element_at(F.array(*[F.lit(p[n]) for p in places]), (F.col("id") % 4 + 1).cast("int")).alias(c) for n, c in enumerate(("decimalLongitude", "decimalLatitude"))])
    want = sorted((r["area"], r["key"]) for r in G.points_near(points, cells, 10_000.0).collect())
    assert {int(k) % 4 for _, k in want} == {0, 1, 2} and len(want) == 2000

    tested = []
    split = G.split_join

    def counted(left, *rest, **named):
        tested.append(left.count())
        return split(left, *rest, **named)

    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "split_join", counted)
    monkeypatch.setattr(G, "split_join", counted)
    # Places are hot by the rows that come out of them.
    monkeypatch.setattr(J, "TASK_ROWS", 600)
    got = G.points_near(points, cells, 10_000.0)
    assert sorted((r["area"], r["key"]) for r in got.collect()) == want
    assert got.columns == [*points.columns, "area"]
    # Only the last join, which tests nothing, has all records.
    assert max(tested[:-1]) <= 4 and tested[-1] == 2000


def test_projection_in_steps_equals_the_expression(spark):
    from taxaledger.functions.geodesy import with_metric

    rows = [(-45.3, -20.1, 31983), (-48.0, 1.2, 31976), (-54.0, 0.0, 5880), (-86.2, -21.7, 5880), (-47.9, 0.0, 31982)]
    df = spark.createDataFrame(rows, "lon double, lat double, epsg int").withColumn("p", project(F.col("lon"), F.col("lat"), F.col("epsg")))
    for r in with_metric(df, "lon", "lat", "epsg", "x", "y").collect():
        assert abs(r["x"] - r["p"]["x"]) < 1e-6 and abs(r["y"] - r["p"]["y"]) < 1e-6
