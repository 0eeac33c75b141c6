"""Points near polygons and polygons over polygons, as equi joins on grid cells.

A polygon table has one row per edge: its keys, ``part, ring, seq`` and
``x1, y1, x2, y2`` in degrees (``polygon_edges`` builds it from vertices). Rings
are closed; a part of one vertex is a point and encloses nothing. No row ever
holds a whole outline.

Each edge goes to the grid cells it crosses or comes near. Where a part's
outline does not come, a cell lies inside it or outside as a whole: one bit,
worked out row by row of the grid from the places where edges cross the row's
lower line. A cell with edges has that bit for its south-eastern corner, and a
point in it is inside if the way from the point to the corner crosses the cell's
own edges often enough. So the exact test costs what the outline in the cell
costs, not the whole polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import metric_epsg, segment_distance_sq, segment_place, segments_touch, with_metric
from ..session import write_stage
from .joins import both_hot, fits_broadcast, hot_keys, lookup_join, split_join

CELLS_PER_DEGREE = 20
# Metres per degree, rounded to the safe side for padding.
_LAT_METRES = 110_000.0
_LON_METRES = 111_000.0
# Decimal digits of a centroid that choose its zone.
ZONE_DIGITS = 9
# Degrees by which every cell is widened, against rounding at its border.
_BORDER = 1e-9


def polygon_edges(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edge from closed vertex rings.

    ``vertices`` has the keys, ``part``, ``ring``, ``seq``, ``lon``, ``lat``;
    ``seq`` counts without gaps in a ring. Edges come from an equi join of each
    vertex with the next one. A ring of one vertex is an edge without length.
    """
    ring = [*keys, "part", "ring"]
    nxt = vertices.select(*ring, (F.col("seq") - 1).alias("seq"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    here = vertices.select(*ring, "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    edges = here.join(nxt, [*ring, "seq"], "left").where(F.col("x2").isNotNull() | (F.col("seq") == 0))
    return edges.select(*ring, "seq", "x1", "y1", F.coalesce("x2", "x1").alias("x2"), F.coalesce("y2", "y1").alias("y2"))


def _first_vertices(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``vx, vy``: the first vertex of each part."""
    return edges.where((F.col("seq") == 0) & (F.col("ring") == 0)).select(*keys, "part", F.col("x1").alias("vx"), F.col("y1").alias("vy"))


def area_zone(edges: DataFrame, key: str = "area") -> DataFrame:
    """``area, epsg``: metric zone of the centroid of all parts of an area.

    The first ring of a part counts on and its other rings, the holes, count
    off, whichever way each is wound; an area without extent falls back to the
    mean of its vertices. A centroid on the border of two zones is in the
    eastern one, one on the equator in the north: it is rounded to a tenth of a
    millimetre, so that the last digits of the sums do not decide.
    """
    # Relative to the part's first vertex, to keep the digits.
    e = edges.join(_first_vertices(edges, [key]), [key, "part"])
    x1, y1, x2, y2 = F.col("x1") - F.col("vx"), F.col("y1") - F.col("vy"), F.col("x2") - F.col("vx"), F.col("y2") - F.col("vy")
    cross = x1 * y2 - x2 * y1
    per_part = e.select(
        key, "part", "ring", "vx", "vy", "x1", "y1",
        cross.alias("c"), (cross * (x1 + x2)).alias("cx"), (cross * (y1 + y2)).alias("cy"),
    ).groupBy(key, "part", "ring", "vx", "vy").agg(
        F.sum("c").alias("c"), F.sum("cx").alias("cx"), F.sum("cy").alias("cy"),
        F.sum("x1").alias("sx"), F.sum("y1").alias("sy"), F.count(F.lit(1)).alias("n"),
    )
    side = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    weight = side * F.abs(F.col("c"))
    sums = per_part.groupBy(key).agg(
        F.sum(weight).alias("w"),
        F.sum(weight * F.col("vx") + side * F.signum("c") * F.col("cx") / 3).alias("x"),
        F.sum(weight * F.col("vy") + side * F.signum("c") * F.col("cy") / 3).alias("y"),
        F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("n").alias("n"),
    )
    lon = F.when(F.col("w") > 0, F.col("x") / F.col("w")).otherwise(F.col("sx") / F.col("n"))
    lat = F.when(F.col("w") > 0, F.col("y") / F.col("w")).otherwise(F.col("sy") / F.col("n"))
    return sums.select(key, metric_epsg(F.round(lon, ZONE_DIGITS), F.round(lat, ZONE_DIGITS)).alias("epsg"))


def _cell(degrees: Column) -> Column:
    return F.floor(degrees * CELLS_PER_DEGREE).cast("int")


def _line(cell: Column) -> Column:
    """The western or southern border of a cell."""
    return cell / F.lit(float(CELLS_PER_DEGREE))


def _gap(low: Column, high: Column, cell: Column) -> Column:
    """Degrees between a stretch and a (widened) cell; 0 where they meet."""
    return F.greatest(F.lit(0.0), low - (_line(cell + 1) + _BORDER), _line(cell) - _BORDER - high)


def _grid_rows(edges: DataFrame, metres: float) -> DataFrame:
    """Edges once per row of the grid within ``metres``: ``cell_y``, and the
    box ``_w, _e, _s, _n`` of the piece that lies so near to the row."""
    pad = metres / _LAT_METRES + _BORDER
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cell_y", F.explode(F.sequence(_cell(low - pad), _cell(high + pad))))
    rise = F.col("y2") - F.col("y1")

    def at(line: Column) -> Column:
        """How far along the edge it meets a line, within its ends."""
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (line - F.col("y1")) / rise))

    below, above = at(_line(F.col("cell_y")) - pad), at(_line(F.col("cell_y") + 1) + pad)
    rows = rows.withColumn("_a", F.when(rise == 0, 0.0).otherwise(F.least(below, above))).withColumn("_b", F.when(rise == 0, 1.0).otherwise(F.greatest(below, above)))
    xa, xb = (F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1")) for t in ("_a", "_b"))
    ya, yb = (F.col("y1") + F.col(t) * rise for t in ("_a", "_b"))
    return rows.withColumns({"_w": F.least(xa, xb), "_e": F.greatest(xa, xb), "_s": F.least(ya, yb), "_n": F.greatest(ya, yb)}).drop("_a", "_b")


def _near_cells(rows: DataFrame, metres: float) -> DataFrame:
    """Edges once per cell within ``metres`` of them, along each grid row."""
    far = F.least(F.lit(89.0), F.greatest(F.abs("_s"), F.abs("_n")) + metres / _LAT_METRES)
    degree = _LON_METRES * F.cos(F.radians(far))
    pad = metres / degree + _BORDER
    cells = rows.withColumn("_degree", degree).withColumn(
        "cell_x", F.explode(F.sequence(_cell(F.col("_w") - pad), _cell(F.col("_e") + pad))))
    across = _gap(F.col("_w"), F.col("_e"), F.col("cell_x")) * F.col("_degree")
    along = _gap(F.col("_s"), F.col("_n"), F.col("cell_y")) * _LAT_METRES
    return cells.where(across * across + along * along <= metres * metres).drop("_w", "_e", "_s", "_n", "_degree")


def edge_cells(edges: DataFrame, metres: float = 0.0) -> DataFrame:
    """Edges once per cell (``cell_x, cell_y``) that they cross or come within ``metres`` of."""
    return _near_cells(_grid_rows(edges, metres), metres)


def _odd_cells(rows: DataFrame, part: list[str]) -> DataFrame:
    """The cells whose south-eastern corner lies inside a part.

    An edge that crosses a row's lower line flips all cells whose corner lies
    west of the crossing; between two flips all cells are alike.
    """
    line = _line(F.col("cell_y"))
    crossing = rows.where((F.col("y1") > line) != (F.col("y2") > line)).withColumn(
        "_x", F.col("x1") + (line - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    # The last cell whose corner is west of the crossing, by the same comparison as in ``inside``.
    last = F.ceil(F.col("_x") * CELLS_PER_DEGREE).cast("int") - 2
    last = F.when(_line(last + 2) < F.col("_x"), last + 1).when(_line(last + 1) >= F.col("_x"), last - 1).otherwise(last)
    flips = crossing.select(*part, "cell_y", last.alias("_last")).groupBy(*part, "cell_y", "_last").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1)
    # One row of the grid of one part: as many flips as its outline crosses that line in different cells.
    order = Window.partitionBy(*part, "cell_y").orderBy(F.desc("_last"))
    spans = flips.withColumns({"_i": F.row_number().over(order), "_next": F.lead("_last").over(order)})
    spans = spans.where((F.col("_i") % 2 == 1) & F.col("_next").isNotNull())
    return spans.select(*part, "cell_y", F.explode(F.sequence(F.col("_next") + 1, F.col("_last"))).alias("cell_x"))


def part_cells(edges: DataFrame, metres: float, keys: list[str]) -> DataFrame:
    """One row per part and cell that may hold points inside or within
    ``metres`` of it: ``odd`` (whether its corner is inside) and the local
    ``edges``. Needs ``epsg`` on the edges when ``metres`` is positive.
    """
    held = ["x1", "y1", "x2", "y2"]
    part = [*keys, "part"]
    if metres > 0:
        part = [*keys, "epsg", "part"]
        for n in "12":
            edges = with_metric(edges, f"x{n}", f"y{n}", "epsg", f"mx{n}", f"my{n}")
        held += ["mx1", "my1", "mx2", "my2"]
    rows = _grid_rows(edges.select(*part, *held), metres)
    near = _near_cells(rows, metres).select(*part, "cell_x", "cell_y", F.struct(*held).alias("_edge"), F.lit(False).alias("_odd"))
    odd = _odd_cells(rows, part).select(*part, "cell_x", "cell_y", F.lit(None).cast(near.schema["_edge"].dataType).alias("_edge"), F.lit(True).alias("_odd"))
    return near.unionByName(odd).groupBy(*part, "cell_x", "cell_y").agg(F.max("_odd").alias("odd"), F.collect_list("_edge").alias("edges"))


def area_cells(edges: DataFrame, metres: float, key: str = "area") -> DataFrame:
    """One row per area and cell, with what each of its parts has there.

    Any number of parts of an area can lie near a cell; together they are one
    row, so a point meets an area once.
    """
    cells = part_cells(edges, metres, [key])
    group = [key, *(["epsg"] if metres > 0 else []), "cell_x", "cell_y"]
    return cells.groupBy(*group).agg(F.collect_list(F.struct("odd", "edges")).alias("parts"))


def inside(lon: Column, lat: Column, cell_x: Column, cell_y: Column, odd: Column, edges: Column) -> Column:
    """Whether a point of a cell is inside a part.

    The way from the point to the cell's south-eastern corner goes east, then
    south; each edge of the cell that it crosses changes sides. A point on a
    line counts as just above it, the eastern border as just east of itself.
    """
    east, south = _line(cell_x + 1), _line(cell_y)

    def crossings(e: Column) -> Column:
        run, rise = e["x2"] - e["x1"], e["y2"] - e["y1"]
        x = e["x1"] + (lat - e["y1"]) / F.when(rise != 0, rise).otherwise(1.0) * run
        first = ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < x) & (x <= east)
        y = e["y1"] + (east - e["x1"]) / F.when(run != 0, run).otherwise(1.0) * rise

        def below(line: Column) -> Column:
            return (y < line) | ((y == line) & (rise * run <= 0))

        second = ((e["x1"] > east) != (e["x2"] > east)) & below(lat) & ~below(south)
        return first.cast("int") + second.cast("int")

    return F.aggregate(edges, odd.cast("int"), lambda n, e: n + crossings(e)) % 2 == 1


def on_outline(lon: Column, lat: Column, edges: Column) -> Column:
    return F.exists(
        edges,
        lambda e: segment_distance_sq(lon, lat, e["x1"], e["y1"], e["x2"], e["y2"]) == 0,
    )


def near_outline(x: Column, y: Column, edges: Column, metres: float) -> Column:
    """Whether the least distance to an edge is within ``metres`` (metric zone)."""

    def near(e: Column) -> Column:
        x1, y1, dx, dy = e["mx1"], e["my1"], e["mx2"] - e["mx1"], e["my2"] - e["my1"]
        # Bound once for both coordinates: a lambda is not compiled, and each mention is worked out anew.
        along = F.array(segment_place(x, y, x1, y1, e["mx2"], e["my2"]))
        return F.exists(along, lambda t: F.pow(x - (x1 + t * dx), 2) + F.pow(y - (y1 + t * dy), 2) <= metres * metres)

    return F.exists(edges, near)


def within_cells(points: DataFrame, cells: DataFrame, lon: str, lat: str) -> DataFrame:
    """Points in the box around all cells: four numbers, which reach the scan as literals."""
    box = cells.agg(F.min("cell_x"), F.max("cell_x"), F.min("cell_y"), F.max("cell_y")).first()
    if box[0] is None:
        return points.where(F.lit(False))
    west, east, south, north = box[0], box[1] + 1, box[2], box[3] + 1
    return points.where(
        (F.col(lon) >= west / CELLS_PER_DEGREE) & (F.col(lon) <= east / CELLS_PER_DEGREE)
        & (F.col(lat) >= south / CELLS_PER_DEGREE) & (F.col(lat) <= north / CELLS_PER_DEGREE)
    )


def _edges_held() -> Column:
    """How many units of work a cell row stands for."""
    return 1 + F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["edges"]))


def _placed(points: DataFrame, cells: DataFrame, metres: float, lon: str, lat: str) -> tuple[DataFrame, list[str]]:
    """Points once per zone of their cell's areas, with ``_x, _y`` there, and the columns that they share with ``cells``."""
    cell = ["cell_x", "cell_y"]
    at = points.withColumn("cell_x", _cell(F.col(lon))).withColumn("cell_y", _cell(F.col(lat)))
    if metres <= 0:
        return at, cell
    # Hardly any cell has areas of more than two zones: a point is projected once for all areas of each.
    zones = write_stage(cells.select(*cell, "epsg").distinct())
    at = lookup_join(at, zones, cell, how="inner", nulls=False)
    return with_metric(at, lon, lat, "epsg", "_x", "_y"), [*cell, "epsg"]


def candidates(points: DataFrame, cells: DataFrame, metres: float, lon: str, lat: str) -> DataFrame:
    """Point and area rows that share a cell, before the exact test."""
    placed, keys = _placed(within_cells(points, cells, lon, lat), cells, metres, lon, lat)
    return lookup_join(placed, cells, keys, how="inner", weight=_edges_held(), nulls=False)


def _hit(lon: Column, lat: Column, metres: float) -> Column:
    """Inside, or within ``metres`` of, any part of the area of a cell row."""

    def hit(p: Column) -> Column:
        edges = p["edges"]
        held = inside(lon, lat, F.col("cell_x"), F.col("cell_y"), p["odd"], edges)
        # Most hits are near the outline, by its first edge there: that test goes first.
        return (near_outline(F.col("_x"), F.col("_y"), edges, metres) if metres > 0 else on_outline(lon, lat, edges)) | held

    return F.exists("parts", hit)


def points_near(points: DataFrame, cells: DataFrame, metres: float,
                lon: str = "decimalLongitude", lat: str = "decimalLatitude") -> DataFrame:
    """Points inside an area or within ``metres`` of it, once per point row and area.

    ``cells`` is a written ``area_cells`` table. Where it is too large for a
    broadcast, each place (pair of coordinates) is held against the areas once,
    and its areas then meet all of its rows: the exact test does not grow with
    the rows of a place, nor does the shuffle with the outlines.
    """
    hit = _hit(F.col(lon), F.col(lat), metres)
    own = ["cell_x", "cell_y", "parts", "epsg", "_x", "_y"]
    if fits_broadcast(cells, weight=_edges_held()):
        return candidates(points, cells, metres, lon, lat).where(hit).drop(*own)
    # Read for the places and for their rows.
    held = write_stage(within_cells(points, cells, lon, lat))
    places = write_stage(held.groupBy(lon, lat).agg(F.count(F.lit(1)).alias("_n")))
    at, keys = _placed(places, cells, metres, lon, lat)
    found = write_stage(split_join(at, cells, keys, hot_keys(at, keys), "inner", hit, nulls=False).drop(*own))
    # A place is hot by the rows that come out of it.
    hot = hot_keys(found, [lon, lat], weight="_n")
    return split_join(held, found.drop("_n"), [lon, lat], hot, how="inner", nulls=False)


def overfetch(points: DataFrame, cells: DataFrame, metres: float,
              lon: str = "decimalLongitude", lat: str = "decimalLatitude") -> DataFrame:
    """``area, candidates, hits``: how many cell candidates the exact test kept."""
    met = candidates(points, cells, metres, lon, lat)
    hit = _hit(F.col(lon), F.col(lat), metres)
    return met.groupBy("area").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(hit).alias("hits")
    )


def areas_over_regions(area_edges: DataFrame, region_edges: DataFrame) -> DataFrame:
    """``area, kind, label``: regions that an area touches, itself and not its
    buffer.

    Two outlines that share a point meet in a grid cell that both cross; cells
    with many edges of both are split on both sides. Where no outlines meet,
    one vertex of a part decides whether it lies inside the other polygon.
    """
    cell = ["cell_x", "cell_y"]
    # Each is read four times: as edges in cells, for the hot cells, and on either side of the vertex tests.
    area_edges, region_edges = write_stage(area_edges), write_stage(region_edges)

    def placed(edges: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        named = [F.col(c).alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]
        return edge_cells(edges.select(*keys, "x1", "y1", "x2", "y2")).select(*keys, *cell, *named)

    a, r = placed(area_edges, ["area"], "a_"), placed(region_edges, ["kind", "label"], "r_")
    touch = segments_touch(*[F.col(c) for c in ("a_x1", "a_y1", "a_x2", "a_y2", "r_x1", "r_y1", "r_x2", "r_y2")])
    crossing = split_join(a, r, cell, both_hot(hot_keys(a, cell), hot_keys(r, cell), cell), "inner", touch, nulls=False).select("area", "kind", "label")

    def held(points: DataFrame, cells: DataFrame) -> DataFrame:
        at = points.drop("part").withColumn("cell_x", _cell(F.col("vx"))).withColumn("cell_y", _cell(F.col("vy")))
        met = at.join(cells.drop("part"), cell)
        return met.where(inside(F.col("vx"), F.col("vy"), F.col("cell_x"), F.col("cell_y"), F.col("odd"), F.col("edges"))).select("area", "kind", "label")

    within = held(_first_vertices(area_edges, ["area"]), part_cells(region_edges, 0.0, ["kind", "label"]))
    around = held(_first_vertices(region_edges, ["kind", "label"]), part_cells(area_edges, 0.0, ["area"]))
    return crossing.unionByName(within).unionByName(around).distinct()


def region_lists(areas: DataFrame, over: DataFrame) -> DataFrame:
    """``area, area_states, area_biomes``: sorted labels per area (maybe empty)."""
    lists = over.groupBy("area").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "state", F.col("label")))).alias("area_states"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "biome", F.col("label")))).alias("area_biomes"),
    )
    none = F.array().cast("array<string>")
    return areas.select("area").distinct().join(lists, "area", "left").select(
        "area", F.coalesce("area_states", none).alias("area_states"), F.coalesce("area_biomes", none).alias("area_biomes")
    )
