"""Metric map projections and planar geometry as column arithmetic (GRS80)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS80 ellipsoid and the constants of the two projections.
A = 6378137.0
FLATTENING = 1 / 298.257222101
E2 = FLATTENING * (2 - FLATTENING)
K0 = 0.9996
_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
KRUGER = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
POLYCONIC_EPSG = 5880
POLYCONIC_LON0 = -54.0
_M = (
    1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256,
    3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024,
    15 * E2**2 / 256 + 45 * E2**3 / 1024,
    35 * E2**3 / 3072,
)


def metric_epsg(lon: Column, lat: Column) -> Column:
    """Zone code of a centroid: national UTM zones, else the polyconic one."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return (
        F.when((lat >= 0) & zone.between(18, 22), zone + 31954)
        .when((lat < 0) & zone.between(17, 25), zone + 31960)
        .otherwise(POLYCONIC_EPSG)
    )


def central_meridian(epsg: Column) -> Column:
    """Central meridian of a zone code, null for the polyconic one."""
    return F.when(epsg.between(31972, 31976), (epsg - 31954) * 6 - 183).when(
        epsg.between(31977, 31985), (epsg - 31960) * 6 - 183
    ).cast("double")


def _angles(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude from the zone's central meridian, in radians."""
    return F.radians(lat), F.radians(lon - F.coalesce(central_meridian(epsg), F.lit(POLYCONIC_LON0)))


def _conformal(phi: Column) -> Column:
    """Tangent of the conformal latitude."""
    e, sin_phi = math.sqrt(E2), F.sin(phi)
    return F.sinh(F.atanh(sin_phi) - e * F.atanh(e * sin_phi))


def _sphere(lam: Column, t: Column) -> tuple[Column, Column]:
    """``xi, eta``: transverse coordinates on the sphere."""
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))


def _planar(lat: Column, epsg: Column, phi: Column, lam: Column, xi: Column, eta: Column) -> tuple[Column, Column]:
    # Transverse Mercator, Kruger series.
    x, y = eta, xi
    for j, a in enumerate(KRUGER, start=1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 31977, 10_000_000.0).otherwise(0.0)
    tm_x = 500_000 + K0 * RECTIFYING * x
    tm_y = south + K0 * RECTIFYING * y

    # American polyconic, ellipsoidal.
    sin_phi = F.sin(phi)
    m = A * (
        _M[0] * phi - _M[1] * F.sin(2 * phi) + _M[2] * F.sin(4 * phi) - _M[3] * F.sin(6 * phi)
    )
    nu_cot = A / F.sqrt(1 - E2 * sin_phi * sin_phi) * F.cos(phi) / sin_phi
    angle = lam * sin_phi
    pc_x = 5_000_000 + F.when(lat == 0, A * lam).otherwise(nu_cot * F.sin(angle))
    pc_y = 10_000_000 + F.when(lat == 0, 0.0).otherwise(m + nu_cot * (1 - F.cos(angle)))

    national = central_meridian(epsg).isNotNull()
    return F.when(national, tm_x).otherwise(pc_x), F.when(national, tm_y).otherwise(pc_y)


def project(lon: Column, lat: Column, epsg: Column) -> Column:
    """Metric coordinates of a point in a zone, as ``struct(x, y)``."""
    phi, lam = _angles(lon, lat, epsg)
    x, y = _planar(lat, epsg, phi, lam, *_sphere(lam, _conformal(phi)))
    return F.struct(x.alias("x"), y.alias("y"))


def with_metric(df: DataFrame, lon: str, lat: str, epsg: str, x: str, y: str) -> DataFrame:
    """``df`` with the metric coordinates of a point in its zone as columns ``x`` and ``y``.

    The same as ``project``, in steps: one expression would work out each inner
    angle again wherever the series reads it, some thirty times a point.
    """
    phi, lam = _angles(F.col(lon), F.col(lat), F.col(epsg))
    steps = df.withColumns({"_phi": phi, "_lam": lam}).withColumn("_t", _conformal(F.col("_phi")))
    xi, eta = _sphere(F.col("_lam"), F.col("_t"))
    steps = steps.withColumns({"_xi": xi, "_eta": eta})
    px, py = _planar(F.col(lat), F.col(epsg), *[F.col(c) for c in ("_phi", "_lam", "_xi", "_eta")])
    return steps.withColumns({x: px, y: py}).drop("_phi", "_lam", "_t", "_xi", "_eta")


def segment_place(px, py, x1, y1, x2, y2) -> Column:
    """How far along a segment (0 to 1) its place nearest to a point is."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / F.when(length > 0, length).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))


def segment_distance_sq(px, py, x1, y1, x2, y2) -> Column:
    """Squared distance from a point to a segment; a segment may be a point."""
    t = segment_place(px, py, x1, y1, x2, y2)
    ex, ey = px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))
    return ex * ex + ey * ey


def crosses_ray(px, py, x1, y1, x2, y2) -> Column:
    """Whether the eastward ray from a point crosses an edge."""
    return ((y1 > py) != (y2 > py)) & (
        px < x1 + (py - y1) / F.when(y2 != y1, y2 - y1).otherwise(1.0) * (x2 - x1)
    )


def segments_touch(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the closed segments ab and cd share a point."""

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    boxes = (
        (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx))
        & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    )
    return (
        boxes
        & (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0)
        & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0)
    )
