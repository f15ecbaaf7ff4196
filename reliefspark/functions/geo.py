"""Coordinate and tile-address expressions (Column in, Column out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published constants of the projections.
EARTH_RADIUS = 6378137.0
MERCATOR_HALF = 20037508.342789244
EQUATOR_RESOLUTION = 156543.033928
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
WGS84_F = 1 / 298.257223563
LAMBERT93_N = 0.7256077650532670
LAMBERT93_C = 11754255.426096
LAMBERT93_XS = 700000.0
LAMBERT93_YS = 12655612.049876
LAMBERT93_LON0 = 3.0
GRID_LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"

_GRS80_E = math.sqrt(GRS80_F * (2 - GRS80_F))


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def floor_long(value) -> Column:
    return F.floor(_c(value)).cast("bigint")


def pow2(zoom) -> Column:
    """2^zoom as BIGINT."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _c(zoom).cast("int"))


# -- Web Mercator and tile addresses -------------------------------------------------------------

def mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * F.lit(EARTH_RADIUS)


def mercator_y(lat) -> Column:
    return F.asinh(F.tan(F.radians(_c(lat)))) * F.lit(EARTH_RADIUS)


def mercator_lon(x) -> Column:
    return F.degrees(_c(x) / F.lit(EARTH_RADIUS))


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.sinh(_c(y) / F.lit(EARTH_RADIUS))))


def _clamp_tile(index: Column, zoom) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(index, pow2(zoom) - 1))


def tile_x(lon, zoom) -> Column:
    """Tile column of a longitude, clamped to the last column."""
    return _clamp_tile(floor_long((_c(lon) + F.lit(180.0)) / F.lit(360.0) * pow2(zoom).cast("double")), zoom)


def tile_y(lat, zoom) -> Column:
    """Tile row (counted from the north) of a latitude, clamped to the grid."""
    share = (F.lit(1.0) - F.asinh(F.tan(F.radians(_c(lat)))) / F.pi()) / F.lit(2.0)
    return _clamp_tile(floor_long(share * pow2(zoom).cast("double")), zoom)


def tile_lon(x, zoom) -> Column:
    """Longitude of the west edge of tile column ``x``."""
    return _c(x).cast("double") / pow2(zoom).cast("double") * F.lit(360.0) - F.lit(180.0)


def tile_lat(y, zoom) -> Column:
    """Latitude of the north edge of tile row ``y``."""
    share = F.lit(1.0) - F.lit(2.0) * _c(y).cast("double") / pow2(zoom).cast("double")
    return F.degrees(F.atan(F.sinh(F.pi() * share)))


def tile_mercator_bounds(x, y, zoom) -> Column:
    """Web Mercator bounds of a tile as a bbox struct."""
    step = F.lit(2 * MERCATOR_HALF) / pow2(zoom).cast("double")
    left = _c(x).cast("double") * step - F.lit(MERCATOR_HALF)
    top = F.lit(MERCATOR_HALF) - _c(y).cast("double") * step
    return bbox(left, top - step, left + step, top)


def flip_row(y, zoom) -> Column:
    """Row counted from the south <-> row counted from the north."""
    return pow2(zoom) - 1 - _c(y)


def ground_resolution(lat, zoom) -> Column:
    return F.lit(EQUATOR_RESOLUTION) * F.cos(F.radians(_c(lat))) / pow2(zoom).cast("double")


def native_zoom(resolution_m, lat) -> Column:
    """Smallest zoom at least as fine as the source, kept within 1..22."""
    per_pixel = F.lit(EQUATOR_RESOLUTION) * F.cos(F.radians(F.abs(_c(lat))))
    return F.greatest(F.lit(1), F.least(F.lit(22), F.ceil(F.log2(per_pixel / _c(resolution_m))).cast("int")))


# -- Boxes ----------------------------------------------------------------------------------------

def bbox(x0, y0, x1, y1) -> Column:
    return F.struct(
        _c(x0).cast("double").alias("x0"), _c(y0).cast("double").alias("y0"),
        _c(x1).cast("double").alias("x1"), _c(y1).cast("double").alias("y1"),
    )


def bbox_lit(box) -> Column:
    return bbox(*(F.lit(float(v)) for v in box))


def bbox_touches(a: Column, b: Column) -> Column:
    """Boxes meet, edges included."""
    return (a.x1 >= b.x0) & (a.x0 <= b.x1) & (a.y1 >= b.y0) & (a.y0 <= b.y1)


def bbox_overlaps(a: Column, b: Column) -> Column:
    """Boxes share an area; common edges do not count."""
    return (a.x1 > b.x0) & (a.x0 < b.x1) & (a.y1 > b.y0) & (a.y0 < b.y1)


def bbox_covers(outer: Column, inner: Column) -> Column:
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def bbox_clip(a: Column, b: Column) -> Column:
    return bbox(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def bbox_normalised(a: Column) -> Column:
    return bbox(F.least(a.x0, a.x1), F.least(a.y0, a.y1), F.greatest(a.x0, a.x1), F.greatest(a.y0, a.y1))


def bbox_snap_out(a: Column, res) -> Column:
    """Bounds moved outward onto the resolution grid; the far edge always gains one step."""
    res = _c(res).cast("double")
    return bbox(
        F.floor(a.x0 / res) * res, F.floor(a.y0 / res) * res,
        (F.floor(a.x1 / res) + 1) * res, (F.floor(a.y1 / res) + 1) * res,
    )


# -- National grids -------------------------------------------------------------------------------

def british_grid_ref(east, north, size_km: int) -> Column:
    """Letter reference of the 1, 5 or 10 km square that holds a British National Grid point."""
    if size_km not in (1, 5, 10):
        raise ValueError(f"no British grid reference at {size_km} km")
    e, n = _c(east).cast("bigint"), _c(north).cast("bigint")
    hundred_e = F.floor(e / F.lit(100000)).cast("int")
    from_north = F.lit(19) - F.floor(n / F.lit(100000)).cast("int")
    major = from_north - F.pmod(from_north, F.lit(5)) + F.floor((hundred_e + 10) / F.lit(5)).cast("int")
    minor = F.pmod(from_north, F.lit(5)) * 5 + F.pmod(hundred_e + 10, F.lit(5))
    letters = F.lit(GRID_LETTERS)
    square = F.concat(F.substring(letters, major + 1, F.lit(1)), F.substring(letters, minor + 1, F.lit(1)))
    e_km = F.floor(F.pmod(e, F.lit(100000)) / F.lit(1000)).cast("int")
    n_km = F.floor(F.pmod(n, F.lit(100000)) / F.lit(1000)).cast("int")
    if size_km == 1:
        return F.concat(square, F.lpad(e_km.cast("string"), 2, "0"), F.lpad(n_km.cast("string"), 2, "0"))
    tens = F.concat(
        square, F.floor(e_km / F.lit(10)).cast("string"), F.floor(n_km / F.lit(10)).cast("string"))
    if size_km == 10:
        return tens
    return F.concat(
        tens,
        F.when(F.pmod(n_km, F.lit(10)) >= 5, "N").otherwise("S"),
        F.when(F.pmod(e_km, F.lit(10)) >= 5, "E").otherwise("W"),
    )


def estonian_sheet(x_sw, y_sw) -> Column:
    """Number of the 5 km map sheet whose south-west corner is given in metres."""
    x, y = _c(x_sw).cast("bigint"), _c(y_sw).cast("bigint")

    def part(value, modulo, unit, shift=0):
        return (F.floor(F.pmod(value, F.lit(modulo)) / F.lit(unit)).cast("bigint") - shift).cast("string")

    quarter = (
        F.lit(1)
        + F.when(F.pmod(x, F.lit(10000)) >= 5000, 1).otherwise(0)
        + F.when(F.pmod(y, F.lit(10000)) >= 5000, 2).otherwise(0)
    )
    return F.concat(
        part(y, 10**9, 100000, 59), part(x, 10**9, 100000, 2),
        part(y, 100000, 10000), part(x, 100000, 10000), quarter.cast("string"),
    )


def polish_zone_epsg(lon) -> Column:
    """EPSG code of the 3-degree zone nearest to a longitude (ties go to the even zone number)."""
    zone = F.greatest(F.lit(5), F.least(F.lit(8), F.bround(_c(lon) / F.lit(3.0), 0).cast("int")))
    return F.lit(2171) + zone


def utm_epsg(lon, lat) -> Column:
    zone = F.floor((_c(lon) + 180.0) / 6.0).cast("int") + 1
    return F.when(_c(lat) >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def corner_key(lon, lat) -> Column:
    """Positive integer key (x, y) of a geographic south-west corner.

    A positive longitude on this (western) continent means the axes came swapped.
    """
    lon, lat = _c(lon), _c(lat)
    true_lon = F.when(lon > 0, lat).otherwise(lon)
    true_lat = F.when(lon > 0, lon).otherwise(lat)
    return F.struct(
        F.bround((true_lon + 180.0) * 10000.0, 0).cast("bigint").alias("x"),
        F.bround(true_lat * 10000.0, 0).cast("bigint").alias("y"),
    )


# -- Projections ----------------------------------------------------------------------------------

def lambert93_from_lonlat(lon, lat) -> Column:
    """Lambert-93 (x, y) of a geographic position."""
    phi = F.radians(_c(lat))
    e = F.lit(_GRS80_E)
    iso = (F.log(F.tan(F.lit(math.pi / 4) + phi / 2.0))
           - e / 2.0 * F.log((F.lit(1.0) + e * F.sin(phi)) / (F.lit(1.0) - e * F.sin(phi))))
    radius = F.lit(LAMBERT93_C) * F.exp(-F.lit(LAMBERT93_N) * iso)
    gamma = F.lit(LAMBERT93_N) * F.radians(_c(lon) - F.lit(LAMBERT93_LON0))
    return F.struct(
        (F.lit(LAMBERT93_XS) + radius * F.sin(gamma)).alias("x"),
        (F.lit(LAMBERT93_YS) - radius * F.cos(gamma)).alias("y"),
    )


def lonlat_from_lambert93(x, y) -> Column:
    """Geographic position (lon, lat) of a Lambert-93 point; series in the eccentricity, < 1e-9 deg."""
    dx = _c(x) - F.lit(LAMBERT93_XS)
    dy = F.lit(LAMBERT93_YS) - _c(y)
    radius = F.sqrt(dx * dx + dy * dy)
    iso = F.log(F.lit(LAMBERT93_C) / radius) / F.lit(LAMBERT93_N)
    e2 = GRS80_F * (2 - GRS80_F)
    e4, e6, e8 = e2**2, e2**3, e2**4
    chi = F.lit(2.0) * F.atan(F.exp(iso)) - F.lit(math.pi / 2)
    phi = (
        chi
        + F.lit(e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(chi * 2.0)
        + F.lit(7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(chi * 4.0)
        + F.lit(7 * e6 / 120 + 81 * e8 / 1120) * F.sin(chi * 6.0)
        + F.lit(4279 * e8 / 161280) * F.sin(chi * 8.0)
    )
    lon = F.lit(LAMBERT93_LON0) + F.degrees(F.atan2(dx, dy)) / F.lit(LAMBERT93_N)
    return F.struct(lon.alias("lon"), F.degrees(phi).alias("lat"))


def _krueger(flattening: float):
    n = flattening / (2 - flattening)
    radius = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
             61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
             56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return n, radius, alpha, beta, delta


def transverse_mercator_from_lonlat(lon, lat, lon0, scale=0.9996, false_east=500000.0, false_north=0.0,
                                    flattening=WGS84_F) -> Column:
    """Transverse Mercator (x, y), Krueger series to fourth order (UTM with the default values)."""
    n, radius, alpha, _, _ = _krueger(flattening)
    k = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(_c(lat))
    lam = F.radians(_c(lon) - _c(lon0))
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - F.lit(k) * F.atanh(F.lit(k) * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + F.lit(a) * F.cos(xi * F.lit(2.0 * j)) * F.sinh(eta * F.lit(2.0 * j))
        north = north + F.lit(a) * F.sin(xi * F.lit(2.0 * j)) * F.cosh(eta * F.lit(2.0 * j))
    factor = F.lit(scale * radius)
    return F.struct((F.lit(false_east) + factor * east).alias("x"), (F.lit(false_north) + factor * north).alias("y"))


def lonlat_from_transverse_mercator(x, y, lon0, scale=0.9996, false_east=500000.0, false_north=0.0,
                                    flattening=WGS84_F) -> Column:
    _, radius, _, beta, delta = _krueger(flattening)
    xi = (_c(y) - F.lit(false_north)) / F.lit(scale * radius)
    eta = (_c(x) - F.lit(false_east)) / F.lit(scale * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - F.lit(b) * F.sin(xi * F.lit(2.0 * j)) * F.cosh(eta * F.lit(2.0 * j))
        eta1 = eta1 - F.lit(b) * F.cos(xi * F.lit(2.0 * j)) * F.sinh(eta * F.lit(2.0 * j))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + F.lit(d) * F.sin(chi * F.lit(2.0 * j))
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct((_c(lon0) + F.degrees(lam)).alias("lon"), F.degrees(phi).alias("lat"))


def bbox_transform_envelope(box: Column, transform, fields=("x", "y"), samples: int = 21) -> Column:
    """Envelope of a bbox after a point transform, sampled along its four edges.

    ``transform(x, y)`` returns a struct with the two ``fields``.  A straight edge becomes a curve, so
    corners alone would miss the extreme values.
    """
    steps = F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: i.cast("double") / F.lit(float(samples)))
    edges = F.flatten(F.transform(steps, lambda t: F.array(
        F.struct((box.x0 + (box.x1 - box.x0) * t).alias("x"), box.y0.alias("y")),
        F.struct((box.x0 + (box.x1 - box.x0) * t).alias("x"), box.y1.alias("y")),
        F.struct(box.x0.alias("x"), (box.y0 + (box.y1 - box.y0) * t).alias("y")),
        F.struct(box.x1.alias("x"), (box.y0 + (box.y1 - box.y0) * t).alias("y")),
    )))
    moved = F.transform(edges, lambda p: transform(p.x, p.y))
    first = F.transform(moved, lambda p: p[fields[0]])
    second = F.transform(moved, lambda p: p[fields[1]])
    return bbox(F.array_min(first), F.array_min(second), F.array_max(first), F.array_max(second))
