"""Pixels of lines and polygons are put together as masks of whole tiles, no row per pixel is shuffled."""

import math

import numpy as np
from pyspark.sql import functions as F

from reliefspark.operators import vector as V

PLACED = "feature_id long, zoom int, x long, y long, rings array<array<struct<x:double,y:double>>>"
SEGMENTS = "feature_id long, zoom int, x long, y long, ax double, ay double, bx double, by double"


def masks(found):
    out = {}
    for r in found:
        out.setdefault((r.zoom, r.x, r.y), []).append(bytes(r.mask))
    return {k: V.merged_mask(v) for k, v in out.items()}


def test_masks_of_polygons_hold_the_pixels_of_each(spark):
    rng = np.random.default_rng(3)
    zoom, n = 13, 2.0**13
    rows, want = [], {}
    for i in range(400):
        x, y = (4200, 2980) if i % 4 else (4200 + i % 7, 2981)
        rings = []
        for corners in rng.integers(3, 7, rng.integers(1, 3)):
            px, py = rng.uniform(-20, 276, corners), rng.uniform(-20, 276, corners)
            lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + py / 256) / n))))
            rings.append(list(zip(((x + px / 256) / n * 360 - 180).tolist(), lat.tolist())))
        rows.append((i, zoom, x, y, rings))
        lon, lat = (np.array([p[k] for r in rings for p in r]) for k in (0, 1))
        inside = want.setdefault((zoom, x, y), np.zeros((256, 256), bool))
        inside[V.inside_pixels(lon, lat, [len(r) for r in rings], zoom, x, y)] = True
    found = V.fill_masks(spark.createDataFrame(rows, PLACED).repartition(7)).collect()
    got = masks(found)
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    assert len(found) <= 16 * len(want)  # a few masks a tile, not a row per pixel
    counts = {(r.zoom, r.x, r.y): r.n_pixels for r in V.fill_counts(spark.createDataFrame(rows, PLACED)).collect()}
    assert counts == {k: int(v.sum()) for k, v in want.items()}


def test_masks_of_segments_hold_the_pixels_they_cross(spark):
    rng = np.random.default_rng(5)
    zoom, n, x, y = 13, 2.0**13, 4200, 2980
    rows, want = [], np.zeros((256, 256), bool)

    def flat(lon, lat):
        return ((lon + 180) / 360 * n - x) * 256, ((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n - y) * 256

    for i in range(40):
        px, py = rng.uniform(-30, 286, 2), rng.uniform(-30, 286, 2)
        px = px if i % 5 else np.repeat(px[:1], 2)  # some upright
        lon = ((x + px / 256) / n * 360 - 180).tolist()
        lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + py / 256) / n)))).tolist()
        rows.append((i, zoom, x, y, lon[0], lat[0], lon[1], lat[1]))
        (ax, ay), (bx, by) = flat(lon[0], lat[0]), flat(lon[1], lat[1])
        for t in np.linspace(0, 1, 60001):
            r, c = math.floor(ay + t * (by - ay)), math.floor(ax + t * (bx - ax))
            if 0 <= r < 256 and 0 <= c < 256:
                want[r, c] = True
    got = masks(V.line_masks(spark.createDataFrame(rows, SEGMENTS)).collect())[zoom, x, y]
    assert not (want & ~got).any() and (got & ~want).sum() <= 0.01 * want.sum()  # corners that the samples pass by


def test_nothing_to_paint(spark):
    assert V.fill_counts(spark.createDataFrame([], PLACED)).count() == V.line_masks(spark.createDataFrame([], SEGMENTS)).count() == 0
    outside = [(1, 13, 4200, 2980, [[(1.0, 1.0), (1.1, 1.0), (1.1, 1.1)]]), (2, 13, 4200, 2980, [])]
    assert V.fill_masks(spark.createDataFrame(outside, PLACED)).agg(F.count("mask")).first()[0] == 0
