"""The projections of ``geo`` on numpy arrays, for kernels that work on whole blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefspark.functions.geo import (
    _GRS80_E, EARTH_RADIUS, GRS80_F, LAMBERT93_C, LAMBERT93_LON0, LAMBERT93_N, LAMBERT93_XS, LAMBERT93_YS, MERCATOR_HALF)


def mercator(lon, lat):
    return np.radians(lon) * EARTH_RADIUS, np.arcsinh(np.tan(np.radians(lat))) * EARTH_RADIUS


def from_mercator(x, y):
    return np.degrees(x / EARTH_RADIUS), np.degrees(np.arctan(np.sinh(y / EARTH_RADIUS)))


def lambert93(lon, lat):
    phi, e = np.radians(lat), _GRS80_E
    iso = np.log(np.tan(math.pi / 4 + phi / 2)) - e / 2 * np.log((1 + e * np.sin(phi)) / (1 - e * np.sin(phi)))
    radius, gamma = LAMBERT93_C * np.exp(-LAMBERT93_N * iso), LAMBERT93_N * np.radians(lon - LAMBERT93_LON0)
    return LAMBERT93_XS + radius * np.sin(gamma), LAMBERT93_YS - radius * np.cos(gamma)


def from_lambert93(x, y):
    dx, dy = x - LAMBERT93_XS, LAMBERT93_YS - y
    chi = 2 * np.arctan(np.exp(np.log(LAMBERT93_C / np.hypot(dx, dy)) / LAMBERT93_N)) - math.pi / 2
    e2 = GRS80_F * (2 - GRS80_F)
    phi = (
        chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * np.sin(2 * chi)
        + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * np.sin(4 * chi)
        + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * np.sin(6 * chi) + 4279 * e2**4 / 161280 * np.sin(8 * chi))
    return LAMBERT93_LON0 + np.degrees(np.arctan2(dx, dy)) / LAMBERT93_N, np.degrees(phi)


def transform_envelope(box: Column, transform, samples: int = 21) -> Column:
    """``geo.bbox_transform_envelope`` for a transform of arrays: all points of a batch of boxes at once.

    As a column expression the points are worked out once for every one of the four sides, value by value.
    """
    t = np.arange(samples + 1) / samples

    def run(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        left, low, right, high = (v.to_numpy(dtype=float)[:, None] for v in (x0, y0, x1, y1))
        across, up, still = left + (right - left) * t, low + (high - low) * t, np.zeros(samples + 1)
        x, y = transform(np.hstack([across, across, left + still, right + still]), np.hstack([low + still, high + still, up, up]))
        return pd.DataFrame({"x0": x.min(axis=1), "y0": y.min(axis=1), "x1": x.max(axis=1), "y1": y.max(axis=1)})

    return F.pandas_udf(run, "x0 double, y0 double, x1 double, y1 double")(box.x0, box.y0, box.x1, box.y1)


class LambertToPixels:
    """Cells of a Lambert-93 grid <-> global Web Mercator pixels of one zoom (centres at whole numbers)."""

    def __init__(self, left: float, top: float, res: float, zoom: int):
        self.left, self.top, self.res = left, top, res
        self.pixel = 2 * MERCATOR_HALF / 2**zoom / 256

    def to_target(self, row, col):
        x, y = mercator(*from_lambert93((col + 0.5) * self.res + self.left, self.top - (row + 0.5) * self.res))
        return (MERCATOR_HALF - y) / self.pixel - 0.5, (x + MERCATOR_HALF) / self.pixel - 0.5

    def to_source(self, row, col):
        x, y = lambert93(*from_mercator((col + 0.5) * self.pixel - MERCATOR_HALF, MERCATOR_HALF - (row + 0.5) * self.pixel))
        return (self.top - y) / self.res - 0.5, (x - self.left) / self.res - 0.5

    def to_source_one(self, row: int, col: int) -> tuple[float, float]:
        """``to_source`` of one cell, by the functions of the C library: the same bits wherever these are used."""
        lon = math.degrees(((col + 0.5) * self.pixel - MERCATOR_HALF) / EARTH_RADIUS)
        phi, e = math.radians(math.degrees(math.atan(math.sinh((MERCATOR_HALF - (row + 0.5) * self.pixel) / EARTH_RADIUS)))), _GRS80_E
        iso = math.log(math.tan(math.pi / 4 + phi / 2)) - e / 2 * math.log((1 + e * math.sin(phi)) / (1 - e * math.sin(phi)))
        radius, gamma = LAMBERT93_C * math.exp(-LAMBERT93_N * iso), LAMBERT93_N * math.radians(lon - LAMBERT93_LON0)
        x, y = LAMBERT93_XS + radius * math.sin(gamma), LAMBERT93_YS - radius * math.cos(gamma)
        return (self.top - y) / self.res - 0.5, (x - self.left) / self.res - 0.5
