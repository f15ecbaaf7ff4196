"""Values on a step do not depend on how their positions were approximated."""

import math

import numpy as np
from pyspark.sql import functions as F

from helpers import to_blocks
from reliefspark.functions.arrays import LambertToPixels
from reliefspark.operators import warp


def test_a_plateau_as_high_as_a_step(spark):
    mapping = LambertToPixels(900000.0, 6250000.0, 2.0, 18)
    top, left = (int(v[0]) // 64 for v in mapping.to_target(np.array([20.0]), np.array([20.0])))
    blocks = to_blocks(spark, np.full((40, 40), 100.2), 10)
    out = warp.warp_blocks(blocks, "z", mapping, 10, 64, steps=10.0).filter((F.col("brow") == top) & (F.col("bcol") == left)).first()
    got = np.array(out.z).reshape(64, 64)
    for r in range(0, 64, 3):
        for c in range(64):
            fr, fc = (p - math.floor(p) for p in mapping.to_source_one(top * 64 + r, left * 64 + c))
            weights = [(1 - fr) * (1 - fc), (1 - fr) * fc, fr * (1 - fc), fr * fc]
            total = weight = 0.0
            for w in weights:
                total, weight = total + w * 100.2, weight + w
            assert got[r, c] == total / weight


def test_one_position_is_that_of_the_arrays():
    mapping = LambertToPixels(900000.0, 6250000.0, 2.0, 18)
    row, col = mapping.to_target(np.array([20.0]), np.array([20.0]))
    many, one = mapping.to_source(row, col), mapping.to_source_one(row[0], col[0])
    assert np.allclose([m[0] for m in many], one, atol=1e-6)


def test_a_pixel_a_hair_within_the_rim_is_known(spark):
    base = LambertToPixels(900000.0, 6250000.0, 2.0, 18)
    row, col = (int(v[0]) for v in base.to_target(np.array([20.0]), np.array([20.0])))
    x = 900000.0 + (base.to_source_one(row, col)[1] + 0.5) * 2.0
    blocks = to_blocks(spark, np.arange(40.0)[:, None] + np.zeros((40, 40)), 10)
    # a hair behind the cell before the first and before the one after the last: the known cell beside it has a say
    for place, there in ((-1 + 4e-9, True), (40 - 4e-9, True), (-1 - 4e-9, False), (40 + 4e-9, False)):
        mapping = LambertToPixels(x - (place + 0.5) * 2.0, 6250000.0, 2.0, 18)
        at_row, at_col = mapping.to_source_one(row, col)
        assert 1e-9 < abs(at_col - round(place)) < 1e-8 and (-1 < at_col < 40) == there
        out = warp.warp_blocks(blocks, "z", mapping, 10, 64).filter((F.col("brow") == row // 64) & (F.col("bcol") == col // 64)).first()
        got = out.z[row % 64 * 64 + col % 64]
        assert (got is not None) == there and (not there or abs(got - at_row) < 1e-9)
