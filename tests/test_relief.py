"""Analytic answers and brute force for the neighbourhood operators."""

import math

import numpy as np
import pytest
from helpers import to_array, to_blocks
from pyspark.sql import functions as F

from reliefspark.functions import shade
from reliefspark.operators import fill, focal
from reliefspark.operators.blocks import blocks_to_cells

SIDE = 16


def codes(blocks, column, shape):
    out = np.zeros(shape, dtype=int)
    for row, col, v in blocks_to_cells(blocks, ["p", "q"], SIDE).select("row", "col", column.alias("v")).collect():
        out[row, col] = v
    return out


@pytest.fixture(scope="module")
def plane():
    z = np.tile(-np.arange(64.0), (64, 1))
    holed = z.copy()
    holed[30:34, 30:34] = np.nan
    return z, holed


def test_tilted_plane_hillshade_and_slope(spark, plane):
    z, holed = plane
    steep = math.atan(1 / 0.5)
    grad = focal.horn_gradient(to_blocks(spark, z), 0.5, side=SIDE)
    light = codes(grad, shade.code_unit(shade.hillshade("p", "q", 90.0, 45.0)), z.shape)
    assert abs(light[32, 32] - int(math.cos(math.radians(45) - steep) * 254 + 1)) <= 1
    slope = codes(grad, shade.slope_code("p", "q"), z.shape)
    assert abs(slope[32, 32] - int(math.degrees(steep) * 254 / 90 + 1)) <= 1
    grad = focal.horn_gradient(to_blocks(spark, holed), 0.5, side=SIDE)
    around = codes(grad, shade.code_unit(shade.hillshade("p", "q", 90.0, 45.0)), z.shape)
    assert (around[30:34, 30:34] == 0).all()
    assert max(abs(around[r, c] - light[10, 10]) for r, c in ((29, 31), (34, 31), (31, 29), (31, 34))) <= 20
    assert around[10, 10] == light[10, 10]


def test_flat_slope_is_one(spark):
    grad = focal.horn_gradient(to_blocks(spark, np.zeros((16, 16))), 0.5, side=SIDE)
    assert (codes(grad, shade.slope_code("p", "q"), (16, 16)) == 1).all()


def test_multidirectional_light_matches_its_definition(spark):
    rng = np.random.default_rng(42)
    z = np.cumsum(rng.normal(0, 0.3, (48, 48)), axis=1)
    grad = focal.horn_gradient(to_blocks(spark, z), 0.5, side=SIDE)
    got = codes(grad, shade.code_unit(shade.hillshade_multi("p", "q", 25.0)), z.shape)
    pad = np.pad(z, 1, mode="edge")
    n = {(i, j): pad[1 + i:49 + i, 1 + j:49 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    p = ((n[-1, 1] + 2 * n[0, 1] + n[1, 1]) - (n[-1, -1] + 2 * n[0, -1] + n[1, -1])) / 4
    q = ((n[1, -1] + 2 * n[1, 0] + n[1, 1]) - (n[-1, -1] + 2 * n[-1, 0] + n[-1, 1])) / 4
    s, aspect = np.arctan(np.hypot(p, q)), np.arctan2(-p, q)
    zen = math.radians(65)
    total = weight = 0
    for a in (225, 270, 315, 360):
        a = math.radians(a)
        w = np.sin(a - aspect) ** 2
        total = total + w * np.maximum(0, math.cos(zen) * np.cos(s) + math.sin(zen) * np.sin(s) * np.cos(a - aspect))
        weight = weight + w
    want = np.floor(np.clip(total / weight, 0, 1) * 254 + 1).astype(int)
    inner = slice(1, -1)
    assert abs(got[inner, inner] - want[inner, inner]).max() <= 1


def test_nodata_forms(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, -9999.0, 50000.0, float("nan"), 0.0])], "i int, z double")

    def known(declared):
        rows = df.select("i", shade.clean_height("z", declared).alias("z")).orderBy("i").collect()
        return [r.z is not None for r in rows]

    assert known(None) == [True, False, False, False, True]
    assert known(0.0) == [True, False, False, False, False]
    assert known(float("nan")) == [True, False, False, False, True]


def mirrored_mean(z, sigma):
    """The definition, cell by cell: the array goes on as its mirror image, unknown cells take no part."""
    k = focal.gaussian_weights(sigma)
    r = len(k) // 2
    known = ~np.isnan(z)
    num, den = (np.pad(a, r, mode="symmetric") for a in (np.where(known, z, 0), known.astype(float)))
    for axis in (0, 1):
        num, den = (np.apply_along_axis(np.convolve, axis, a, k, "valid") for a in (num, den))
    with np.errstate(invalid="ignore"):
        return np.where(known, num / den, np.nan)


@pytest.mark.parametrize("sigma", [3.0, 7.0, 30.0])
def test_gaussian_over_block_borders(spark, sigma):
    """Also with a reach over several blocks and over the whole raster."""
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, (48, 64))
    z[rng.random(z.shape) < 0.2] = np.nan
    got = to_array(focal.gaussian(to_blocks(spark, z), [sigma], side=SIDE), "g0", z.shape)
    assert np.allclose(got, mirrored_mean(z, sigma), equal_nan=True)


def test_a_slope_keeps_level_at_the_mirrored_edge(spark):
    """On a tilted plane, folded half a cell beyond the edge, the mean at the edge is that of a folded normal distribution."""
    z = np.tile(np.arange(64.0), (32, 1))
    mean = to_array(focal.gaussian(to_blocks(spark, z), [4.0], side=SIDE), "g0", z.shape)
    folded = 4.0 * math.sqrt(2 / math.pi) * math.exp(-0.5 * (0.5 / 4.0) ** 2) + 0.5 * math.erf(0.5 / 4.0 / math.sqrt(2))
    assert np.allclose(mean[:, 20:44], z[:, 20:44]) and np.allclose(mean[5, 0], folded - 0.5, atol=0.02)
    assert np.allclose(mean[:, 0], 63 - mean[:, -1])


@pytest.mark.parametrize("sigma", [24.0, 40.0])
def test_reduced_level_keeps_its_bound(spark, sigma):
    """Rough, fully known ground against the exact kernel; the error stays under the bound, the bound is small."""
    rng = np.random.default_rng(4)
    z = rng.normal(0, 1, (128, 192)).cumsum(1) + np.where(np.indices((128, 192))[1] > 90, 50.0, 0.0)
    factor = focal.reduction_factor(sigma, SIDE)
    assert factor in (2, 4) and focal.reduction_error(sigma, factor) < 0.05
    got = focal.gaussian_reduced(to_blocks(spark, z), sigma, squares=True, side=SIDE)
    mean, square = (to_array(got, b, z.shape) for b in ("g0", "s0"))
    for a, source in ((mean, z), (square, z * z)):
        bound = focal.reduction_error(sigma, factor) * np.ptp(source) / 2
        assert np.abs(a - mirrored_mean(source, sigma)).max() <= bound


def test_reduced_level_of_a_broad_scale():
    """The broad band at half a metre: sigma 110 and 200 pixels on blocks of 250, halos within one reduced block."""
    for sigma in (110.0, 200.0):
        factor = focal.reduction_factor(sigma, 250)
        assert factor == 10 and focal.reduction_error(sigma, factor) < 0.04
        assert len(focal.gaussian_weights(focal.reduced_sigma(sigma, factor))) // 2 <= 80 < 250


def test_reduced_level_with_holes(spark):
    z = np.indices((64, 64))[0] * 0.5
    z[20:30, 10:50] = np.nan
    out = focal.gaussian_reduced(to_blocks(spark, z), 24.0, side=SIDE)
    got = to_array(out, "g0", z.shape)
    want = mirrored_mean(z, 24.0)
    assert np.array_equal(np.isnan(got), np.isnan(z)) and np.nanmax(np.abs(got - want)) < 0.2


def test_local_relief_keeps_unknown_cells_and_shows_relief(spark):
    y, x = np.indices((80, 80), dtype=float)
    z = np.where((y > 40) & (x > 40), 3 * np.sin(x / 3) * np.sin(y / 3), 0.0)
    z[0:5, 0:5] = np.nan
    lrm = to_array(focal.local_relief(to_blocks(spark, z), 3.0, side=SIDE), "lrm", z.shape)
    assert np.array_equal(np.isnan(lrm), np.isnan(z))
    assert lrm[50:, 50:].max() > 1 and abs(lrm[20, 20]) < 1e-9


@pytest.mark.parametrize("sampling", ["bilinear", "nearest"])
def test_openness_of_cones(spark, sampling):
    y, x = np.indices((81, 81), dtype=float)
    dist = np.hypot(x - 40, y - 40) * 0.5
    for z, want in ((dist, 0.25), (-dist, 0.75), (np.zeros((81, 81)), 0.5)):
        hor = focal.horizons(to_blocks(spark, z, 27), 0.5, 10, 8, sampling=sampling, side=27)
        for band in ("opos", "oneg"):
            assert abs(to_array(hor, band, z.shape, 27)[40, 40] - want) < (0.03 if sampling == "bilinear" else 0.06)
    flat = to_array(hor, "svf_flux", (81, 81), 27)
    assert np.allclose(flat, 1.0)


def test_sky_view_ignores_unknown_half(spark):
    y, x = np.indices((64, 64), dtype=float)
    z = 2 * np.sin(x / 6) * np.sin(y / 6)
    z[:, :32] = np.nan
    svf = focal.horizons(to_blocks(spark, z), 0.5, 8, 8, side=SIDE)
    cells = blocks_to_cells(svf, ["svf_flux"], SIDE)
    coded = focal.stretch_codes(cells, "svf_flux", 0.02, 0.98, 2.0, digits=4)
    assert coded.filter("col < 32").count() == 0
    assert coded.selectExpr("percentile(code, 0.5) as m").first().m < 250


def test_mirror_gamma_keeps_background_light(spark):
    df = spark.createDataFrame([(0.8,), (0.1,)], "u double")
    light, dark = [r.v for r in df.select(shade.mirror_gamma("u", 2.0).alias("v")).collect()]
    assert light > 0.9 and dark < 0.25
    straight = df.select(shade.gamma("u", 2.0).alias("v")).first().v
    assert straight < light


def test_vat_and_colour_composites(spark):
    df = spark.createDataFrame([(0, 128, 1), (200, 128, 1), (200, 128, 200)], "s int, o int, p int")
    black, bright, steep = [r.v for r in df.select(shade.vat_code("s", "o", "p", 1.0).alias("v")).collect()]
    assert black == 0 and 0 < steep < bright
    e4 = df.select(shade.e4mstp_channel(F.lit(150), F.lit(180), "s", F.lit(140), F.lit(0), F.lit(128), F.lit(128)).alias("v"))
    assert [r.v > 0 for r in e4.collect()] == [False, True, True]


def test_fill_reaches_over_blocks_and_stops(spark):
    z = np.full((64, 64), np.nan)
    z[:, 0] = 10.0
    got = to_array(fill.fill_holes(to_blocks(spark, z), "z", 40, SIDE), "z", z.shape)
    assert np.allclose(got[:, :41], 10.0) and np.isnan(got[:, 41:]).all()


def test_fill_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(100, 5, (40, 40))
    z[rng.random(z.shape) < 0.9] = np.nan
    reach = 9
    got = to_array(fill.fill_holes(to_blocks(spark, z, 8), "z", reach, 8), "z", z.shape, 8)
    want = z.copy()
    for r, c in zip(*np.nonzero(np.isnan(z))):
        num = den = 0.0
        for dr, dc in ((0, -1), (0, 1), (-1, 0), (1, 0)):
            for d in range(1, reach + 1):
                i, j = r + dr * d, c + dc * d
                if not (0 <= i < 40 and 0 <= j < 40):
                    break
                if not np.isnan(z[i, j]):
                    num, den = num + z[i, j] / d, den + 1 / d
                    break
        want[r, c] = num / den if den else np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 1, 5000), 3)
    df = spark.createDataFrame([("r", i, 0, float(x)) for i, x in enumerate(v)], "raster_id string, row long, col long, v double")
    b = focal.percentile_bounds(df, "v", 0.05, 0.95).first()
    assert np.allclose([b.p_low, b.p_high], np.percentile(v, [5, 95]))


def test_exact_percentiles_of_many_numbers(spark):
    """More different numbers than buckets, several groups, ties, one row, and a group without spread."""
    from reliefspark.operators import quality

    rng = np.random.default_rng(3)
    groups = {0: rng.integers(0, 10**9, 4000), 1: rng.integers(-500, 500, 3000), 2: np.array([7]), 3: np.array([5] * 10), 4: np.array([1, 10**12])}
    rows = [(g, int(v)) for g, values in groups.items() for v in values]
    counts = spark.createDataFrame(rows, "g int, step long").groupBy("g", "step").agg(F.count("*").alias("n")).cache()
    shares = {"low": 0.02, "mid": 0.5, "high": 0.95, "last": 1.0}
    got = {r.g: r for r in quality.exact_percentiles(counts, shares, "g", buckets=16).collect()}
    for g, values in groups.items():
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12), (g, name)


def test_raster_difference_with_six_digits(spark):
    from reliefspark.operators import quality

    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 3000), rng.normal(0, 1, 3000)
    df = spark.createDataFrame([("r", i, 0, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "raster_id string, row long, col long, a double, b double")
    got = quality.raster_difference(df.withColumnRenamed("a", "z"), df.withColumnRenamed("b", "z"), "z", digits=6).first()
    steps = np.floor(np.abs(a - b) * 1e6 + 0.5)
    assert got.n_cells == 3000 and got.p95_abs == pytest.approx(np.percentile(steps, 95) / 1e6, abs=1e-9) and got.mean_abs == pytest.approx(steps.mean() / 1e6)
