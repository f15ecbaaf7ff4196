"""Neighbourhood rasters on blocks: gradient, smoothing, horizons, and the layers built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.functions import shade
from reliefspark.functions.geo import _c
from reliefspark.operators.blocks import BLOCK, exchange, with_halo
from reliefspark.operators.blocks import _nested as nested
from reliefspark.operators.blocks import _unnest as unnest

SMOOTH_CUT = 4.0


# -- gradient -------------------------------------------------------------------------------------

def horn_gradient(blocks: DataFrame, res: float, band: str = "z", side: int = BLOCK) -> DataFrame:
    """Bands ``p`` (to the east) and ``q`` (to the south); an unknown neighbour counts as the centre."""
    return with_halo(blocks, [band], lambda z: _horn(z, res), {"p": "double", "q": "double"}, (1, 1), side)


def _horn(z: np.ndarray, res: float) -> dict[str, np.ndarray]:
    """Gradient of an array that is one cell wider on every side."""
    centre = z[1:-1, 1:-1]

    def near(dr, dc):
        value = z[1 + dr:z.shape[0] - 1 + dr, 1 + dc:z.shape[1] - 1 + dc]
        return np.where(np.isnan(value), centre, value)

    a, b, c = near(-1, -1), near(-1, 0), near(-1, 1)
    d, f = near(0, -1), near(0, 1)
    g, h, i = near(1, -1), near(1, 0), near(1, 1)
    return {
        "p": (((c + 2.0 * f) + i) - ((a + 2.0 * d) + g)) / (8.0 * res),
        "q": (((g + 2.0 * h) + i) - ((a + 2.0 * b) + c)) / (8.0 * res),
    }


def shade_columns(requests: dict[str, dict], altitude: float = 25.0) -> list[Column]:
    """Code columns for several shadings from one gradient: name -> {type, azimuth, altitude, z_factor}."""
    columns = []
    for name, request in requests.items():
        kind, settings = request["type"], {k: v for k, v in request.items() if k != "type"}
        if kind == "slope":
            columns.append(shade.slope_code("p", "q").alias(name))
        elif kind == "multi":
            settings.setdefault("altitude", altitude)
            columns.append(shade.code_unit(shade.hillshade_multi("p", "q", **settings)).alias(name))
        else:
            settings.setdefault("altitude", altitude)
            settings.setdefault("azimuth", float(kind))
            columns.append(shade.code_unit(shade.hillshade("p", "q", **settings)).alias(name))
    return columns


# -- smoothing ------------------------------------------------------------------------------------

def gaussian_weights(sigma: float) -> np.ndarray:
    radius = int(SMOOTH_CUT * sigma + 0.5)
    steps = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (steps / sigma) ** 2)
    return weights / weights.sum()


def _smooth_rows(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """1-D convolution along rows without padding, accumulated in kernel order."""
    out = np.zeros((z.shape[0], z.shape[1] - len(weights) + 1))
    for i, w in enumerate(weights):
        out += w * z[:, i:i + out.shape[1]]
    return out


def gaussian(blocks: DataFrame, sigmas: Sequence[float], band: str = "z", squares: bool = False,
             side: int = BLOCK) -> DataFrame:
    """Gaussian means of ``band`` for several sigmas (pixels): bands ``z, g0, g1...`` (``s0...`` of z^2).

    Beyond its outermost blocks the raster goes on as its mirror image.  Unknown cells take no part: the mean is over
    known cells, weights renormalised.  Two passes with a one-sided halo each keep the exchanged margin small.
    """
    kernels = [gaussian_weights(s) for s in sigmas]
    reach = max(len(k) // 2 for k in kernels)
    count = len(kernels)
    names = [f"g{i}" for i in range(count)] + ([f"s{i}" for i in range(count)] if squares else [])

    def rows_pass(z):
        known = ~np.isnan(z)
        filled = np.where(known, z, 0.0)
        result = {"z": z[:, reach:z.shape[1] - reach]}
        for i, kernel in enumerate(kernels):
            cut = reach - len(kernel) // 2
            window = slice(cut, z.shape[1] - cut)
            result[f"v{i}"] = _smooth_rows(filled[:, window], kernel)
            result[f"w{i}"] = _smooth_rows(known[:, window].astype(float), kernel)
            if squares:
                result[f"q{i}"] = _smooth_rows((filled * filled)[:, window], kernel)
        return result

    parts = [f"{p}{i}" for i in range(count) for p in (("v", "w", "q") if squares else ("v", "w"))]

    def columns_pass(z, *layers):
        # a block that does not exist holds no weight
        layer = dict(zip(parts, (np.nan_to_num(a) for a in layers)))
        centre = z[reach:z.shape[0] - reach]
        result = {"z": centre}
        for i, kernel in enumerate(kernels):
            cut = reach - len(kernel) // 2
            window = slice(cut, z.shape[0] - cut)
            weight = _smooth_rows(layer[f"w{i}"][window].T, kernel).T
            for source, target in (("v", "g"), ("q", "s")) if squares else (("v", "g"),):
                total = _smooth_rows(layer[f"{source}{i}"][window].T, kernel).T
                with np.errstate(invalid="ignore", divide="ignore"):
                    result[f"{target}{i}"] = np.where(np.isnan(centre), np.nan, total / weight)
        return result

    across = with_halo(blocks, [band], rows_pass, {"z": "double", **{p: "double" for p in parts}}, (0, reach), side, mirror=True)
    return with_halo(
        across, ["z", *parts], columns_pass, {"z": "double", **{n: "double" for n in names}}, (reach, 0), side, mirror=True)


#: sigma in pixels from which smoothing is done on a reduced level, and what is left of it there
REDUCED_FROM, REDUCED_SIGMA = 96.0, 10.0


def reduction_factor(sigma: float, side: int) -> int:
    """The largest divisor of the block side that leaves at least ``REDUCED_SIGMA`` pixels of a sigma."""
    return max(f for f in range(1, side + 1) if side % f == 0 and (f == 1 or sigma / f >= REDUCED_SIGMA))


def reduced_sigma(sigma: float, factor: int) -> float:
    """Sigma on the reduced level: the means of ``factor`` pixels and the linear steps back bring the rest of the variance."""
    return math.sqrt(sigma**2 - (factor**2 - 1) / 12 - factor**2 / 6) / factor


def reduction_error(sigma: float, factor: int) -> float:
    """Bound of the error of ``gaussian_reduced`` on fully known ground, as a share of half the range of heights in reach.

    The way over the reduced level is itself a mean with some weights; the sum of the absolute differences to the
    Gaussian's weights, over both axes, bounds what any terrain can do.  The worst place within a reduced pixel counts.
    """
    exact, coarse = gaussian_weights(sigma), gaussian_weights(reduced_sigma(sigma, factor))
    radius, reach = len(exact) // 2, len(coarse) // 2
    worst = 0.0
    for phase in range(factor):
        at = (phase + 0.5) / factor - 0.5
        first, share = math.floor(at), at - math.floor(at)
        steps = np.zeros(2 * reach + 2)
        steps[:-1] += (1 - share) * coarse
        steps[1:] += share * coarse
        own = np.repeat(steps / factor, factor)
        start = (first - reach) * factor - phase  # place of the first weight, seen from the pixel
        low = min(start, -radius)
        high = max(start + len(own), radius + 1)
        line = np.zeros(high - low)
        line[start - low:start - low + len(own)] += own
        line[-radius - low:radius + 1 - low] -= exact
        worst = max(worst, float(np.abs(line).sum()))
    return 2 * worst + worst * worst


def gaussian_reduced(blocks: DataFrame, sigma: float, band: str = "z", squares: bool = False, side: int = BLOCK) -> DataFrame:
    """``gaussian`` for one large sigma, worked out on a reduced level: bands ``z, g0`` (and ``s0``).

    Sums and counts of known cells over ``factor`` x ``factor`` pixels are smoothed as a raster of their own, whose blocks
    cover ``factor`` x ``factor`` blocks, and come back by linear steps.  A kernel of over a thousand taps becomes one of
    at most a few hundred, and no message goes further than one block of the reduced level.
    ``reduction_error`` bounds the difference.  The raster's edge counts as that of the blocks of the reduced level,
    beyond which it is mirrored; cells that do not exist weigh nothing.
    """
    factor = reduction_factor(sigma, side)
    part = side // factor
    layers = ("v", "w", "q") if squares else ("v", "w")

    def shrink(brow, bcol, arrays):
        z = arrays[0]
        known = ~np.isnan(z)
        filled = np.where(known, z, 0.0)

        def mean(a):
            return a.reshape(part, factor, part, factor).mean(axis=(1, 3))

        stack = [mean(filled), mean(known.astype(float)), *([mean(filled * filled)] if squares else [])]
        yield brow // factor, bcol // factor, (brow % factor) * factor + bcol % factor, np.stack(stack)

    def gather(brow, bcol, parts):
        out = np.zeros((len(layers), side, side))
        for k, values in parts.items():
            r, c = k // factor * part, k % factor * part
            out[:, r:r + part, c:c + part] = values.reshape(len(layers), part, part)
        return dict(zip(layers, out))

    kernel = gaussian_weights(reduced_sigma(sigma, factor))
    reach = len(kernel) // 2
    kinds = {n: "double" for n in layers}

    def along(axis):
        def run(*bands):
            # a block that does not exist holds no weight
            turned = [np.nan_to_num(a).T if axis == 0 else np.nan_to_num(a) for a in bands]
            done = [_smooth_rows(a, kernel) for a in turned]
            return dict(zip(layers, [d.T for d in done] if axis == 0 else done))
        return run

    level = exchange(blocks, [band], shrink, gather, kinds, side)
    level = with_halo(level, layers, along(1), kinds, (0, reach), side, mirror=True)
    level = with_halo(level, layers, along(0), kinds, (reach, 0), side, mirror=True)
    # one ring of neighbours more, so that each block of the raster gets all it needs for linear steps from one message
    ringed = with_halo(level, layers, lambda *bands: {n: _edged(a) for n, a in zip(layers, bands)}, kinds, (1, 1), side)

    def hand_back(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raster, brow, bcol = (batch.column(j)[i].as_py() for j in range(3))
                bands = [unnest(batch.column(3 + j)[i]).reshape(side + 2, side + 2) for j in range(len(layers))]
                rows, cols, payload = [], [], []
                for r in range(factor):
                    for c in range(factor):
                        rows.append(brow * factor + r)
                        cols.append(bcol * factor + c)
                        payload.append(np.stack([b[r * part:r * part + part + 2, c * part:c * part + part + 2] for b in bands]).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raster] * len(rows)), pa.array(rows), pa.array(cols), pa.array(payload, pa.list_(pa.float64()))], ["raster_id", "brow", "bcol", "coarse"])

    back = ringed.mapInArrow(hand_back, "raster_id string, brow bigint, bcol bigint, coarse array<double>")
    both = blocks.select("raster_id", "brow", "bcol", band).join(back, ["raster_id", "brow", "bcol"])
    at = (np.arange(side) + 0.5) / factor + 0.5  # in the patch, whose first cell is a neighbour's
    first, share = np.floor(at).astype(int), at - np.floor(at)

    def grow(batches):
        names = ["g0"] + ["s0"] * squares
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                z = unnest(batch.column(3)[i]).reshape(side, side)
                patch = unnest(batch.column(4)[i]).reshape(len(layers), part + 2, part + 2)
                rows = patch[:, first] * (1 - share)[:, None] + patch[:, first + 1] * share[:, None]
                full = rows[:, :, first] * (1 - share) + rows[:, :, first + 1] * share
                with np.errstate(invalid="ignore", divide="ignore"):
                    out.append([np.where(np.isnan(z), np.nan, full[k] / full[1]).reshape(-1) for k in ([0, 2] if squares else [0])])
            columns = [nested(np.stack([o[k] for o in out]), "double") for k in range(len(names))] if out else [pa.array([], pa.list_(pa.float64())) for _ in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], *columns], ["raster_id", "brow", "bcol", "z", *names])

    schema = "raster_id string, brow bigint, bcol bigint, z array<double>, g0 array<double>" + ", s0 array<double>" * squares
    return both.mapInArrow(grow, schema)


def _edged(a: np.ndarray) -> np.ndarray:
    """A padded array whose unknown outermost ring repeats what lies inside."""
    a = a.copy()
    for axis in (0, 1):
        b = np.moveaxis(a, axis, 0)
        b[0] = np.where(np.isnan(b[0]), b[1], b[0])
        b[-1] = np.where(np.isnan(b[-1]), b[-2], b[-1])
    return a


def _with_each(rows: DataFrame, per_raster: DataFrame) -> DataFrame:
    """Rows with what is known of their raster, one small row a raster: these go to the rows.

    A join that deals both out by raster would read a raster in one task.
    """
    return rows.join(F.broadcast(per_raster), "raster_id")


def median_stand_in(blocks: DataFrame, band: str = "z", digits: int = 2, side: int = BLOCK) -> DataFrame:
    """Band ``base``: ``band`` with the median height of the raster where nothing is known.

    The median is exact for heights rounded to ``digits``; values are counted before the percentile.
    """
    scale = float(10**digits)
    counts = (
        blocks.select("raster_id", F.explode(band).alias("v")).filter(F.col("v").isNotNull())
        .groupBy("raster_id", F.floor(F.col("v") * scale + 0.5).cast("bigint").alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    median = counts.groupBy("raster_id").agg(
        (F.percentile("step", F.lit(0.5), F.col("n")) / scale).alias("median"))
    return _with_each(blocks, median).select(
        "raster_id", "brow", "bcol", band,
        F.transform(F.col(band), lambda v: F.coalesce(v, F.col("median"))).alias("base"))


def local_relief(blocks: DataFrame, sigma_px: float = 15.0, band: str = "z", holes: str = "median",
                 side: int = BLOCK) -> DataFrame:
    """Band ``lrm``: height minus its Gaussian mean.

    With ``holes="median"`` unknown cells weigh in at the median height, with ``"skip"`` they take no
    part; either way they stay unknown in the result.
    """
    if holes == "skip":
        smooth = gaussian(blocks, [sigma_px], band, side=side)
        return smooth.select("raster_id", "brow", "bcol", F.zip_with("z", "g0", lambda z, g: z - g).alias("lrm"))
    based = median_stand_in(blocks, band, side=side)
    smooth = gaussian(based, [sigma_px], "base", side=side).select("raster_id", "brow", "bcol", "g0")
    return based.join(smooth, ["raster_id", "brow", "bcol"]).select(
        "raster_id", "brow", "bcol", F.zip_with(band, "g0", lambda z, g: z - g).alias("lrm"))


def multiscale_deviation(blocks: DataFrame, res: float, band: str = "z", side: int = BLOCK) -> DataFrame:
    """Bands ``local, meso, broad``: per scale band the deviation of largest magnitude (own reducer).

    Each scale band is smoothed on its own, so the fine ones exchange narrow margins only, and sigmas of at least
    ``REDUCED_FROM`` pixels on a reduced level (``reduction_error`` bounds the difference).
    """
    def pick(v):
        first, second = shade.deviation(v.z, v.g0, v.s0), shade.deviation(v.z, v.g1, v.s1)
        return F.when(F.abs(second) > F.abs(first), second).otherwise(first)

    keys, result = ["raster_id", "brow", "bcol"], None
    for name, limits in shade.MSTP_BANDS.items():
        sigmas = [metres / res for metres in limits]
        if max(sigmas) < REDUCED_FROM:
            smooth = gaussian(blocks, sigmas, band, squares=True, side=side)
        else:
            one, two = (gaussian_reduced(blocks, s, band, True, side) if s >= REDUCED_FROM else gaussian(blocks, [s], band, True, side) for s in sigmas)
            smooth = one.join(two.select(*keys, F.col("g0").alias("g1"), F.col("s0").alias("s1")), keys)
        one = smooth.select(*keys, F.transform(F.arrays_zip("z", "g0", "s0", "g1", "s1"), pick).alias(name))
        result = one if result is None else result.join(one, keys)
    return result


# -- horizons -------------------------------------------------------------------------------------

def ray_samples(dist_px: int, directions: int, sampling: str = "bilinear"):
    """Per direction and step the cells read and their weights: (direction, step, [(dr, dc, w)...])."""
    rays = []
    for k in range(directions):
        angle = 2 * math.pi * k / directions
        ux, uy = round(math.sin(angle), 12), round(-math.cos(angle), 12)
        for step in range(1, dist_px + 1):
            dx, dy = ux * step, uy * step
            if sampling == "nearest":
                cells = [(math.floor(dy + 0.5), math.floor(dx + 0.5), 1.0)]
            else:
                r0, c0 = math.floor(dy), math.floor(dx)
                fr, fc = dy - r0, dx - c0
                cells = [(r0, c0, (1 - fr) * (1 - fc)), (r0, c0 + 1, (1 - fr) * fc),
                         (r0 + 1, c0, fr * (1 - fc)), (r0 + 1, c0 + 1, fr * fc)]
            rays.append((k, step, [(r, c, w) for r, c, w in cells if w > 1e-9]))
    return rays


def horizons(blocks: DataFrame, res: float, dist_px: int = 20, directions: int = 16, band: str = "z",
             sampling: str = "bilinear", side: int = BLOCK, gradient: bool = False) -> DataFrame:
    """Sky view (both conventions) and both opennesses from one walk over the rays.

    Bands ``svf_flux, svf_rvt, opos, oneg``.  A sample with an unknown cell is skipped; a direction
    without any sample counts as level.  With ``gradient`` the same exchange also gives ``p`` and ``q``.
    """
    rays = ray_samples(dist_px, directions, sampling)
    reach = dist_px + 1

    def kernel(z):
        height, width = z.shape[0] - 2 * reach, z.shape[1] - 2 * reach
        centre = z[reach:reach + height, reach:reach + width]
        sums = {name: np.zeros((height, width)) for name in ("svf_flux", "svf_rvt", "opos", "oneg")}
        for k in range(directions):
            high = np.full((height, width), -np.inf)
            low = np.full((height, width), np.inf)
            for direction, step, cells in rays[k * dist_px:(k + 1) * dist_px]:
                value = np.zeros((height, width))
                for dr, dc, w in cells:
                    value = value + w * z[reach + dr:reach + dr + height, reach + dc:reach + dc + width]
                tangent = (value - centre) / (step * res)
                high = np.fmax(high, tangent)
                low = np.fmin(low, tangent)
            level = np.isinf(high)
            high, low = np.where(level, 0.0, high), np.where(level, 0.0, low)
            up = np.maximum(high, 0.0)
            sums["svf_flux"] += 1.0 / (1.0 + up * up)
            sums["svf_rvt"] += 1.0 - up / np.sqrt(1.0 + up * up)
            sums["opos"] += 0.5 - np.arctan(high) / math.pi
            sums["oneg"] += 0.5 - np.arctan(low) / math.pi
        result = {name: np.where(np.isnan(centre), np.nan, s / directions) for name, s in sums.items()}
        if gradient:
            result |= _horn(z[reach - 1:reach + height + 1, reach - 1:reach + width + 1], res)
        return result

    names = ("svf_flux", "svf_rvt", "opos", "oneg") + ("p", "q") * gradient
    return with_halo(blocks, [band], kernel, {n: "double" for n in names}, (reach, reach), side)


# -- stretches ------------------------------------------------------------------------------------

def percentile_bounds(cells: DataFrame, value: str, low: float, high: float, digits: int = 3) -> DataFrame:
    """Two percentiles per raster of the values rounded to ``digits``: ``raster_id, p_low, p_high``.

    Counting rounded values first combines before the shuffle and bounds what the exact percentile
    sees by the value range, not by the number of cells.
    """
    scale = float(10**digits)
    counts = (
        cells.filter(F.col(value).isNotNull())
        .select("raster_id", F.floor(F.col(value) * scale + 0.5).cast("bigint").alias("step"))
        .groupBy("raster_id", "step").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("raster_id").agg(
        (F.percentile("step", F.lit(float(low)), F.col("n")) / scale).alias("p_low"),
        (F.percentile("step", F.lit(float(high)), F.col("n")) / scale).alias("p_high"))


def stretch_codes(cells: DataFrame, value: str, low: float, high: float, exponent: float = 1.0, mirror: bool = False,
                  digits: int = 3) -> DataFrame:
    """Cells with ``unit`` (0..1 after stretch and gamma) and ``code`` (1..255)."""
    bounds = percentile_bounds(cells, value, low, high, digits)
    curve = shade.mirror_gamma if mirror else shade.gamma
    unit = curve(shade.stretch(_c(value), F.col("p_low"), F.col("p_high")), exponent)
    return (
        _with_each(cells, bounds).withColumn("unit", unit)
        .withColumn("code", shade.code_unit(F.col("unit"))).drop("p_low", "p_high")
    )


def block_bounds(blocks: DataFrame, bands: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Percentiles of several bands in one aggregate: ``raster_id, bounds`` with a (low, high) struct per band.

    ``bands`` maps a band to its two shares and the digits its values are rounded to.  As in
    ``percentile_bounds`` the values are counted first, so what meets is bounded by the range of values.
    """
    def steps(name: str, digits: int) -> Column:
        known = F.filter(name, lambda v: v.isNotNull())
        return F.transform(known, lambda v: F.struct(F.lit(name).alias("band"), F.floor(v * float(10**digits) + 0.5).cast("bigint").alias("step")))

    values = F.explode(F.concat(*[steps(name, digits) for name, (_, _, digits) in bands.items()])).alias("v")
    counts = blocks.select("raster_id", values).groupBy("raster_id", "v").agg(F.count(F.lit(1)).alias("n"))

    def bounds(name: str, low: float, high: float, digits: int) -> Column:
        own = F.when(F.col("v.band") == name, F.col("v.step"))
        ends = [(F.percentile(own, F.lit(float(share)), F.col("n")) / float(10**digits)).alias(end) for share, end in ((low, "low"), (high, "high"))]
        return F.struct(*ends).alias(name)

    return counts.groupBy("raster_id").agg(F.struct(*[bounds(name, *spec) for name, spec in bands.items()]).alias("bounds"))


def stretched_blocks(blocks: DataFrame, bands: dict[str, tuple[float, float, int]]) -> DataFrame:
    """The blocks with each of the bands replaced by its 0..1 stretch between two percentiles of its raster."""
    bounds = block_bounds(blocks, bands)  # one row per raster
    out = _with_each(blocks, bounds)
    for name in bands:
        low, high = F.col(f"bounds.{name}.low"), F.col(f"bounds.{name}.high")
        out = out.withColumn(name, _stretched(name, low, high))
    return out.drop("bounds")


def _stretched(name: str, low: Column, high: Column) -> Column:
    return F.transform(name, lambda v: shade.stretch(v, low, high))


def vat_blocks(blocks: DataFrame, res: float, dist_px: int = 20, directions: int = 16, side: int = BLOCK) -> DataFrame:
    """Band ``code``: the VAT-style blend.  One exchange, one aggregate for both stretches, no join of cells."""
    layers = horizons(blocks, res, dist_px, directions, side=side, gradient=True).select("raster_id", "brow", "bcol", "svf_flux", "opos", "p", "q")
    layers = stretched_blocks(layers, {"svf_flux": (0.02, 0.98, 4), "opos": (0.02, 0.98, 4)})
    code = F.transform(
        F.arrays_zip("svf_flux", "opos", "p", "q"),
        lambda v: F.when(v.p.isNotNull(), shade.vat_code(shade.code_unit(v.svf_flux), shade.code_unit(v.opos), shade.slope_code(v.p, v.q))))
    return layers.select("raster_id", "brow", "bcol", code.alias("code"))


def rrim_blocks(blocks: DataFrame, res: float, sigma_px: float = 15.0, side: int = BLOCK) -> DataFrame:
    """Bands ``r`` and ``gb``: slope in red over the stretched local relief; gradient and relief meet block by block."""
    keys = ["raster_id", "brow", "bcol"]
    relief = stretched_blocks(local_relief(blocks, sigma_px, holes="skip", side=side), {"lrm": (0.05, 0.95, 3)})
    both = horn_gradient(blocks, res, side=side).join(relief, keys)
    red = F.zip_with("p", "q", lambda p, q: shade.rrim_red(shade.slope_degrees(p, q)))
    return both.select(*keys, red.alias("r"), F.transform("lrm", shade.rrim_grey).alias("gb"))


def e4mstp_blocks(blocks: DataFrame, res: float, dist_px: int = 20, directions: int = 16, sigmas_m: tuple[float, float] = (1.5, 8.0), side: int = BLOCK) -> DataFrame:
    """Bands ``r, g, b`` of the composite in the manner of e4MSTP, from layers computed here.

    Red carries the broad, green the middle and blue the local deviation.  Horizons, gradient and residuals are
    computed once and meet block by block.
    """
    keys = ["raster_id", "brow", "bcol"]
    sky = horizons(blocks, res, dist_px, directions, side=side, gradient=True).select(*keys, "svf_flux", "opos", "oneg", "p", "q")
    smooth = gaussian(blocks, [m / res for m in sigmas_m], side=side)
    residuals = smooth.select(*keys, F.zip_with("z", "g0", lambda z, g: z - g).alias("fine"), F.zip_with("z", "g1", lambda z, g: z - g).alias("wide"))
    wide = {"svf_flux": (0.02, 0.98, 4), "opos": (0.02, 0.98, 4), "oneg": (0.02, 0.98, 4), "fine": (0.05, 0.95, 3), "wide": (0.05, 0.95, 3)}
    layers = stretched_blocks(sky.join(residuals, keys), wide).join(multiscale_deviation(blocks, res, side=side), keys)
    zipped = F.arrays_zip("svf_flux", "opos", "oneg", "fine", "wide", "p", "q", "local", "meso", "broad")

    def channel(scale: str) -> Column:
        code = shade.code_unit
        return F.transform(zipped, lambda v: F.when(v.p.isNotNull(), shade.e4mstp_channel(
            shade.deviation_code(v[scale]), code(v.svf_flux), code(v.opos), code(v.oneg), shade.slope_code(v.p, v.q), code(v.fine), code(v.wide))))

    return layers.select(*keys, channel("broad").alias("r"), channel("meso").alias("g"), channel("local").alias("b"))
