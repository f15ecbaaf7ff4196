"""Moving rasters between grids: bilinear warp, mosaics, product names and shading requests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.functions.geo import _c, floor_long
from reliefspark.operators.blocks import exchange
from reliefspark.operators.catalogue import best_per_key

# Shading types, their parameters, presets.
SHADING_PARAMETERS = {
    "multi": ("elevation",), "315": ("elevation",), "045": ("elevation",), "135": ("elevation",),
    "225": ("elevation",), "slope": (), "svf": ("conv", "dist", "gamma", "sweep"),
    "opos": ("dist", "gamma", "sweep"), "oneg": ("dist", "gamma", "sweep"), "lrm": ("sigma",),
    "rrim": ("sigma",), "vat": ("dist", "gamma"), "e4mstp": ("dist", "gamma"),
}
SHADING_TYPES = ("lrm", "vat", "e4mstp", "svf", "opos", "oneg", "rrim", "multi", "315", "045", "135", "225", "slope")
HEAVY_TYPES = ("vat", "e4mstp")
PRESETS = {
    "micro": {"dist": 15.0, "sigma": 8.0, "elevation": 25.0},
    "standard": {"dist": 30.0, "sigma": 15.0, "elevation": 25.0},
    "landscape": {"dist": 80.0, "sigma": 40.0, "elevation": 30.0},
}
PRESET_TYPES = ("svf", "opos", "lrm", "multi", "slope")


def warp_bilinear(cells: DataFrame, targets: DataFrame, source_row: Column, source_col: Column,
                  value: str = "z") -> DataFrame:
    """Value of every target cell from the four source cells around its position.

    ``targets`` has ``raster_id, row, col``; the two columns give the position of the target centre in
    source cells (cell centres at whole numbers).  Unknown corners drop out and the other weights are
    scaled up.  Each target asks for at most four cells by equality, so the join spreads like a hash.

    The corners are made from Arrow batches: as column expressions the two positions would be copied into every corner
    and into the filter on their weights, each time with the whole projection in them.
    """
    placed = targets.select("raster_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"),
                            source_row.cast("double").alias("_r"), source_col.cast("double").alias("_c"))

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            r0, c0 = np.floor(r), np.floor(c)
            fr, fc = r - r0, c - c0
            for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
                w = (fr if dr else 1.0 - fr) * (fc if dc else 1.0 - fc)
                use = w > 0
                own = batch.select([0, 1, 2]).filter(pa.array(use))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array((r0[use] + dr).astype(np.int64)), pa.array((c0[use] + dc).astype(np.int64)), pa.array(w[use])],
                    ["raster_id", "row", "col", "s_row", "s_col", "w"])

    kind = targets.schema["raster_id"].dataType.simpleString()
    asked = placed.mapInArrow(corners, f"raster_id {kind}, row bigint, col bigint, s_row bigint, s_col bigint, w double")
    source = cells.filter(F.col(value).isNotNull()).select(
        "raster_id", F.col("row").alias("s_row"), F.col("col").alias("s_col"), F.col(value).alias("_v"))
    return (
        # its size is guessed from the few blocks it was made of: it must not be gathered and sent to all
        asked.hint("merge").join(source.hint("merge"), ["raster_id", "s_row", "s_col"])
        .groupBy("raster_id", "row", "col")
        .agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))
    )


#: nodes along a side for interpolated positions, and how far (in cells) they may be off before every position is computed
_NODES, _OFF = 10, 1e-8


class _Positions:
    """Source positions of all cells of a target block.

    A mapping is smooth over a block, so it is evaluated at a few Chebyshev nodes and carried to all cells by a
    polynomial, two small matrix products; where some cells in between show that this is not exact enough, the
    mapping itself is evaluated everywhere.
    """

    def __init__(self, mapping, side: int):
        self.mapping, self.side = mapping, side
        k = min(_NODES, side)
        self.nodes = (np.cos((2 * np.arange(k) + 1) * math.pi / (2 * k)) + 1) / 2 * (side - 1)

        def terms(at):
            return np.polynomial.chebyshev.chebvander(2 * at / max(side - 1, 1) - 1, k - 1)

        self.spread = terms(np.arange(side, dtype=float)) @ np.linalg.inv(terms(self.nodes))
        self.probes = np.unique(np.linspace(0, side - 1, 6).astype(int))

    def of(self, brow: int, bcol: int) -> list[np.ndarray]:
        top, left = brow * self.side, bcol * self.side

        def exact(at):
            r, c = np.meshgrid(at, at, indexing="ij")
            return self.mapping.to_source(r + top, c + left)

        out = []
        for coarse in exact(self.nodes):
            middle = coarse[0, 0]
            out.append(self.spread @ (coarse - middle) @ self.spread.T + middle)
        pick = np.ix_(self.probes, self.probes)
        if any(np.abs(o[pick] - e).max() > _OFF for o, e in zip(out, exact(self.probes.astype(float)))):
            return list(exact(np.arange(self.side, dtype=float)))
        # a position on a cell stays there: a rounding error must not bring its neighbours in
        return [np.where(np.abs(o - np.rint(o)) < _OFF, np.rint(o), o) for o in out]


def _one_cell(source: np.ndarray, top: int, left: int, position: tuple[float, float]) -> float:
    """Bilinear value at one position; ``top, left`` are the place of ``source[0, 0]``."""
    first_row, first_col = (math.floor(p) for p in position)
    fr, fc = position[0] - first_row, position[1] - first_col
    total = weight = 0.0
    for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
        r, c = first_row + dr - top, first_col + dc - left
        if 0 <= r < source.shape[0] and 0 <= c < source.shape[1] and not math.isnan(source[r, c]):
            w = (fr if dr else 1.0 - fr) * (fc if dc else 1.0 - fc)
            if w > 0:
                total += w * float(source[r, c])
                weight += w
    return total / weight if weight > 0 else math.nan


def warp_blocks(blocks: DataFrame, band: str, mapping, side: int, target_side: int, most_sources: int = 256,
                steps: float | None = None) -> DataFrame:
    """Bilinear warp on blocks: ``band`` on the target grid, in blocks of ``target_side``.

    ``mapping.to_target(row, col)`` and ``mapping.to_source(row, col)`` work on arrays of cell positions
    (centres at whole numbers).  Every source block sends to each target block its outline reaches the rectangle
    that this one needs, one shuffle in all and hardly more than the raster itself.  A target block receives parts
    of about as many source blocks as its footprint covers; where that would be over ``most_sources`` the job
    fails: build the pyramid first.

    ``steps`` per unit names the steps that the values are cut to later.  Values that lie on one, as all do where a
    plateau is as high as a step, would fall to either side by the last bits of their positions; they are worked out
    anew one by one (``mapping.to_source_one(row, col)``).  So are, where the mapping has that function, positions on a
    line of cells with unknown ones around: a last bit decides there whether the cell before or behind has a say.
    """
    edge = np.linspace(-1.0, float(target_side), 33)
    rim_rows = np.concatenate([np.full(33, -1.0), np.full(33, float(target_side)), edge, edge])
    rim_cols = np.concatenate([edge, edge, np.full(33, -1.0), np.full(33, float(target_side))])

    def send(brow, bcol, arrays):
        if np.isnan(arrays[0]).all():
            return
        # positions along the outline, one cell beyond it, since neighbours interpolate towards it
        steps = np.linspace(-1.0, float(side), 33)
        low, high = np.full(33, -1.0), np.full(33, float(side))
        rows = np.concatenate([low, high, steps, steps]) + brow * side
        cols = np.concatenate([steps, steps, low, high]) + bcol * side
        to_row, to_col = mapping.to_target(rows, cols)
        first_row, last_row = (int(math.floor(v / target_side)) for v in (to_row.min() - 1, to_row.max() + 1))
        first_col, last_col = (int(math.floor(v / target_side)) for v in (to_col.min() - 1, to_col.max() + 1))
        footprint = target_side * target_side / max((to_row.max() - to_row.min()) * (to_col.max() - to_col.min()), 1e-9)
        if footprint > most_sources:
            raise ValueError(f"a target block would gather {footprint:.0f} source blocks: reduce first")
        part = (brow % 4096) * 4096 + bcol % 4096
        for i in range(first_row, last_row + 1):
            for j in range(first_col, last_col + 1):
                need = mapping.to_source(rim_rows + i * target_side, rim_cols + j * target_side)
                (r0, r1), (c0, c1) = ((max(int(v.min()) - 2 - o, 0), min(int(v.max()) + 3 - o, side)) for v, o in zip(need, (brow * side, bcol * side)))
                if r0 < r1 and c0 < c1:
                    yield i, j, part, np.concatenate([[brow * side + r0, bcol * side + c0, r1 - r0, c1 - c0], arrays[0][r0:r1, c0:c1].reshape(-1)])

    positions = _Positions(mapping, target_side)

    def on_steps(z, brow, bcol, source, top, left):
        """``z`` with the values that lie on a step worked out anew."""
        if steps is None:
            return z
        low, high = np.nanmin(source), np.nanmax(source)
        # positions are off by _OFF at most along both axes, sums by a few last bits
        margin = steps * (4 * _OFF * (high - low) + 1e-14 * max(abs(low), abs(high)))
        with np.errstate(invalid="ignore"):
            near = np.abs(z * steps - np.rint(z * steps)) <= margin
        for r, c in zip(*np.nonzero(near)):
            z[r, c] = _one_cell(source, top, left, mapping.to_source_one(brow * target_side + int(r), bcol * target_side + int(c)))
        return z

    def at_rim(z, brow, bcol, source, top, left, from_row, from_col):
        """``z`` with the values worked out anew whose positions lie on a line of cells, where not all cells around are known."""
        if not hasattr(mapping, "to_source_one"):
            return z
        on_row, on_col = np.rint(from_row), np.rint(from_col)
        for r, c in zip(*np.nonzero((np.abs(from_row - on_row) <= 2 * _OFF) | (np.abs(from_col - on_col) <= 2 * _OFF))):
            i, j = int(on_row[r, c]) - top, int(on_col[r, c]) - left
            around = source[max(i - 1, 0):max(i + 2, 0), max(j - 1, 0):max(j + 2, 0)]
            if not np.isnan(around).all() and (around.size < 9 or np.isnan(around).any()):
                z[r, c] = _one_cell(source, top, left, mapping.to_source_one(brow * target_side + int(r), bcol * target_side + int(c)))
        return z

    def combine(brow, bcol, parts):
        known = [(*map(int, p[:4]), p[4:]) for p in parts.values()]
        top, left = min(k[0] for k in known), min(k[1] for k in known)
        # one cell of margin on each side keeps every corner index inside
        source = np.full((max(k[0] + k[2] for k in known) - top + 2, max(k[1] + k[3] for k in known) - left + 2), np.nan)
        for r, c, height, width, values in known:
            source[r - top + 1:r - top + 1 + height, c - left + 1:c - left + 1 + width] = values.reshape(height, width)
        from_row, from_col = positions.of(brow, bcol)
        r0, c0 = np.floor(from_row), np.floor(from_col)
        fr, fc = from_row - r0, from_col - c0
        height, width = source.shape
        i, j = ((v - o + 1).clip(-1, n).astype(np.int64) for v, o, n in ((r0, top, height), (c0, left, width)))
        up, down = (np.clip(i + d, 0, height - 1) * width for d in (0, 1))
        ahead, behind = (np.clip(j + d, 0, width - 1) for d in (0, 1))
        flat = source.reshape(-1)
        corners = [flat[r + c] for r in (up, down) for c in (ahead, behind)]
        weights = [(1 - fr) * (1 - fc), (1 - fr) * fc, fr * (1 - fc), fr * fc]
        plain = ((corners[0] * weights[0] + corners[1] * weights[1]) + corners[2] * weights[2]) + corners[3] * weights[3]
        if not np.isnan(plain).any():
            return {band: on_steps(plain / (((weights[0] + weights[1]) + weights[2]) + weights[3]), brow, bcol, source, top - 1, left - 1)}
        total, weight = np.zeros_like(fr), np.zeros_like(fr)
        for value, w in zip(corners, weights):
            use = ~np.isnan(value) & (w > 0)
            total += np.where(use, w * np.where(use, value, 0.0), 0.0)
            weight += np.where(use, w, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            z = at_rim(np.where(weight > 0, total / weight, np.nan), brow, bcol, source, top - 1, left - 1, from_row, from_col)
        return None if np.isnan(z).all() else {band: on_steps(z, brow, bcol, source, top - 1, left - 1)}

    return exchange(blocks, [band], send, combine, {band: "double"}, side)


def target_cells(blocks_of_targets: DataFrame, side: int) -> DataFrame:
    """All cells of the given target blocks (raster_id, brow, bcol).

    The blocks are few bytes but many cells: an explicit width, or adaptive execution deals them all to one task; by a
    hash, since a repartition by the keys of the blocks is left out where they come from an aggregate by the same.
    """
    slots = F.sequence(F.lit(0), F.lit(side * side - 1))
    width = int(blocks_of_targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks_of_targets.repartition(width, F.xxhash64("raster_id", "brow", "bcol")).select("raster_id", "brow", "bcol", F.explode(slots).alias("slot")).select(
        "raster_id", (F.col("brow") * side + floor_long(F.col("slot") / F.lit(side))).alias("row"),
        (F.col("bcol") * side + F.pmod(F.col("slot"), F.lit(side))).cast("bigint").alias("col"))


def mosaic(layers: DataFrame, value: str = "z", order: list[Column] | None = None) -> DataFrame:
    """One value per cell from overlapping sources (``raster_id, row, col, priority``): unknown values
    skipped, then the smallest priority, then the given order."""
    known = layers.filter(F.col(value).isNotNull())
    return best_per_key(known, ["raster_id", "row", "col"], [F.col("priority"), *(order or [])])


def relabel_crs(grids: DataFrame, epsg: int) -> DataFrame:
    """Grid metadata with another coordinate system; the cells stay where they are."""
    return grids.withColumn("epsg", F.lit(epsg))


# -- shading requests -----------------------------------------------------------------------------

def parse_shading(spec) -> Column:
    """``TYPE:k=v,...`` -> struct(type, params map, problem); problem is NULL when the request is valid."""
    spec = F.trim(_c(spec))
    kind = F.element_at(F.split(spec, ":"), 1)
    text = F.when(spec.contains(":"), F.substring_index(spec, ":", -1)).otherwise("")
    params = F.when(text != "", F.str_to_map(text, F.lit(","), F.lit("="))).otherwise(
        F.create_map().cast("map<string,string>"))
    allowed = F.create_map(*[x for k, v in SHADING_PARAMETERS.items()
                             for x in (F.lit(k), F.array(*[F.lit(p) for p in v]).cast("array<string>"))])
    known = F.coalesce(F.try_element_at(allowed, kind), F.array().cast("array<string>"))
    number = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
    bad_value = F.exists(F.map_entries(params), lambda e: F.when(
        e.key == "conv", ~F.coalesce(e.value, F.lit("")).isin("flux", "rvt")).otherwise(
        ~F.coalesce(e.value, F.lit("")).rlike(number)))
    problem = (
        F.when(~kind.isin(*SHADING_PARAMETERS), "unknown type")
        .when(F.size(F.array_except(F.map_keys(params), known)) > 0, "unknown parameter")
        .when(bad_value, "bad value")
    )
    return F.struct(kind.alias("type"), params.alias("params"), problem.alias("problem"))


def product_name(area, kind, params) -> Column:
    """Product name: explicit parameters are part of it (metres whole, gamma to a tenth)."""
    params = _c(params)

    def value(key):
        return F.try_element_at(params, F.lit(key))

    def whole(key):
        return F.bround(value(key).cast("double"), 0).cast("int").cast("string")

    tenth = F.bround(value("gamma").cast("double") * 10.0, 0).cast("int")
    return F.concat(F.concat_ws(
        "_", _c(area), _c(kind),
        F.when(_c(kind) == "svf", F.coalesce(value("conv"), F.lit("flux"))),
        F.concat(whole("dist"), F.lit("m")),
        F.concat(F.lit("s"), whole("sigma"), F.lit("m")),
        F.concat(F.lit("e"), whole("elevation")),
        F.concat(F.lit("g"), F.floor(tenth / F.lit(10)).cast("string"), F.lit("p"), F.pmod(tenth, F.lit(10)).cast("string")),
    ), F.lit("_ombrage.tif"))


def name_collisions(requests: DataFrame, name: Column, settings: Column) -> DataFrame:
    """Product names that several different settings fall on (equal settings are no collision)."""
    return (
        requests.select(name.alias("name"), settings.alias("settings"))
        .groupBy("name").agg(F.count_distinct("settings").alias("n_settings"))
        .filter(F.col("n_settings") > 1)
    )


def preset_name(resolution_m) -> Column:
    return F.when(_c(resolution_m) <= 0.75, "micro").when(_c(resolution_m) <= 2.5, "standard").otherwise("landscape")


def preset_requests(rows: DataFrame, resolution: str) -> DataFrame:
    """The five shadings of the preset chosen by resolution, one row each."""
    table = F.create_map(*[x for name, p in PRESETS.items() for x in (
        F.lit(name), F.array(*[F.struct(
            F.lit(kind).alias("type"),
            F.lit(p["dist"] if kind in ("svf", "opos") else None).cast("double").alias("dist"),
            F.lit(p["sigma"] if kind == "lrm" else None).cast("double").alias("sigma"),
            F.lit(p["elevation"] if kind == "multi" else None).cast("double").alias("elevation"))
            for kind in PRESET_TYPES]))])
    named = rows.withColumn("preset", preset_name(resolution))
    return named.select(*named.columns, F.inline(F.element_at(table, F.col("preset"))))


def expand_types(requested: Column) -> Column:
    """Requested type list with ``all`` (everything but the heavy composites) and ``none`` resolved."""
    everything = F.array(*[F.lit(t) for t in SHADING_TYPES if t not in HEAVY_TYPES])
    valid = F.array(*[F.lit(t) for t in SHADING_TYPES])
    return (
        F.when(F.arrays_overlap(requested, F.array(F.lit("none"), F.lit("aucun"))), F.array().cast("array<string>"))
        .when(F.arrays_overlap(requested, F.array(F.lit("all"), F.lit("tous"))),
              F.array_union(everything, F.array_intersect(requested, valid)))
        .otherwise(F.array_distinct(F.array_intersect(requested, valid)))
    )


def default_sigma_m(resolution_m) -> Column:
    return _c(resolution_m) * F.lit(15.0)


def with_precomputed(products: DataFrame, providers: DataFrame, kind: str) -> DataFrame:
    """Marks per product whether the provider's own shading replaces a computed one."""
    return products.join(providers.select("code", "precomputed"), "code", "left").withColumn(
        "origin", F.when(F.array_contains(F.coalesce("precomputed", F.array().cast("array<string>")), F.lit(kind)), "provider")
        .otherwise("computed")).drop("precomputed")


def split_layers(requests: DataFrame, split: Callable[[Column], Column]) -> DataFrame:
    """One row per requested type."""
    return requests.withColumn("type", F.explode(split(F.col("types"))))
