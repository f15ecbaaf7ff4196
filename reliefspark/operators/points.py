"""Point-cloud operators: cleaning, binning, height bands, feature models.

Points: ``cloud_id, x, y, z, cls, withheld``.  Cells sit on one global grid per resolution, row 0 at
``top`` and column 0 at ``left``, so neighbouring clouds never show a seam.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefspark.functions.geo import _c, floor_long
from reliefspark.operators import fill
from reliefspark.operators.blocks import BLOCK, KEYS, at_cells, blocks_to_cells, cells_to_blocks, fill_domain

# ASPRS classes and default settings of the feature model.
NOISE_CLASSES = (7, 18)
GROUND_CLASSES = (2, 9, 66)
REFERENCE_CLASSES = (2,)
LOW_CLASSES = (1, 3, 4)
DEFAULT_CLASSES = (1, 2, 3, 4, 9, 66)
HEIGHT_MIN, HEIGHT_MAX = 0.4, 2.5
CLOTH_DEFAULTS = {"threshold": 0.5, "resolution": 0.5, "rigidness": 1}
METRE_UNITS = ("metre", "meter", "m")


@dataclass(frozen=True)
class Grid:
    """Global cell grid: resolution, origin at the top left, side of a nominal tile in cells."""

    res: float
    left: float = 0.0
    top: float = 0.0
    tile_cells: int = 1000

    def row(self, y="y") -> Column:
        return floor_long((F.lit(self.top) - _c(y)) / F.lit(self.res))

    def col(self, x="x") -> Column:
        return floor_long((_c(x) - F.lit(self.left)) / F.lit(self.res))

    def cell(self, x="x", y="y") -> Column:
        """Row and column in one number: aggregates and joins on a single long are the fast path."""
        return cell_key(self.row(y), self.col(x))


_COL_SPAN, _COL_SHIFT = 1 << 32, 1 << 31


def cell_key(row, col) -> Column:
    return _c(row) * F.lit(_COL_SPAN) + (_c(col) + F.lit(_COL_SHIFT))


def key_row(cell="cell") -> Column:
    return F.shiftright(_c(cell), 32)


def key_col(cell="cell") -> Column:
    return F.pmod(_c(cell), F.lit(_COL_SPAN)) - F.lit(_COL_SHIFT)


# -- guards and filters ---------------------------------------------------------------------------

def crs_verdict(epsg, unit, expected_epsg) -> Column:
    """'ok', 'wrong crs' or 'not metric'; unknown values pass."""
    epsg, unit = _c(epsg), _c(unit)
    return (
        F.when(epsg != _c(expected_epsg), "wrong crs")
        .when(~F.lower(unit).isin(*METRE_UNITS), "not metric")
        .otherwise("ok")
    )


def require_crs(headers: DataFrame, expected_epsg, strict: bool = True) -> DataFrame:
    """Headers that fit; with ``strict`` the job fails on the first one that does not."""
    verdict = crs_verdict("epsg", "unit", expected_epsg)
    if not strict:
        return headers.filter(verdict == "ok")
    message = F.concat(F.lit("cloud "), F.col("cloud_id").cast("string"), F.lit(": "), verdict)
    return headers.filter(F.when(verdict == "ok", True).otherwise(F.raise_error(message).cast("boolean")))


def drop_noise(points: DataFrame) -> DataFrame:
    return points.filter(~F.col("cls").isin(*NOISE_CLASSES) & ~F.coalesce(F.col("withheld"), F.lit(False)))


def clip_bounds(points: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Half-open clip: lower edges belong to the box, upper edges do not."""
    x0, y0, x1, y1 = (float(v) for v in bounds)
    return points.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def read_window(points: DataFrame, box: Sequence[float]) -> DataFrame:
    """Points inside a closed box; plain range predicates, so Parquet statistics prune the scan."""
    x0, y0, x1, y1 = (float(v) for v in box)
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def keep_classes(points: DataFrame, *class_sets: Sequence[int]) -> DataFrame:
    return points.filter(F.col("cls").isin(*sorted({c for s in class_sets for c in s})))


def split_classes(classes: Column) -> Column:
    """Selected classes split into the ground base and the re-injected rest."""
    ground = F.array(*[F.lit(c) for c in GROUND_CLASSES])
    return F.struct(
        F.array_sort(F.array_intersect(classes, ground)).alias("base"),
        F.array_sort(F.array_except(classes, ground)).alias("reinjected"),
    )


# -- grids ----------------------------------------------------------------------------------------

def nominal_grid(bounds: Column, res) -> Column:
    """Grid of nominal bounds: cell counts rounded, at least one."""
    res = _c(res)
    return F.struct(
        bounds.x0.alias("x0"), bounds.y0.alias("y0"), bounds.x1.alias("x1"), bounds.y1.alias("y1"),
        F.greatest(F.lit(1), F.bround((bounds.x1 - bounds.x0) / res, 0).cast("int")).alias("nx"),
        F.greatest(F.lit(1), F.bround((bounds.y1 - bounds.y0) / res, 0).cast("int")).alias("ny"),
    )


def extent_grid(points: DataFrame, res: float) -> DataFrame:
    """Grid of every cloud from its own data; the top edge is moved onto the grid."""
    limits = points.groupBy("cloud_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y_max"))
    return limits.select(
        "cloud_id", "x0", "y0", "x1",
        (F.floor((F.col("x1") - F.col("x0")) / res) + 1).cast("int").alias("nx"),
        (F.floor((F.col("y_max") - F.col("y0")) / res) + 1).cast("int").alias("ny"),
    ).withColumn("y1", F.col("y0") + F.col("ny") * F.lit(float(res)))


def cell_in_grid(x, y, grid: Column, res) -> Column:
    """Row and column inside a local grid, truncated and kept within its edges."""
    res = _c(res)

    def clamp(value, count):
        return F.greatest(F.lit(0), F.least(value.cast("int"), count - 1))

    return F.struct(
        clamp((grid.y1 - _c(y)) / res, grid.ny).alias("row"), clamp((_c(x) - grid.x0) / res, grid.nx).alias("col"))


def address(points: DataFrame, grid: Grid) -> DataFrame:
    return points.withColumn("row", grid.row()).withColumn("col", grid.col())


def _raster(area: str | None) -> Column:
    """The raster a point belongs to: the value of its area column, or one raster for all points."""
    return (F.lit("all") if area is None else F.col(area).cast("string")).alias("raster_id")


def tile_blocks(points: DataFrame, grid: Grid, side: int = BLOCK, area: str | None = None) -> DataFrame:
    """Blocks of every nominal tile that holds at least one point: the area a model must fill."""
    return _blocks_of_tiles(points.select(_raster(area), grid.row().alias("row"), grid.col().alias("col")), grid, side)


def _per_tile(grid: Grid, side: int) -> int:
    """Blocks along a side of a nominal tile."""
    if side < 1 or grid.tile_cells % side:
        raise ValueError(f"the block side must divide the tile side: {side}, {grid.tile_cells}")
    return grid.tile_cells // side


def _blocks_of_tiles(cells: DataFrame, grid: Grid, side: int) -> DataFrame:
    """All blocks of the nominal tiles that hold at least one of the cells; the tiles are found once, by key."""
    per_tile = _per_tile(grid, side)
    tiles = cells.select(
        "raster_id", floor_long(F.col("row") / F.lit(grid.tile_cells)).alias("ty"), floor_long(F.col("col") / F.lit(grid.tile_cells)).alias("tx")).distinct()
    steps = F.sequence(F.lit(0), F.lit(per_tile - 1))
    return (
        tiles.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
        .select("raster_id", (F.col("ty") * per_tile + F.col("dr")).alias("brow"),
                (F.col("tx") * per_tile + F.col("dc")).alias("bcol"))
    )


# -- binning --------------------------------------------------------------------------------------

def bin_min(points: DataFrame, grid: Grid, class_sets: dict[str, Sequence[int]],
            maxima: dict[str, Sequence[int]] | None = None, area: str | None = None) -> DataFrame:
    """Minimum height per cell for several class sets at once (and maxima): one scan, one aggregate.

    ``area`` names a column (product, chunk); each of its values becomes a raster of its own.

    The minimum is combined before the shuffle, so a cell with very many points costs nothing extra.
    """
    def of(classes):
        return F.when(F.col("cls").isin(*classes), F.col("z"))

    aggregates = [F.min(of(c)).alias(n) for n, c in class_sets.items()]
    aggregates += [F.max(of(c)).alias(n) for n, c in (maxima or {}).items()]
    names = [*class_sets, *(maxima or {})]
    cells = keep_classes(points, *class_sets.values()).select(_raster(area), grid.cell().alias("cell"), "z", "cls").groupBy("raster_id", "cell").agg(*aggregates)
    return cells.select("raster_id", key_row().alias("row"), key_col().alias("col"), *names)


def ground_or_all(points: DataFrame, classes: Sequence[int] = (2,), minimum: int = 100) -> DataFrame:
    """Ground points of every cloud, or all its points where fewer than ``minimum`` are ground.

    Ground points never meet a join.  Only the others are matched with the clouds that lack ground,
    and those are rare, so the runtime filter of the join keeps nearly all of them out of the shuffle.
    """
    ground = F.col("cls").isin(*classes)
    poor = points.groupBy("cloud_id").agg(F.count_if(ground).alias("n")).filter(F.col("n") < minimum).select("cloud_id")
    rest = points.filter(~ground).join(poor, "cloud_id", "left_semi")
    return points.filter(ground).unionByName(rest.select(*points.columns))


def canopy_prefilter(points: DataFrame, grid: Grid, above_m: float = 3.5, area: str | None = None) -> DataFrame:
    """Points at most ``above_m`` over the lowest point of their (coarse) cell, within their own area.

    Aggregate and join instead of a window: the minimum combines before the shuffle and adaptive
    execution may split a hot cell in the join.
    """
    addressed = points.select("*", _raster(area).alias("_raster"), grid.cell().alias("_cell"))
    floor_z = addressed.groupBy("_raster", "_cell").agg(F.min("z").alias("_floor"))
    return (
        addressed.join(floor_z, ["_raster", "_cell"])
        .filter(F.col("z") <= F.col("_floor") + F.lit(above_m)).select(*[F.col(f"`{c}`") for c in points.columns])
    )


# -- models ---------------------------------------------------------------------------------------

def fill_cells(cells: DataFrame, value: str, domain: DataFrame, reach_cells: int, side: int = BLOCK) -> DataFrame:
    """Bounded hole fill over the blocks of ``domain``; cells out of reach stay unknown."""
    dense = fill_domain(cells_to_blocks(cells, [value], side), domain, [value], side)
    return blocks_to_cells(fill.fill_holes(dense, value, reach_cells, side, source="keyed"), [value], side)


def dtm_blocks(points: DataFrame, grid: Grid, classes: Sequence[int] = (2,), max_fill_m: float = 100.0,
               side: int = BLOCK, minimum: int | None = 100, area: str | None = None) -> DataFrame:
    """Bare-earth model as blocks with band ``z``, filled over every nominal tile that holds ground.

    ``minimum`` is the number of ground points below which a cloud counts as unclassified and gives
    all its points; None skips that check and its scan.  ``area`` names a column whose values are models
    of their own: nothing is filled, and later nothing stretched, across them.
    """
    used = points.filter(F.col("cls").isin(*classes)) if minimum is None else ground_or_all(points, classes, minimum)
    lowest = used.select(_raster(area), grid.cell().alias("cell"), "z").groupBy("raster_id", "cell").agg(F.min("z").alias("z"))
    cells = lowest.select("raster_id", key_row().alias("row"), key_col().alias("col"), "z")
    return fill.fill_holes(cells, "z", int(max_fill_m / grid.res), side, per_tile=_per_tile(grid, side), source="cells")


def points_to_dtm(points: DataFrame, grid: Grid, classes: Sequence[int] = (2,), max_fill_m: float = 100.0,
                  side: int = BLOCK, minimum: int | None = 100, area: str | None = None) -> DataFrame:
    """Bare-earth model: ``raster_id, row, col, z``."""
    return blocks_to_cells(dtm_blocks(points, grid, classes, max_fill_m, side, minimum, area), ["z"], side)


def feature_blocks(points: DataFrame, grid: Grid, hmin: float = HEIGHT_MIN, hmax: float = HEIGHT_MAX,
                   classes_low: Sequence[int] = LOW_CLASSES, classes_ground: Sequence[int] = GROUND_CLASSES,
                   ref_ground: Sequence[int] = REFERENCE_CLASSES, max_fill_m: float = 200.0,
                   side: int = BLOCK, area: str | None = None) -> DataFrame:
    """Blocks with bands ``z_ref`` (filled reference ground), ``z_ground`` (raw) and ``z_low``.

    ``z_low`` is the lowest point of the height band in cells without ground.  One aggregate feeds all
    bands and decides most cells alone: when the lowest low-class point of a cell lies in the band it is
    the answer, when it lies above or the highest lies below there is none.  Only the cells in between
    go back to their points.  That join carries a small salt on both sides: the following per-cell
    minimum then shuffles anyway, which lets adaptive execution split a cell that holds a large share
    of the points.
    """
    useful = drop_noise(points)
    low, ground = list(classes_low), list(classes_ground) or [-1]
    bands = ("z_ref", "z_ground", "z_first", "z_last")
    raw = bin_min(useful, grid, {"z_ref": ref_ground, "z_ground": ground, "z_first": low}, {"z_last": low}, area)
    blocks = fill.fill_holes(raw, "z_ref", int(max_fill_m / grid.res), side, keep=bands[1:], per_tile=_per_tile(grid, side), source="cells")
    return _reinjected(blocks, keep_classes(useful, low), grid, hmin, hmax, side, area).select(*KEYS, "z_ref", "z_ground", "z_low")


def _reinjected(blocks: DataFrame, low: DataFrame, grid: Grid, hmin: float, hmax: float, side: int, area: str | None, carry: Sequence[str] = ()) -> DataFrame:
    """Blocks with ``z_ref, z_ground, z_low`` and the bands of ``carry`` from those with ``z_ref, z_ground, z_first, z_last``.

    ``low`` are the points that may be put back.
    """
    def in_band(height):
        return (height >= hmin) & (height <= hmax)

    salts = 4
    bands = ("z_ref", "z_ground", "z_first", "z_last")
    reference, first, last = F.col("z_ref"), F.col("z_first"), F.col("z_last")
    undecided = (
        blocks_to_cells(blocks, bands, side)
        .filter(F.col("z_ground").isNull() & (first - reference < hmin) & (last - reference >= hmin))
        .select("raster_id", cell_key("row", "col").alias("cell"), "z_ref", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    candidates = low.select(_raster(area), grid.cell().alias("cell"), "z", F.pmod(F.hash("z"), F.lit(salts)).alias("salt"))
    found = (
        candidates.join(undecided.hint("shuffle_hash"), ["raster_id", "cell", "salt"])
        .filter(in_band(F.col("z") - reference)).groupBy("raster_id", "cell").agg(F.min("z").alias("z_found"))
        .select("raster_id", key_row().alias("row"), key_col().alias("col"), "z_found")
    )
    joined = fill_domain(
        cells_to_blocks(found, ["z_found"], side), blocks, ["z_found"], side, carry=("z_ref", "z_ground", "z_first", *carry))
    decided = F.transform(
        F.arrays_zip("z_ref", "z_ground", "z_first", "z_found"),
        lambda v: F.when(v.z_ground.isNull(), F.when(in_band(v.z_first - v.z_ref), v.z_first).otherwise(v.z_found)))
    return joined.select(*KEYS, "z_ref", "z_ground", decided.alias("z_low"), *carry)


def both_models(points: DataFrame, grid: Grid, side: int = BLOCK, hmin: float = HEIGHT_MIN, hmax: float = HEIGHT_MAX,
                classes_low: Sequence[int] = LOW_CLASSES, classes_ground: Sequence[int] = GROUND_CLASSES, ref_ground: Sequence[int] = REFERENCE_CLASSES,
                feature_fill_m: float = 200.0, bare_fill_m: float = 100.0, area: str | None = None) -> DataFrame:
    """Feature model and bare-earth model as blocks with the bands ``z_feature`` and ``z_bare``, from one binning.

    One aggregate gives the cells of both models (withheld points count for bare earth only, as in ``dtm_blocks`` without
    a check for clouds without ground), one exchange fills both with their own reach, and the last fill carries the bare model along.
    Tiles that hold a point of either model are filled.
    """
    clean = ~F.col("cls").isin(*NOISE_CLASSES) & ~F.coalesce(F.col("withheld"), F.lit(False))

    def of(classes: Sequence[int], condition: Column = F.lit(True)) -> Column:
        return F.when(F.col("cls").isin(*classes) & condition, F.col("z"))

    low, ground, per_tile = list(classes_low), list(classes_ground), _per_tile(grid, side)
    used = points.filter((F.col("cls").isin(*sorted({*low, *ground, *ref_ground})) & clean) | F.col("cls").isin(*ground))
    bands = ("z_ref", "z_bare", "z_ground", "z_first", "z_last")
    raw = used.select(_raster(area), grid.cell().alias("cell"), "z", "cls", "withheld").groupBy("raster_id", "cell").agg(
        F.min(of(ref_ground, clean)).alias("z_ref"), F.min(of(ground)).alias("z_bare"), F.min(of(ground, clean)).alias("z_ground"),
        F.min(of(low, clean)).alias("z_first"), F.max(of(low, clean)).alias("z_last"))
    cells = raw.select("raster_id", key_row().alias("row"), key_col().alias("col"), *bands)
    wide, narrow = int(feature_fill_m / grid.res), int(bare_fill_m / grid.res)
    blocks = fill.fill_holes(cells, {"z_ref": wide, "z_bare": narrow}, side=side, keep=bands[2:], per_tile=per_tile, source="cells")
    decided = _reinjected(blocks, keep_classes(drop_noise(points), low), grid, hmin, hmax, side, area, carry=("z_bare",))
    model = decided.select(*KEYS, F.zip_with("z_ground", "z_low", lambda g, low: F.coalesce(g, low)).alias("z_feature"), "z_bare")
    return fill.fill_holes(model, {"z_feature": wide}, side=side, keep=["z_bare"], source="keyed")


def points_to_dfm(points: DataFrame, grid: Grid, side: int = BLOCK, max_fill_m: float = 200.0, **settings) -> DataFrame:
    """Feature model ``raster_id, row, col, z``: ground, with low standing objects in its holes.

    Without ground classes the result is a slice: the objects alone, everything else unknown.
    """
    return blocks_to_cells(dfm_blocks(points, grid, side, max_fill_m, **settings), ["z"], side)


def dfm_blocks(points: DataFrame, grid: Grid, side: int = BLOCK, max_fill_m: float = 200.0, **settings) -> DataFrame:
    """The feature model as blocks with band ``z``."""
    bands = feature_blocks(points, grid, max_fill_m=max_fill_m, side=side, **settings)
    model = bands.select(*KEYS, F.zip_with("z_ground", "z_low", lambda g, low: F.coalesce(g, low)).alias("z"))
    if "classes_ground" in settings and not list(settings["classes_ground"]):
        return model
    return fill.fill_holes(model, "z", int(max_fill_m / grid.res), side, source="keyed")


def height_above_ground(points: DataFrame, ground: DataFrame, grid: Grid, side: int = BLOCK, area: str | None = None) -> DataFrame:
    """Points with ``row, col, z_ground`` and ``h``, their height over the filled ground cell below them.

    ``ground`` are blocks with band ``z`` (``dtm_blocks``).  With ``area`` a point is measured against the ground of its own
    area only.  Points over unknown ground are left out.
    """
    placed = points.select("*", _raster(area), grid.row().alias("row"), grid.col().alias("col"))
    found = at_cells(placed, ground.select(*KEYS, F.col("z").alias("z_ground")), "z_ground", side).filter(F.col("z_ground").isNotNull())
    return found.withColumn("h", F.col("z") - F.col("z_ground"))


def height_band(points: DataFrame, hmin: float = HEIGHT_MIN, hmax: float = HEIGHT_MAX,
                classes: Sequence[int] = LOW_CLASSES) -> DataFrame:
    return points.filter(F.col("cls").isin(*classes) & (F.col("h") >= hmin) & (F.col("h") <= hmax))


def model_difference(feature: DataFrame, bare: DataFrame, threshold_m: float | None = None) -> DataFrame:
    """Feature model minus bare-earth model per cell, optionally only the cells above a threshold."""
    both = feature.select("raster_id", "row", "col", F.col("z").alias("z_feature")).join(
        bare.select("raster_id", "row", "col", F.col("z").alias("z_bare")), ["raster_id", "row", "col"])
    delta = both.withColumn("delta", F.col("z_feature") - F.col("z_bare"))
    return delta if threshold_m is None else delta.filter(F.col("delta") > F.lit(float(threshold_m)))


def block_difference(feature: DataFrame, bare: DataFrame, threshold_m: float, side: int = BLOCK) -> DataFrame:
    """``model_difference`` of two models as blocks: they meet block by block, and only cells above the threshold become rows."""
    both = feature.select(*KEYS, F.col("z").alias("z_feature")).join(bare.select(*KEYS, F.col("z").alias("z_bare")), list(KEYS))
    return standing_out(both, threshold_m, side)


def standing_out(both: DataFrame, threshold_m: float, side: int = BLOCK) -> DataFrame:
    """Cells of blocks with ``z_feature`` and ``z_bare`` whose ``delta`` is above the threshold."""
    delta = F.zip_with("z_feature", "z_bare", lambda a, b: F.when(a - b > F.lit(float(threshold_m)), a - b))
    # all bands are empty but where the difference stands out
    out = both.withColumn("delta", delta).filter(F.exists("delta", lambda d: d.isNotNull()))
    return blocks_to_cells(out, ["z_feature", "z_bare", "delta"], side).filter(F.col("delta").isNotNull())


def class_histogram(points: DataFrame, area_m2: float | None = None) -> DataFrame:
    """Points and height range per cloud and class, with the density when the area is known."""
    counts = points.groupBy("cloud_id", "cls").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return counts if area_m2 is None else counts.withColumn("density", F.col("n_points") / F.lit(float(area_m2)))


def largest_member(members: DataFrame) -> DataFrame:
    """Largest cloud of every archive and how many others were left out."""
    return members.groupBy("archive").agg(
        F.max_by("member", F.struct("size", "member")).alias("member"),
        F.max("size").alias("size"), (F.count(F.lit(1)) - 1).alias("n_left_out"))


# -- text grids -----------------------------------------------------------------------------------

def smallest_gap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest difference between neighbouring distinct values per key: ``key, gap``.

    Values are range-partitioned by key and value and compared inside each partition; only the ends of
    each partition's run meet again, so a key with very many values stays spread.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)[key]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {}
        for part in batches:
            for name, values in part.groupby(key, sort=False)[value]:
                v = values.to_numpy()
                first, last, gap = found.get(name, (v[0], None, np.inf))
                ordered = v if last is None else np.concatenate([[last], v])
                if len(ordered) > 1:
                    gap = min(gap, np.diff(ordered).min())
                found[name] = (first, v[-1], gap)
        yield pd.DataFrame([(k, *v) for k, v in found.items()], columns=[key, "first", "last", "gap"])

    ranged = rows.select(key, F.col(value).cast("double").alias(value)).distinct().repartitionByRange(
        width, key, value).sortWithinPartitions(key, value)
    pieces = ranged.mapInPandas(runs, f"{key} {kind}, first double, last double, gap double")
    # one row per key and partition
    before = F.lag("last").over(Window.partitionBy(key).orderBy("first"))
    return pieces.withColumn("gap", F.least("gap", F.col("first") - before)).groupBy(key).agg(F.min("gap").alias("gap")).filter(
        F.col("gap") < float("inf"))


def grid_from_text(points: DataFrame) -> DataFrame:
    """Cells of regular text grids: per file the smallest gap between x values is the resolution.

    Input ``cloud_id, x, y, z, line_no``; the last line wins where a cell occurs twice.
    """
    res = smallest_gap(points, "cloud_id", "x").withColumnRenamed("gap", "res")
    limits = points.groupBy("cloud_id").agg(F.min("x").alias("x_min"), F.max("y").alias("y_max"))
    return (
        points.join(limits.join(res, "cloud_id"), "cloud_id")
        .select(
            "cloud_id",
            F.rint((F.col("y_max") - F.col("y")) / F.col("res")).cast("bigint").alias("row"),
            F.rint((F.col("x") - F.col("x_min")) / F.col("res")).cast("bigint").alias("col"),
            "z", "line_no", "res", (F.col("x_min") - F.col("res") / 2).alias("left"),
            (F.col("y_max") + F.col("res") / 2).alias("top"))
        .groupBy("cloud_id", "row", "col")
        .agg(F.max_by("z", "line_no").alias("z"), F.first("res").alias("res"), F.first("left").alias("left"),
             F.first("top").alias("top"))
    )


# -- settings and names ---------------------------------------------------------------------------

def check_settings(ground: str = "classes", hmin: float = HEIGHT_MIN, hmax: float = HEIGHT_MAX,
                   classes: Sequence[int] = DEFAULT_CLASSES, threshold: float = 0.5, resolution: float = 0.5,
                   rigidness: int = 1) -> dict:
    """Settings rounded to decimetres; raises on values out of range."""
    if ground not in ("classes", "csf"):
        raise ValueError(f"ground method {ground!r} is neither 'classes' nor 'csf'")
    settings = {
        "ground": ground, "hmin": round(float(hmin), 1), "hmax": round(float(hmax), 1),
        "classes": tuple(sorted(int(c) for c in classes)), "threshold": round(float(threshold), 1),
        "resolution": round(float(resolution), 1), "rigidness": int(rigidness)}
    for name in ("threshold", "resolution"):
        if not math.isfinite(settings[name]) or not 0.1 <= settings[name] <= 3.0:
            raise ValueError(f"{name} must lie within 0.1 and 3.0 m")
    if settings["rigidness"] not in (1, 2, 3):
        raise ValueError("rigidness must be 1, 2 or 3")
    if not settings["hmin"] < settings["hmax"]:
        raise ValueError("hmin must be smaller than hmax")
    return settings


def settings_problem(hmin, hmax, threshold, resolution, rigidness) -> Column:
    """Name of the first setting out of range, or NULL (settings rounded to decimetres)."""
    hmin, hmax = F.bround(_c(hmin), 1), F.bround(_c(hmax), 1)
    threshold, resolution = F.bround(_c(threshold), 1), F.bround(_c(resolution), 1)
    return (
        F.when(~threshold.between(0.1, 3.0), "threshold")
        .when(~resolution.between(0.1, 3.0), "resolution")
        .when(~_c(rigidness).isin(1, 2, 3), "rigidness")
        .when(hmin >= hmax, "height band")
    )


def _tenths(value: Column) -> Column:
    return F.lpad(F.bround(value * 10.0, 0).cast("int").cast("string"), 2, "0")


def variant_tag(ground, hmin, hmax, classes, threshold, resolution, rigidness,
                default_classes: Sequence[int] = DEFAULT_CLASSES) -> Column:
    """Method and every setting off its default, in fixed order: equal tags mean equal products."""
    hmin, hmax, classes = _c(hmin), _c(hmax), F.array_sort(_c(classes))
    threshold, resolution, rigidness = _c(threshold), _c(resolution), _c(rigidness)
    usual = F.array(*[F.lit(c) for c in sorted(default_classes)])
    cloth = F.concat_ws(
        "_", F.lit("laz_csf"),
        F.when(threshold != CLOTH_DEFAULTS["threshold"], F.concat(F.lit("t"), _tenths(threshold))),
        F.when(resolution != CLOTH_DEFAULTS["resolution"], F.concat(F.lit("r"), _tenths(resolution))),
        F.when(rigidness != CLOTH_DEFAULTS["rigidness"], F.concat(F.lit("g"), rigidness.cast("string"))))
    feature = F.concat_ws(
        "_", F.lit("laz_dfm"),
        F.when((hmin != HEIGHT_MIN) | (hmax != HEIGHT_MAX),
               F.concat(F.lit("h"), _tenths(hmin), F.lit("-"), _tenths(hmax))),
        F.when(classes != usual, F.concat(F.lit("c"), F.concat_ws("-", classes.cast("array<string>")))))
    return F.when(_c(ground) == "csf", cloth).otherwise(feature)
