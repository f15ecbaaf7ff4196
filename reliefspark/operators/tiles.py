"""Map-tile operators: packing, pyramids, formats, splitting, answer gates.

Tiles: ``zoom, x, y, data``; ``y`` counts from the north unless a function says otherwise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.functions.geo import _c, floor_long
from reliefspark.operators.blocks import exchange

TILE = 256

# Leading bytes of the payload types.
MAGIC = {
    "tiff": ("49492A00", "4D4D002A"), "las": ("4C415346",), "zip": ("504B",), "png": ("89504E47",),
    "jpeg": ("FFD8FF",), "gif": ("474946",),
}
IMAGE_KINDS = ("tiff", "png", "jpeg", "gif", "webp")
SMALL_PAYLOAD = 500
SPARSE_LIMIT = 50
PNG_PRODUCTS = ("svf", "opos", "oneg", "vat")


# -- payloads and answers -------------------------------------------------------------------------

def payload_kind(content) -> Column:
    """Type of a payload by its first bytes, 'other' when none fits."""
    head = F.hex(F.substring(_c(content), 1, 12))
    result = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for kind, starts in MAGIC.items():
        for start in starts:
            result = result.when(head.startswith(start), kind)
    return result.otherwise("other")


def answer_class(status, content_type, content, length=None) -> Column:
    """'data', 'absent' or 'error' for one tile answer.

    Recognised images are data whatever their size; service documents and server errors are errors;
    404, 204 and small unknown payloads mean there is no tile.
    """
    status, content_type = _c(status), F.lower(F.coalesce(_c(content_type), F.lit("")))
    length = F.length(_c(content)) if length is None else _c(length)
    text = F.trim(F.decode(F.substring(_c(content), 1, 64), "ISO-8859-1"))
    document = text.startswith("<") | text.startswith("{")
    service = content_type.rlike("xml|html|json") & ~content_type.startswith("multipart/")
    return (
        F.when(status.isin(404, 204), "absent")
        .when(status != 200, "error")
        .when(payload_kind(content).isin(*IMAGE_KINDS), "data")
        .when(service | document, "error")
        .when(length < SMALL_PAYLOAD, "absent")
        .otherwise("error")
    )


def promised_answer(answer, discover_exact) -> Column:
    """An absent tile is an error when an index promised it, plain absence on a synthetic grid."""
    return F.when((_c(answer) == "absent") & _c(discover_exact), "error").otherwise(_c(answer))


def publish_gate(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """Verdict per product: any error blocks it, nothing but absence means out of coverage."""
    n = {a: F.count_if(F.col(answer) == a) for a in ("data", "absent", "error")}
    counts = answers.groupBy(key).agg(*[c.alias(f"n_{a}") for a, c in n.items()])
    return counts.withColumn(
        "verdict", F.when(F.col("n_error") > 0, "blocked").when(F.col("n_data") == 0, "out of coverage").otherwise("publish"))


def cache_namespace(endpoint, layer, style, image_format) -> Column:
    """Folder of a tile cache: differs whenever endpoint, layer, style or format differ."""
    return F.substring(F.sha2(F.concat_ws("|", _c(endpoint), _c(layer), _c(style), _c(image_format)), 256), 1, 16)


# -- addresses and packing ------------------------------------------------------------------------

def pixel_tiles(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Tiles from global Mercator pixels ``zoom, prow, pcol, value``: one row per non-empty tile.

    ``filled`` counts known pixels (value above 0).  Pixels are put together per Arrow batch before the shuffle, three
    bytes each: pixels that come in the order of their tiles cost one row a batch, those in any order one row each.
    """
    kinds = pa.schema([("zoom", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("slots", pa.binary()), ("grey", pa.binary())])
    slots = pixels.filter(F.col(value) > 0).select(
        F.col("zoom").cast("int").alias("zoom"), floor_long(F.col("pcol") / F.lit(TILE)).alias("x"), floor_long(F.col("prow") / F.lit(TILE)).alias("y"),
        (F.pmod("prow", F.lit(TILE)) * TILE + F.pmod("pcol", F.lit(TILE))).cast("int").alias("slot"),
        F.col(value).cast("int").alias("v"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zoom, x, y, slot, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(slot):
                continue
            order = np.lexsort((y, x, zoom))
            zoom, x, y = zoom[order], x[order], y[order]
            slot, v = slot[order].astype("<u2"), v[order].astype(np.uint8)
            starts = np.flatnonzero(np.r_[True, (zoom[1:] != zoom[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            ends = np.r_[starts[1:], len(slot)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(zoom[starts], pa.int32()), pa.array(x[starts], pa.int64()), pa.array(y[starts], pa.int64()),
                 pa.array([slot[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                 pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], schema=kinds)

    def pack(key, parts):
        image, filled = np.zeros(TILE * TILE, dtype=np.uint8), 0
        for at, grey in zip(parts.column("slots").to_pylist(), parts.column("grey").to_pylist()):
            image[np.frombuffer(at, "<u2")] = np.frombuffer(grey, np.uint8)
            filled += len(grey)
        return pa.table({
            "zoom": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([key[1].as_py()], pa.int64()), "y": pa.array([key[2].as_py()], pa.int64()),
            "pixels": pa.array([image.tobytes()], pa.binary()), "filled": pa.array([filled], pa.int32())})

    return slots.mapInArrow(gather, "zoom int, x bigint, y bigint, slots binary, grey binary").groupBy("zoom", "x", "y").applyInArrow(
        pack, "zoom int, x bigint, y bigint, pixels binary, filled int")


def block_tiles(blocks: DataFrame, band: str, zoom: int | Column) -> DataFrame:
    """Tiles from blocks of 256 x 256 global Mercator pixels: a block is a tile, so nothing is shuffled."""
    zoom = F.lit(zoom) if isinstance(zoom, int) else zoom

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, filled = [], []
            for values in batch.column(3):
                image = np.nan_to_num(values.values.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.uint8)
                images.append(image.tobytes())
                filled.append(int((image > 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(images, pa.binary()), pa.array(filled, pa.int32())],
                names=["zoom", "x", "y", "pixels", "filled"])

    rows = blocks.select(zoom.cast("int").alias("zoom"), F.col("bcol").alias("x"), F.col("brow").alias("y"), F.col(band))
    return rows.mapInArrow(pack, "zoom int, x bigint, y bigint, pixels binary, filled int").filter("filled > 0")


def tile_summary(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Per tile the number of known pixels and whether it is full; tiles without data are absent."""
    return (
        pixels.filter(F.col(value) > 0)
        .groupBy("zoom", floor_long(F.col("pcol") / F.lit(TILE)).alias("x"), floor_long(F.col("prow") / F.lit(TILE)).alias("y"))
        .agg(F.count(F.lit(1)).alias("filled"))
        .withColumn("interior", F.col("filled") == TILE * TILE)
    )


def require_bytes(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Fails on the first value that is no whole number within 0..255 (raw heights, for instance)."""
    v = F.col(value)
    fits = (v >= 0) & (v <= 255) & (v == F.floor(v))
    return pixels.filter(F.when(F.coalesce(fits, F.lit(True)), True).otherwise(
        F.raise_error(F.lit("pixel values must be bytes")).cast("boolean")))


def byte_verdict(value) -> Column:
    v = _c(value)
    return F.when((v >= 0) & (v <= 255) & (v == F.floor(v)), "ok").otherwise("refused")


# -- formats --------------------------------------------------------------------------------------

def base_format(product, requested) -> Column:
    """Format of interior tiles: the requested one, or by product where it is left open."""
    product = F.lower(_c(product))
    as_png = F.lit(False)
    for kind in PNG_PRODUCTS:
        as_png = as_png | product.contains(kind)
    return F.when(_c(requested).isin("png", "jpeg"), _c(requested)).when(as_png, "png").otherwise("jpeg")


def set_format(tiles: DataFrame, key: str) -> DataFrame:
    """Format a set declares: png as soon as one tile is, since edge tiles carry transparency."""
    return tiles.groupBy(key).agg(
        F.when(F.bool_or(F.col("format") == "png"), "png").otherwise("jpeg").alias("format"),
        F.count_if(F.col("format") == "png").alias("n_png"), F.count_if(F.col("format") == "jpeg").alias("n_jpeg"))


def convert_quality(source_format, requested, quality) -> Column:
    """JPEG quality to convert with, NULL when tiles are kept as delivered."""
    return F.when((_c(source_format) == "image/png") & _c(requested).isin("auto", "jpeg"), _c(quality).cast("int"))


def set_name(area, layer, zoom_min, zoom_max, quality) -> Column:
    return F.concat(_c(area), F.lit("_"), _c(layer), F.lit("_z"), _c(zoom_min).cast("string"), F.lit("-"),
                    _c(zoom_max).cast("string"),
                    F.coalesce(F.concat(F.lit("_q"), _c(quality).cast("int").cast("string")), F.lit("")))


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of one image, grey (h, w), or with channels (h, w, 2|3|4)."""
    height, width = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    raw = np.zeros((height, 1 + width * channels), dtype=np.uint8)
    raw[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6))
            + chunk(b"IEND", b""))


def png_tiles(tiles: DataFrame) -> DataFrame:
    """``pixels`` encoded as PNG in ``data``; tiles that are not full carry an alpha channel."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            images = []
            for body, filled in zip(part["pixels"], part["filled"]):
                grey = np.frombuffer(body, dtype=np.uint8).reshape(TILE, TILE)
                if filled < TILE * TILE:
                    grey = np.dstack([grey, np.where(grey > 0, 255, 0).astype(np.uint8)])
                images.append(encode_png(grey))
            yield part[["zoom", "x", "y", "filled"]].assign(data=images)

    return tiles.select("zoom", "x", "y", "pixels", "filled").mapInPandas(
        encode, "zoom int, x bigint, y bigint, filled int, data binary")


# -- pyramids -------------------------------------------------------------------------------------

def overview_factors(zoom_min, zoom_max) -> Column:
    levels = _c(zoom_max) - _c(zoom_min)
    return F.when(levels > 0, F.transform(
        F.sequence(F.lit(1), levels.cast("int")), lambda i: geo.pow2(i))).otherwise(F.array().cast("array<bigint>"))


def reduce_once(blocks: DataFrame, band: str = "v", side: int = TILE) -> DataFrame:
    """Half-resolution blocks: 3x3 weights 1-2-1 around the odd cell of each 2x2 group, known cells only.

    Every block goes to its parent; its first row and column also go to the parent before it, which
    reads one cell further.  Zero means unknown and stays zero where nothing is known.
    """
    half = side // 2

    def send(brow, bcol, arrays):
        v = arrays[0]
        parent_row, parent_col = brow // 2, bcol // 2
        odd_row, odd_col = brow % 2, bcol % 2
        yield parent_row, parent_col, odd_row * 3 + odd_col, v
        if odd_row == 0:
            yield parent_row - 1, parent_col, 6 + odd_col, v[:1]
        if odd_col == 0:
            yield parent_row, parent_col - 1, odd_row * 3 + 2, v[:, :1]
        if odd_row == 0 and odd_col == 0:
            yield parent_row - 1, parent_col - 1, 8, v[:1, :1]

    def combine(brow, bcol, parts):
        if not any(p in parts for p in (0, 1, 3, 4)):
            return None
        v = np.zeros((2 * side + 1, 2 * side + 1))
        starts, sizes = (0, side, 2 * side), (side, side, 1)
        for part, values in parts.items():
            i, j = divmod(part, 3)
            v[starts[i]:starts[i] + sizes[i], starts[j]:starts[j] + sizes[j]] = np.nan_to_num(
                values.reshape(sizes[i], sizes[j]))
        known = (v > 0).astype(float)

        def three(a, axis):
            index = np.arange(0, 2 * side, 2)
            return np.take(a, index, axis) + 2.0 * np.take(a, index + 1, axis) + np.take(a, index + 2, axis)

        total, weight = three(three(v, 1), 0), three(three(known, 1), 0)
        mean = np.floor(np.divide(total, weight, out=np.zeros_like(total), where=weight > 0) + 0.5)
        return {band: mean} if (mean > 0).any() else None

    assert half * 2 == side
    return exchange(blocks, [band], send, combine, {band: "double"}, side)


def pyramid(blocks: DataFrame, zoom_min: int, zoom_max: int, band: str = "v", side: int = TILE) -> DataFrame:
    """Blocks of every zoom from ``zoom_max`` (given) down to ``zoom_min``, with a ``zoom`` column.

    Every level reads the one above it: to publish a deep pyramid write each level and read it back
    (or checkpoint), so a lost executor does not recompute the whole chain.
    """
    level = blocks
    result = level.withColumn("zoom", F.lit(zoom_max))
    for zoom in range(zoom_max - 1, zoom_min - 1, -1):
        level = reduce_once(level, band, side)
        result = result.unionByName(level.withColumn("zoom", F.lit(zoom)))
    return result


# -- tile sets ------------------------------------------------------------------------------------

def to_sqlitedb(tiles: DataFrame) -> DataFrame:
    """Layout ``x, y, z, s, image`` with rows from the north, out of rows from the south."""
    return tiles.select(
        F.col("col").alias("x"), geo.flip_row("row", "zoom").alias("y"), F.col("zoom").alias("z"),
        F.lit(0).alias("s"), F.col("data").alias("image"))


def sqlitedb_info(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.min("zoom").alias("minzoom"), F.max("zoom").alias("maxzoom")).withColumn(
        "tilenumbering", F.lit("simple"))


def zoom_range(tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """Zoom range per set: from the metadata, else from the tiles."""
    seen = tiles.groupBy("set_id").agg(F.min("zoom").alias("tile_min"), F.max("zoom").alias("tile_max"))
    return seen.join(meta, "set_id", "left").select(
        "set_id", F.coalesce("minzoom", "tile_min").alias("minzoom"), F.coalesce("maxzoom", "tile_max").alias("maxzoom"))


def set_bounds(tiles: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Bounds of every set from its highest zoom alone (rows from the north)."""
    corner = tiles.groupBy(*keys, "zoom").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    top = corner.groupBy(*keys).agg(F.max("zoom").alias("zoom"))
    deep = corner.join(top, [*keys, "zoom"])
    return deep.select(
        *keys, "zoom", geo.tile_lon("x0", "zoom").alias("west"), geo.tile_lat(F.col("y1") + 1, "zoom").alias("south"),
        geo.tile_lon(F.col("x1") + 1, "zoom").alias("east"), geo.tile_lat("y0", "zoom").alias("north"))


def split_set(tiles: DataFrame, n_cols: int, n_rows: int) -> DataFrame:
    """Tiles with ``part_row, part_col``: an even grid over the highest zoom of each set.

    A tile of a lower zoom goes to every part it touches.  The parts a tile meets follow from its
    address, so the tile is multiplied directly instead of being joined with all parts.
    """
    corner = tiles.groupBy("set_id", "zoom").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    top = corner.groupBy("set_id").agg(F.max_by(F.struct("zoom", "min_x", "max_x", "min_y", "max_y"), "zoom").alias("t"))
    top = top.select("set_id", F.col("t.zoom").alias("top"), "t.min_x", "t.max_x", "t.min_y", "t.max_y")

    def parts(tile, low, high, count):
        span = geo.pow2(F.col("top") - F.col("zoom"))
        first, last = F.col(tile) * span, (F.col(tile) + 1) * span - 1
        width = F.col(high) - F.col(low) + 1

        def part_of(position):
            inside = F.greatest(F.col(low), F.least(F.col(high), position)) - F.col(low)
            return floor_long(inside * count / width)

        return F.sequence(part_of(first), part_of(last))

    return (
        tiles.join(top, "set_id")
        .withColumn("part_col", F.explode(parts("x", "min_x", "max_x", n_cols)))
        .withColumn("part_row", F.explode(parts("y", "min_y", "max_y", n_rows)))
        .drop("top", "min_x", "max_x", "min_y", "max_y")
    )


def split_counts_by_width(bounds: DataFrame, width_km: float) -> DataFrame:
    """Columns and rows of a split into squares of about ``width_km``."""
    middle = F.radians((F.col("north") + F.col("south")) / 2.0)
    wide = F.radians(F.col("east") - F.col("west")) * F.lit(geo.EARTH_RADIUS / 1000.0) * F.cos(middle)
    tall = F.radians(F.col("north") - F.col("south")) * F.lit(geo.EARTH_RADIUS / 1000.0)

    def count(length):
        return F.greatest(F.lit(1), F.ceil(length / float(width_km)).cast("int"))

    return bounds.withColumn("n_cols", count(wide)).withColumn("n_rows", count(tall))


def part_metadata(meta: Column, name: Column) -> Column:
    """Metadata of a part: everything of the source, the name replaced."""
    kept = F.map_filter(meta, lambda k, _: k != "name")
    return F.map_concat(kept, F.create_map(F.lit("name"), name))


def coverage_guard(tiles: DataFrame, limit: float = SPARSE_LIMIT) -> DataFrame:
    """Refuses sets whose bounding rectangle holds far more positions than there are tiles."""
    per_zoom = tiles.groupBy("set_id", "zoom").agg(
        ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("positions"),
        F.count(F.lit(1)).alias("n_tiles"))
    total = per_zoom.groupBy("set_id").agg(F.sum("positions").alias("positions"), F.sum("n_tiles").alias("n_tiles"))
    return total.withColumn("refused", F.col("positions") > F.col("n_tiles") * F.lit(float(limit)))
