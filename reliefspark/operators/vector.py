"""Vector-map operators: tag filters, geometry assembly, merging, tiling.

Features: ``feature_id``, ``rings`` (array of vertex arrays), ``kind`` (Point, LineString, Polygon),
``props`` (map).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions import geo, geom
from reliefspark.functions.geo import _c, floor_long
from reliefspark.operators.catalogue import best_per_key
from reliefspark.operators.tiles import TILE, encode_png

# Default tag keys, layer tags, simplification steps, fill opacity.
DEFAULT_TAG_KEYS = ("highway", "waterway", "boundary", "natural", "landuse", "building", "place", "historic")
LAYER_TAGS = {
    "cours_d_eau": ("waterway", "river"), "troncon_hydrographique": ("waterway", "stream"),
    "plan_d_eau": ("natural", "water"), "batiment": ("building", "yes"), "cimetiere": ("landuse", "cemetery"),
    "troncon_de_route": ("highway", "road"), "route_numerotee_ou_nommee": ("highway", "primary"),
    "zone_de_vegetation": ("natural", "wood"), "lieu_dit_non_habite": ("place", "locality"),
    "commune": ("boundary", "administrative"), "ligne_orographique": ("natural", "ridge"),
}
SIMPLIFY_STEPS = ((200.0, 3.0), (1000.0, 8.0), (15000.0, 15.0), (100000.0, 25.0))
SIMPLIFY_LARGEST = 40.0
FILL_ALPHA, LINE_ALPHA = 70, 255
MAIN_NAMESPACE = "BDTOPO_V3"
SAFE_FILTER = r"^[A-Za-z0-9_:\-]+\s*(=\s*(\*|[A-Za-z0-9_:.\- ]+(,[A-Za-z0-9_:.\- ]+)*))?$"


# -- tags -----------------------------------------------------------------------------------------

def tag_filters(spark: SparkSession, tokens: Sequence[str] | None) -> DataFrame:
    """Filter table ``key, any_value, wanted, position`` from ``key``, ``key=*``, ``key=a,b`` tokens.

    Values of a repeated key are united, a bare key takes every value; the position is that of the
    first mention.
    """
    rows = [(i, t) for i, t in enumerate(tokens if tokens is not None else DEFAULT_TAG_KEYS)]
    return parse_tag_filters(spark.createDataFrame(rows, "position int, token string"))


def parse_tag_filters(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same for a table of tokens (``position, token``), optionally per group."""
    parts = F.split("token", "=", 2)
    key = F.trim(parts[0])
    value = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("*")))
    one = tokens.filter(key != "").select(
        *by, key.alias("key"), "position", value.isin("*", "").alias("bare"),
        F.explode(F.transform(F.split(value, ","), lambda v: F.trim(v))).alias("value"))
    return one.groupBy(*by, "key").agg(
        F.bool_or("bare").alias("any_value"),
        F.array_sort(F.collect_set(F.when(~F.col("bare"), F.col("value")))).alias("values"),
        F.min("position").alias("position"),
    ).select(*by, "key", "any_value", "position",
             F.when(F.col("any_value"), F.array().cast("array<string>")).otherwise(F.col("values")).alias("wanted"))


def classify(tags: DataFrame, filters: DataFrame) -> DataFrame:
    """Key and value that decide the class of each object: the first listed filter that fits.

    ``tags`` is ``object_id, key, value``.  The filter table is a handful of rows by construction.
    """
    fits = F.col("any_value") | F.array_contains("wanted", F.col("value"))
    hits = tags.join(filters, "key").filter(fits)
    return best_per_key(hits.select("object_id", "key", "value", "position"), ["object_id"], [F.col("position"), F.col("value")]).drop("position")


def safe_filter(token) -> Column:
    """True for plain tag filters; anything a shell could act on is refused."""
    return _c(token).rlike(SAFE_FILTER)


def layer_tags(source, file_name) -> Column:
    """Map tag (``key=value``) of a layer named in the source property, else in the file name."""
    text = F.lower(F.coalesce(_c(source), _c(file_name)))
    result = None
    for layer, (key, value) in LAYER_TAGS.items():
        tag = F.lit(f"{key}={value}")
        result = F.when(text.contains(layer), tag) if result is None else result.when(text.contains(layer), tag)
    return result.otherwise(F.lit("note="))


# -- geometry -------------------------------------------------------------------------------------

def way_lines(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertex arrays of ways from ``way_id, pos, node_id`` and ``node_id, lon, lat``.

    Unknown nodes drop out.  A way is one record in the source, so its vertex array is bounded by it.
    """
    return (
        way_nodes.join(nodes, "node_id")
        .groupBy("way_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("v"))
        .select("way_id", F.transform("v", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y"))).alias("line"))
    )


def in_area(features: DataFrame, box: Sequence[float] | None) -> DataFrame:
    """Features whose bounding box meets the area; no area keeps all."""
    if box is None:
        return features
    return features.filter(geo.bbox_touches(geom.rings_bbox("rings"), geo.bbox_lit(box)))


def drop_degenerate(features: DataFrame) -> DataFrame:
    """Polygon rings with at least three distinct vertices, closed; polygons without one vanish."""
    kept = F.transform(F.filter("rings", geom.ring_is_real), geom.close_ring)
    return features.withColumn("rings", F.when(F.col("kind") == "Polygon", kept).otherwise(F.col("rings"))).filter(
        F.size("rings") > 0)


def simplify_tolerance(area_km2) -> Column:
    """Automatic tolerance (m) by the size of the area."""
    area = _c(area_km2)
    result = None
    for limit, metres in SIMPLIFY_STEPS:
        result = F.when(area < limit, metres) if result is None else result.when(area < limit, metres)
    return result.otherwise(SIMPLIFY_LARGEST)


def _map_rings(features: DataFrame, change: Callable[[np.ndarray, float], np.ndarray], setting: Column) -> DataFrame:
    """Apply ``change(vertices, setting)`` to every ring; empty rings vanish.

    Only coordinates and the setting travel to Python, as plain number arrays.
    """
    def run(xs: pd.Series, ys: pd.Series, settings: pd.Series) -> pd.DataFrame:
        new_xs, new_ys = [], []
        for ring_xs, ring_ys, value in zip(xs, ys, settings):
            done = [change(np.column_stack([x, y]), value) for x, y in zip(ring_xs, ring_ys)]
            new_xs.append([ring[:, 0] for ring in done if len(ring)])
            new_ys.append([ring[:, 1] for ring in done if len(ring)])
        return pd.DataFrame({"xs": new_xs, "ys": new_ys})

    # marked so that later filters and columns on the rings reuse the one evaluation
    moved = F.pandas_udf(run, "xs array<array<double>>, ys array<array<double>>").asNondeterministic()

    def axis(name):
        return F.transform("rings", lambda ring: F.transform(ring, lambda p: p[name]))

    def vertex(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    out = features.withColumn("_moved", moved(axis("x"), axis("y"), setting.cast("double")))
    rings = F.zip_with("_moved.xs", "_moved.ys", lambda xs, ys: F.zip_with(xs, ys, vertex))
    return out.withColumn("rings", rings).drop("_moved")


def simplify(features: DataFrame, tolerance: str = "tolerance") -> DataFrame:
    """Douglas-Peucker on every ring, tolerance in the unit of the coordinates from a column."""
    return _map_rings(features, geom.simplify_vertices, F.col(tolerance))


def clip_polygons(features: DataFrame, box: Sequence[float]) -> DataFrame:
    """Polygon rings cut to a rectangle without leaving the JVM; rings outside vanish, and polygons without any left."""
    x0, y0, x1, y1 = (float(v) for v in box)
    clipped = F.filter(F.transform("rings", lambda ring: geom.clipped_ring(ring, x0, y0, x1, y1)), lambda ring: F.size(ring) > 0)
    return in_area(features, box).withColumn("rings", clipped).filter(F.size("rings") > 0)


# -- segments and tiles ---------------------------------------------------------------------------

def ring_segments(features: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per pair of neighbouring vertices: ``ax, ay, bx, by``."""
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    rings = features.select("feature_id", *carry, F.posexplode("rings").alias("ring_no", "ring")).filter(F.size("ring") >= 2)
    return rings.select("feature_id", *carry, "ring_no", F.posexplode(pairs).alias("pos", "s")).select(
        "feature_id", *carry, "ring_no", "pos", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
        F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def segment_tiles(segments: DataFrame, zoom: int | Column) -> DataFrame:
    """Tiles each lon/lat segment crosses at a zoom (``x, y``).

    The segment is cut into its tile columns first and each column yields only the rows the segment
    runs through, so a long diagonal costs its length and not its bounding rectangle.
    """
    count = geo.pow2(zoom)
    n = count.cast("double")

    def across(lon):
        return (F.col(lon) + 180.0) / 360.0 * n

    def down(lat):
        return (F.lit(1.0) - F.asinh(F.tan(F.radians(F.col(lat)))) / F.pi()) / 2.0 * n

    def clamp(i):
        return F.greatest(F.lit(0).cast("bigint"), F.least(count - 1, floor_long(i)))

    flat = segments.withColumn("_ax", across("ax")).withColumn("_ay", down("ay")).withColumn(
        "_bx", across("bx")).withColumn("_by", down("by"))
    columns = flat.withColumn("x", F.explode(F.sequence(
        clamp(F.least("_ax", "_bx")), clamp(F.greatest("_ax", "_bx")))))
    span = F.col("_bx") - F.col("_ax")
    upright = span == 0  # least and greatest skip nulls, so such a segment needs its own branch

    def at(edge):
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("_ax")) / F.nullif(span, F.lit(0.0))))
        return F.col("_ay") + share * (F.col("_by") - F.col("_ay"))

    left, right = at(F.col("x").cast("double")), at(F.col("x").cast("double") + 1.0)
    entry, leaving = F.when(upright, F.col("_ay")).otherwise(left), F.when(upright, F.col("_by")).otherwise(right)
    return columns.withColumn("y", F.explode(F.sequence(
        clamp(F.least(entry, leaving)), clamp(F.greatest(entry, leaving))))).drop("_ax", "_ay", "_bx", "_by")


#: tasks that may share the geometry of one tile, and tiles that a kernel paints at a time
_SALTS, _AT_ONCE = 16, 32
_MASKS = "zoom int, x bigint, y bigint, kind int, mask binary"
_LINE, _FILL = 1, 0


def _steps(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row ``i`` the whole numbers from ``first[i]``, ``count[i]`` of them: (i, number)."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]


def _painted(pairs: DataFrame, kind: int, spread: str, cover: Callable) -> DataFrame:
    """Masks of the pixels that geometry covers in its tiles (``zoom, x, y`` first), put together tile by tile.

    What belongs to a tile is dealt out over ``_SALTS`` tasks and comes sorted, so few masks are made of a tile.
    ``cover(columns, tile, n)`` gives how often the pixels of ``n`` tiles are covered; ``tile`` is the number of each row's.
    """
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)))
    dealt = salted.repartition(width, "zoom", "x", "y", "_salt").sortWithinPartitions("zoom", "x", "y").drop("_salt", spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            starts = np.flatnonzero(np.r_[True, (np.diff(keys) != 0).any(axis=0)][:batch.num_rows])
            ends = [*starts[_AT_ONCE::_AT_ONCE].tolist(), batch.num_rows]
            for low, high in zip([0, *ends[:-1]], ends):
                own = starts[(low <= starts) & (starts < high)]
                if not len(own):
                    continue
                tile = np.repeat(np.arange(len(own)), np.diff(np.r_[own, high]))
                covered = cover(batch.slice(low, high - low), tile, len(own)) > 0
                some = np.flatnonzero(covered.any(axis=(1, 2)))
                masks = [zlib.compress(np.packbits(covered[i]).tobytes(), 1) for i in some]
                zoom, x, y = keys[:, own[some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(zoom.astype(np.int32)), pa.array(x), pa.array(y), pa.array(np.full(len(some), kind, np.int32)), pa.array(masks, pa.binary())],
                    ["zoom", "x", "y", "kind", "mask"])

    return dealt.mapInArrow(run, _MASKS)


def merged_mask(masks) -> np.ndarray:
    """The pixels that any of the masks covers."""
    bits = np.zeros(TILE * TILE // 8, np.uint8)
    for mask in masks:
        bits |= np.frombuffer(zlib.decompress(mask), np.uint8)
    return np.unpackbits(bits).reshape(TILE, TILE).astype(bool)


def line_masks(segments: DataFrame) -> DataFrame:
    """Masks of the pixels of segments in their tiles: ``feature_id, zoom, x, y`` and lon/lat ends in.

    The segment is cut to the pixel columns of its tile, and each column yields the rows it runs through:
    every pixel it touches, no other one.
    """
    n = geo.pow2(F.col("zoom")).cast("double")

    def across(lon):
        return ((F.col(lon) + 180.0) / 360.0 * n - F.col("x")) * float(TILE)

    def down(lat):
        return ((F.lit(1.0) - F.asinh(F.tan(F.radians(F.col(lat)))) / F.pi()) / 2.0 * n - F.col("y")) * float(TILE)

    flat = segments.select("zoom", "x", "y", across("ax").alias("_ax"), down("ay").alias("_ay"), across("bx").alias("_bx"), down("by").alias("_by"), "feature_id")

    def between(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First whole number of the tile from one value to the other, and how many; none when they lie outside."""
        low = np.maximum(np.floor(np.minimum(one, two)), 0).astype(np.int64)
        return low, np.maximum(np.minimum(np.floor(np.maximum(one, two)), TILE - 1).astype(np.int64) - low + 1, 0)

    def cover(batch, tile, count):
        ax, ay, bx, by = (batch.column(i).to_numpy() for i in range(3, 7))
        i, column = _steps(*between(ax, bx))
        px, py, span, rise = ax[i], ay[i], (bx - ax)[i], (by - ay)[i]

        def at(edge):
            with np.errstate(invalid="ignore", divide="ignore"):
                return py + np.maximum(0.0, np.minimum(1.0, (edge - px) / span)) * rise

        upright = span == 0
        low, rows = between(np.where(upright, py, at(column)), np.where(upright, by[i], at(column + 1.0)))
        some = rows > 0
        place = (tile[i] * (TILE + 1) + low)[some] * TILE + column[some]
        size = count * (TILE + 1) * TILE
        change = np.bincount(place, minlength=size) - np.bincount(place + rows[some] * TILE, minlength=size)
        return change.reshape(count, TILE + 1, TILE).cumsum(axis=1)[:, :TILE]

    return _painted(flat, _LINE, "feature_id", cover)


def fill_masks(polygons: DataFrame) -> DataFrame:
    """Masks of the inner pixels of polygons in their tiles (``feature_id, zoom, x, y, rings``) by the even-odd rule.

    Each pixel row of a polygon is cut at its edges; the parts between the first and second cut, the third and fourth
    and so on are inside.
    """
    flat = F.flatten("rings")
    plain = polygons.select(
        "zoom", "x", "y", F.transform(flat, lambda p: p.x).alias("lon"), F.transform(flat, lambda p: p.y).alias("lat"),
        F.transform("rings", F.size).alias("sizes"), "feature_id")

    def cover(batch, tile, count):
        zoom, x, y = (batch.column(i).to_numpy() for i in range(3))
        lon, lat, sizes = (batch.column(i) for i in range(3, 6))
        points = np.diff(lon.offsets.to_numpy())
        of_point = np.repeat(np.arange(len(points)), points)
        n = 2.0 ** zoom[of_point]
        px = ((lon.flatten().to_numpy() + 180.0) / 360.0 * n - x[of_point]) * TILE
        py = ((1.0 - np.arcsinh(np.tan(np.radians(lat.flatten().to_numpy()))) / np.pi) / 2.0 * n - y[of_point]) * TILE
        ring = sizes.flatten().to_numpy().astype(np.int64)
        ring = ring[ring > 0]
        following = np.arange(1, len(px) + 1)  # the last point of a ring leads back to its first
        following[np.cumsum(ring) - 1] = np.cumsum(ring) - ring
        first, some = (np.cumsum(points) - points)[points > 0], points > 0
        c0, c1 = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        if some.any():
            c0[some] = np.clip(np.floor(np.minimum.reduceat(px, first)), 0, TILE)
            c1[some] = np.clip(np.ceil(np.maximum.reduceat(px, first)), 0, TILE)
        qx, qy = px[following], py[following]
        upper = np.clip(np.ceil(np.minimum(py, qy) - 0.5), 0, TILE).astype(np.int64)
        lower = np.clip(np.ceil(np.maximum(py, qy) - 0.5), 0, TILE).astype(np.int64)
        change = np.zeros(count * TILE * (TILE + 1), np.int64)
        crossed = np.cumsum((lower - upper)) if len(px) else np.zeros(0, np.int64)
        ends = np.cumsum(points)  # whole polygons, about as many crossings as are worked off at a time
        per_row = np.r_[0, crossed][ends]
        at = 0
        while at < len(points):
            done = per_row[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(per_row, done + (1 << 20), "right")))
            edge = slice(int(ends[at] - points[at]), int(ends[stop - 1]))
            i, row = _steps(upper[edge], (lower - upper)[edge])
            i += edge.start
            cut = px[i] + (row + 0.5 - py[i]) / (qy[i] - py[i]) * (qx[i] - px[i])
            own = of_point[i]
            column = np.clip(np.floor(cut - 0.5) + 1, c0[own], c1[own]).astype(np.int64)
            key = np.sort((own * TILE + row) * (TILE + 1) + column).reshape(-1, 2)
            line, column = np.divmod(key, TILE + 1)
            own, row = np.divmod(line[:, 0], TILE)
            place = (tile[own] * TILE + row) * (TILE + 1)
            change += np.bincount(place + column[:, 0], minlength=len(change)) - np.bincount(place + column[:, 1], minlength=len(change))
            at = stop
        return change.reshape(count, TILE, TILE + 1).cumsum(axis=2)[:, :, :TILE]

    return _painted(plain, _FILL, "feature_id", cover)


def fill_counts(polygons: DataFrame) -> DataFrame:
    """How many pixels of each tile lie inside any polygon: ``zoom, x, y, n_pixels``."""
    def count(key, table):
        n = int(merged_mask(table.column("mask").to_pylist()).sum())
        return pa.table({"zoom": pa.array([key[0].as_py()], pa.int32()), "x": [key[1].as_py()], "y": [key[2].as_py()], "n_pixels": pa.array([n], pa.int64())})

    return fill_masks(polygons).groupBy("zoom", "x", "y").applyInArrow(count, "zoom int, x bigint, y bigint, n_pixels bigint")


def inside_pixels(lon, lat, sizes, zoom: int, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the tile pixels whose centre lies inside; only the covered window is tested."""
    n = 2.0**zoom
    px = ((lon + 180.0) / 360.0 * n - x) * TILE
    py = ((1.0 - np.arcsinh(np.tan(np.radians(lat))) / np.pi) / 2.0 * n - y) * TILE
    r0, r1 = (int(min(max(v, 0), TILE)) for v in (np.floor(py.min()), np.ceil(py.max())))
    c0, c1 = (int(min(max(v, 0), TILE)) for v in (np.floor(px.min()), np.ceil(px.max())))
    inside = np.zeros((max(r1 - r0, 0), max(c1 - c0, 0)), dtype=bool)
    across, down = np.arange(c0, c1) + 0.5, np.arange(r0, r1) + 0.5
    start = 0
    for size in sizes if inside.size else ():
        ax, ay = px[start:start + size], py[start:start + size]
        for a, b, c, d in zip(ax, ay, np.roll(ax, -1), np.roll(ay, -1)):
            if b != d:
                rows = np.flatnonzero((min(b, d) <= down) & (down < max(b, d)))
                inside[rows] ^= across > (a + (down[rows] - b) / (d - b) * (c - a))[:, None]
        start += size
    rows, cols = np.nonzero(inside)
    return (rows + r0).astype("int32"), (cols + c0).astype("int32")


def feature_tiles(features: DataFrame, zoom_min: int, zoom_max: int) -> DataFrame:
    """Transparent tiles of lines and polygons: ``zoom, x, y, data, painted, fill_pixels``.

    Segments go to the tiles they cross, polygon surfaces to the tiles of their box; holes are left out
    by the even-odd rule.  The (geometry, tile) pairs are dealt out by tile and salt and painted into masks of one
    bit a pixel; a group holds the masks of one tile, and no row per pixel is ever made.
    """
    if zoom_min < 13:
        raise ValueError("transparent tiles start at zoom 13")
    zooms = F.explode(F.sequence(F.lit(zoom_min), F.lit(zoom_max)))
    outlined = features.withColumn("rings", F.when(
        F.col("kind") == "Polygon", F.transform("rings", geom.close_ring)).otherwise(F.col("rings")))
    lines = segment_tiles(ring_segments(outlined).withColumn("zoom", zooms), F.col("zoom"))
    box = F.col("box")
    surfaces = (
        outlined.filter(F.col("kind") == "Polygon")
        .select("feature_id", "rings", geom.rings_bbox("rings").alias("box")).withColumn("zoom", zooms)
        .withColumn("x", F.explode(F.sequence(geo.tile_x(box.x0, F.col("zoom")), geo.tile_x(box.x1, F.col("zoom")))))
        .withColumn("y", F.explode(F.sequence(geo.tile_y(box.y1, F.col("zoom")), geo.tile_y(box.y0, F.col("zoom")))))
    )

    def pack(key, table):
        masks = list(zip(table.column("kind").to_pylist(), table.column("mask").to_pylist()))
        line, fill = (merged_mask(m for k, m in masks if k == kind) for kind in (_LINE, _FILL))
        image = np.zeros((TILE, TILE, 4), dtype=np.uint8)
        image[fill, 3] = FILL_ALPHA
        image[line, 3] = LINE_ALPHA
        return pa.table({
            "zoom": pa.array([key[0].as_py()], pa.int32()), "x": [key[1].as_py()], "y": [key[2].as_py()], "data": [encode_png(image)],
            "painted": pa.array([int((line | fill).sum())], pa.int32()), "fill_pixels": pa.array([int((fill & ~line).sum())], pa.int32())})

    return line_masks(lines).unionByName(fill_masks(surfaces)).groupBy("zoom", "x", "y").applyInArrow(
        pack, "zoom int, x bigint, y bigint, data binary, painted int, fill_pixels int")


# -- files and areas ------------------------------------------------------------------------------

def merge_files(files: dict[str, DataFrame]) -> DataFrame:
    """Features of several inputs as one table, ``source`` naming the input."""
    merged = None
    for name, df in files.items():
        part = df.withColumn("source", F.lit(name))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged


def total_bbox(features: DataFrame, box: Column) -> DataFrame:
    return features.select(box.alias("b")).agg(
        F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def page_gate(pages: DataFrame) -> DataFrame:
    """Verdict per layer over its pages (``layer, feature_id, total``): complete or rejected."""
    return pages.groupBy("layer").agg(
        F.count_distinct("feature_id").alias("n_features"), F.max("total").alias("total")).withColumn(
        "verdict", F.when(F.col("n_features") >= F.col("total"), "complete").otherwise("rejected"))


def layer_file_name(area, type_name) -> Column:
    """File name of a layer; outside the main namespace a hash keeps similar names apart."""
    namespace = F.substring_index(_c(type_name), ":", 1)
    short = F.regexp_replace(F.substring_index(_c(type_name), ":", -1), r"[^A-Za-z0-9]+", "_")
    stem = F.concat(_c(area), F.lit("_ign_"), F.lower(short))
    digest = F.substring(F.sha2(_c(type_name), 256), 1, 8)
    return F.concat(F.when(namespace == MAIN_NAMESPACE, stem).otherwise(F.concat_ws("_", stem, digest)), F.lit(".geojson.gz"))


def area_around(x, y, width_km) -> Column:
    """Square of a given width (its side, not its radius) around a projected point."""
    half = _c(width_km) * 500.0
    return geo.bbox(_c(x) - half, _c(y) - half, _c(x) + half, _c(y) + half)


def _degrees_name(value: Column) -> Column:
    return F.replace(F.format_string("%.5f", F.bround(value.cast("double"), 5)), F.lit("."), F.lit("_"))


def area_name_point(lat, lon) -> Column:
    return F.concat_ws("_", F.lit("gps"), _degrees_name(_c(lat)), _degrees_name(_c(lon)))


def area_name_bbox(box: Column) -> Column:
    return F.concat_ws("_", F.lit("bbox"), *[_degrees_name(box[k]) for k in ("x0", "y0", "x1", "y1")])


def area_codes(expressions: DataFrame, column: str = "expression") -> DataFrame:
    """Codes named by expressions such as ``1-3,75,2A``: ranges opened, single digits padded."""
    item = F.trim(F.col("item"))
    first, last = F.element_at(F.split(item, "-"), 1), F.element_at(F.split(item, "-"), -1)
    numbers = F.when(
        item.rlike(r"^\d+-\d+$"),
        F.transform(F.sequence(first.try_cast("int"), last.try_cast("int")), lambda i: i.cast("string"))).otherwise(F.array(item))
    one = expressions.withColumn("item", F.explode(F.split(column, ","))).filter(item != "")
    return one.withColumn("code", F.explode(numbers)).withColumn(
        "code", F.when(F.length("code") < 2, F.lpad("code", 2, "0")).otherwise(F.upper("code"))).drop("item")


def region_envelope(departments: DataFrame) -> DataFrame:
    box = F.col("bbox")
    return departments.groupBy("region").agg(
        F.min(box.x0).alias("x0"), F.min(box.y0).alias("y0"), F.max(box.x1).alias("x1"), F.max(box.y1).alias("y1"),
        F.count(F.lit(1)).alias("n_departments"))


# -- map objects ----------------------------------------------------------------------------------

def node_id(lon, lat) -> Column:
    """Whole-number id of a position to 1e-7 degree: equal positions share it, no counter is needed."""
    east = F.bround((_c(lon) + 180.0) * 1e7, 0).cast("bigint")
    north = F.bround((_c(lat) + 90.0) * 1e7, 0).cast("bigint")
    return east * F.lit(2147483648) + north


def to_map_objects(features: DataFrame) -> dict[str, DataFrame]:
    """Node, way and tag tables of features (polygon rings closed, degenerate ones dropped)."""
    real = drop_degenerate(features)
    ways = real.select("feature_id", "kind", "props", F.posexplode("rings").alias("ring_no", "ring")).withColumn(
        "way_id", F.concat_ws("/", F.col("feature_id").cast("string"), F.col("ring_no").cast("string")))
    vertices = ways.select("way_id", "kind", F.posexplode("ring").alias("pos", "p")).select(
        "way_id", "kind", "pos", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), node_id("p.x", "p.y").alias("node_id"))
    return {
        "nodes": vertices.groupBy("node_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")),
        "way_nodes": vertices.filter(F.col("kind") != "Point").select("way_id", "pos", "node_id"),
        "tags": ways.select("way_id", F.explode("props").alias("key", "value")),
    }
