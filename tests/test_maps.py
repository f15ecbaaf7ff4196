"""Tiles, vectors, catalogue and run state: known cases and brute force."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions import geo, geom
from reliefspark.operators import catalogue as C
from reliefspark.operators import state as G
from reliefspark.operators import tiles as T
from reliefspark.operators import vector as V
from reliefspark.operators import warp
from helpers import to_array, to_blocks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def decode_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    width, height, _, colour = struct.unpack_from(">IIBB", data, 16)
    pos, body = 8, b""
    while pos < len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        if kind == b"IDAT":
            body += data[pos + 8:pos + 8 + size]
        pos += 12 + size
    channels = {0: 1, 4: 2, 2: 3, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * channels)
    return raw[:, 1:].reshape(height, width, channels)


# -- tiles ----------------------------------------------------------------------------------------

def test_tile_address_is_clamped(spark):
    assert one(spark, geo.tile_x(F.lit(180.0), F.lit(10)).alias("x")).x == 1023


def test_packed_tiles_and_alpha(spark):
    pixels = spark.range(300 * 256).selectExpr("15 as zoom", "floor(id/300) as prow", "id % 300 as pcol", "cast(1 + id % 255 as int) as v")
    tiles = {r.x: r for r in T.png_tiles(T.pixel_tiles(pixels)).collect()}
    assert set(tiles) == {0, 1} and tiles[0].filled == 65536
    assert decode_png(tiles[0].data).shape == (256, 256, 1)
    edge = decode_png(tiles[1].data)
    assert edge.shape[2] == 2 and (edge[:, 44:, 1] == 0).all() and (edge[:, :44, 1] == 255).all()


def test_pyramid_step_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 256, (40, 36)).astype(float)
    v[rng.random(v.shape) < 0.3] = 0
    got = to_array(T.reduce_once(to_blocks(spark, v, 8, "v"), "v", 8), "v", (20, 18), 8)
    pad = np.pad(v, ((0, 1), (0, 1)))
    k = np.array([1, 2, 1])
    for r in range(20):
        for c in range(18):
            w = pad[2 * r:2 * r + 3, 2 * c:2 * c + 3]
            weight = (np.outer(k, k) * (w > 0)).sum()
            want = math.floor((np.outer(k, k) * w).sum() / weight + 0.5) if weight else 0
            assert got[r, c] == want


def test_bounds_come_from_the_highest_zoom(spark):
    tiles = spark.createDataFrame([("s", 12, 2115, 2570), ("s", 14, 8465, 10290), ("s", 14, 8466, 10291)], "set_id string, zoom int, x long, y long")
    b = T.set_bounds(tiles).first()
    assert b.west == pytest.approx(8465 / 2**14 * 360 - 180) and b.east == pytest.approx(8467 / 2**14 * 360 - 180)
    assert b.north > b.south


def test_split_keeps_real_edges(spark):
    rows = [("s", 12, c, 4095 - r) for c in (2000, 2001) for r in range(1000, 1006)]
    tiles = spark.createDataFrame(rows, "set_id string, zoom int, x long, y long")
    parts = T.split_set(tiles, 1, 2)
    assert parts.groupBy("part_row").count().count() == 2
    b = T.set_bounds(parts, ["set_id", "part_row"]).collect()
    assert all(r.north > r.south for r in b)

    def lat(y):
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 4096))))

    assert max(r.north for r in b) == pytest.approx(lat(4095 - 1005)) and min(r.south for r in b) == pytest.approx(lat(4095 - 1000 + 1))


def test_sparse_sets_are_refused(spark):
    rows = [("sparse", 11, c, r) for c in (0, 1500) for r in (0, 1500)] + [("dense", 10, 500, 300)]
    got = {r.set_id: r.refused for r in T.coverage_guard(spark.createDataFrame(rows, "set_id string, zoom int, x long, y long")).collect()}
    assert got == {"sparse": True, "dense": False}


def test_answers(spark):
    jpeg, html, small = b"\xff\xd8\xff\xe0" + b"x" * 10, b"<html>" + b"x" * 2000, b"ab"
    cases = [(200, "image/jpeg", jpeg, "data"), (404, "", b"", "absent"), (204, "", b"", "absent"), (503, "", b"", "error"), (200, "application/xml", b"<Service/>", "error"),
             (200, "image/tiff", b'{"error":1}' + b" " * 600, "error"), (200, "image/png", html, "error"), (200, "", small, "absent"),
             (200, 'multipart/related; type="text/xml"', b"II\x2a\x00" + b"\0" * 64, "data"), (200, "image/webp", b"RIFF\0\0\0\0WEBP", "data")]
    df = spark.createDataFrame([(s, t, bytearray(b), w) for s, t, b, w in cases], "s int, t string, b binary, want string")
    rows = df.select(T.answer_class("s", "t", "b").alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_format_matrix(spark):
    cases = [("image/png", "auto", 85), ("image/png", "jpeg", 85), ("image/png", "png", None), ("image/jpeg", "auto", None), ("image/jpeg", "png", None)]
    df = spark.createDataFrame(cases, "s string, f string, want int")
    assert all(r.got == r.want for r in df.select(T.convert_quality("s", "f", F.lit(85)).alias("got"), "want").collect())


def test_raw_heights_are_no_pixels(spark):
    assert T.require_bytes(spark.createDataFrame([(3.0,)], "v double")).count() == 1
    with pytest.raises(Exception, match="bytes"):
        T.require_bytes(spark.createDataFrame([(1234.5,)], "v double")).collect()


# -- vectors --------------------------------------------------------------------------------------

def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


FEATURES = "feature_id long, kind string, rings array<array<struct<x:double,y:double>>>, props map<string,string>"
OUTER = ring((7.102, 44.211), (7.106, 44.211), (7.106, 44.214), (7.102, 44.214), (7.102, 44.211))
INNER = ring((7.103, 44.212), (7.105, 44.212), (7.105, 44.213), (7.103, 44.213), (7.103, 44.212))


def test_hole_of_a_polygon_stays_open(spark):
    def filled(rings):
        tiles = V.feature_tiles(spark.createDataFrame([(1, "Polygon", rings, {})], FEATURES), 17, 18)
        return tiles.agg(F.sum("fill_pixels")).first()[0]

    full, donut = filled([OUTER]), filled([OUTER, INNER])
    assert 0 < donut < full


def test_upright_segments_meet_all_their_tiles(spark):
    line = ring((6.04, 43.30), (6.04, 43.50))
    tiles = V.segment_tiles(V.ring_segments(spark.createDataFrame([(1, "LineString", [line], {})], FEATURES)), 12).collect()
    rows = sorted(t.y for t in tiles)
    assert len({t.x for t in tiles}) == 1 and rows == list(range(rows[0], rows[-1] + 1)) and len(rows) > 2


def test_transparent_tiles_of_a_line(spark):
    line = ring((6.040, 43.326), (6.045, 43.330), (6.050, 43.333))
    tiles = V.feature_tiles(spark.createDataFrame([(1, "LineString", [line], {})], FEATURES), 15, 17).collect()
    assert {t.zoom for t in tiles} == {15, 16, 17}
    for t in tiles:
        assert int((decode_png(t.data)[:, :, 3] > 0).sum()) == t.painted > 0
    crossed = V.segment_tiles(V.ring_segments(spark.createDataFrame([(1, "LineString", [line], {})], FEATURES)), 17).select("x", "y").distinct().count()
    assert crossed == sum(t.zoom == 17 for t in tiles)


def test_filled_pixels_match_point_in_polygon(spark):
    rng = np.random.default_rng(4)
    n = 2.0**17
    star = [(i, r) for i, r in enumerate(rng.uniform(20, 120, 9))]
    px = np.array([(128 + r * math.cos(2 * math.pi * i / 9), 128 + r * math.sin(2 * math.pi * i / 9)) for i, r in star])
    tx, ty = 67700, 47900
    lon = (tx + px[:, 0] / 256) / n * 360 - 180
    lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (ty + px[:, 1] / 256) / n))))
    rows, cols = V.inside_pixels(lon, lat, [9], 17, tx, ty)
    got = np.zeros((256, 256), bool)
    got[rows, cols] = True
    y, x = np.mgrid[0:256, 0:256] + 0.5
    want = np.zeros((256, 256), bool)
    for (ax, ay), (bx, by) in zip(px, np.roll(px, -1, axis=0)):
        crossing = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            want ^= crossing & (x > ax + (y - ay) / (by - ay) * (bx - ax))
    assert (got != want).sum() <= 2


def test_segment_tiles_match_the_box_test(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.uniform([5, 43, 5, 43], [5.3, 43.3, 5.3, 43.3]))) for i in range(60)]
    segs = spark.createDataFrame(rows, "feature_id long, ax double, ay double, bx double, by double")
    got = {(r.feature_id, r.x, r.y) for r in V.segment_tiles(segs, 12).collect()}
    n = 2**12

    def flat(lon, lat):
        return (lon + 180) / 360 * n, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n

    want = set()
    for i, ax, ay, bx, by in rows:
        (x0, y0), (x1, y1) = flat(ax, ay), flat(bx, by)
        for t in np.linspace(0, 1, 20001):
            want.add((i, math.floor(x0 + t * (x1 - x0)), math.floor(y0 + t * (y1 - y0))))
    assert want <= got and len(got - want) <= 2


def test_segment_and_box_cases(spark):
    cases = [((0, 0, 100, 100), (40, 40, 60, 60), True), ((0, 0, 100, 100), (40, 0, 60, 20), False), ((0, 0, 100, 100), (0, 40, 20, 60), False),
             ((0, 0, 100, 100), (95, 95, 105, 105), True), ((0, 50, 100, 50), (40, 45, 60, 55), True), ((0, 50, 100, 50), (40, 0, 60, 10), False),
             ((50, 50, 50, 50), (40, 40, 60, 60), True), ((50, 50, 50, 50), (0, 0, 10, 10), False)]
    for segment, box, want in cases:
        column = geom.segment_meets_box(*[F.lit(float(v)) for v in segment + box]).alias("hit")
        assert one(spark, column).hit is want


def test_rings_are_clipped_alike_in_the_jvm(spark):
    rng = np.random.default_rng(8)
    rings = [rng.uniform(-6, 16, (rng.integers(3, 9), 2)) for _ in range(120)]
    rings = [np.vstack([r, r[:1]]) if i % 2 else r for i, r in enumerate(rings)] + [np.zeros((0, 2)), np.array([[5.0, 5.0]]), np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])]
    rows = [(i, [[(float(x), float(y)) for x, y in r]]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x: double, y: double>>>")
    got = {r.id: np.array([(p.x, p.y) for p in r.ring]).reshape(-1, 2) for r in df.select("id", geom.clipped_ring(df.rings[0], 0, 0, 10, 10).alias("ring")).collect()}
    for i, ring in enumerate(rings):
        want = geom.clip_ring(ring, 0.0, 0.0, 10.0, 10.0)
        assert got[i].shape == want.shape and np.allclose(got[i], want), i


def test_clipping_runs_without_python(spark, capsys):
    df = spark.createDataFrame([(1, [[(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)]])], "id int, rings array<array<struct<x: double, y: double>>>")
    V.clip_polygons(df, (1, 1, 3, 3)).explain()
    assert "Python" not in capsys.readouterr().out


def test_clip_and_simplify():
    def clip(*points):
        return geom.clip_ring(np.array(points, dtype=float), 0, 0, 10, 10)

    around = clip((-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5))
    assert (around.min(axis=0) == 0).all() and (around.max(axis=0) == 10).all()
    across = clip((5, 5), (15, 5), (5, 15), (5, 5))
    assert len(across) and (across[0] == across[-1]).all() and across.min() >= 0 and across.max() <= 10
    assert len(clip((20, 20), (30, 20), (30, 30), (20, 30), (20, 20))) == 0
    line = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], dtype=float)
    assert geom.simplify_vertices(line, 1.0).tolist() == [[0, 0], [2, -0.1], [3, 5], [7, 9], [9, 9]]


def parsed(spark, tokens):
    return {r.key: (None if r.any_value else set(r.wanted), r.position) for r in V.tag_filters(spark, tokens).collect()}


def test_tag_filters(spark):
    assert parsed(spark, ["highway=path"]) == {"highway": ({"path"}, 0)}
    assert parsed(spark, ["highway"]) == parsed(spark, ["highway=*"]) == {"highway": (None, 0)}
    assert parsed(spark, ["highway=path,track", "highway=steps"]) == {"highway": ({"path", "track", "steps"}, 0)}
    assert parsed(spark, ["natural=water", "natural"]) == {"natural": (None, 0)}
    assert parsed(spark, ["  ", "highway = path "]) == {"highway": ({"path"}, 1)}
    assert {"place", "historic"} <= set(parsed(spark, None))


def test_first_listed_filter_decides(spark):
    tags = spark.createDataFrame([(1, "natural", "water"), (1, "waterway", "river"), (2, "highway", "motorway"), (2, "natural", "water")], "object_id long, key string, value string")

    def result(*tokens):
        return {r.object_id: r.key for r in V.classify(tags, V.tag_filters(spark, tokens)).collect()}

    assert result("natural=water", "waterway=river")[1] == "natural"
    assert result("waterway=river", "natural=water")[1] == "waterway"
    assert result("highway=path", "natural=water")[2] == "natural"


def test_degenerate_rings_vanish(spark):
    rows = [(1, "Polygon", [ring((2, 43), (2.001, 43.001), (2, 43))], {"a": "b"}), (2, "Polygon", [ring((2.01, 43), (2.012, 43), (2.011, 43.002))], {"a": "b"})]
    objects = V.to_map_objects(spark.createDataFrame(rows, FEATURES))
    refs = [r.node_id for r in objects["way_nodes"].orderBy("pos").collect()]
    assert len(refs) == 4 and refs[0] == refs[-1] and objects["nodes"].count() == 3
    assert objects["way_nodes"].select("way_id").distinct().count() == 1


def test_filter_guard_and_names(spark):
    good = ["highway=*", "boundary=administrative", "building", "addr:housenumber=*", "highway=residential,service,track"]
    bad = ["highway=* & calc.exe", "x=y | whoami", "a=b > C:/pwn.txt", "foo=%PATH%", 'q="evil"', "a=b`id`", "a;rm -rf", "a=b^c", "a=$(id)"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r.s for r in df.select(V.safe_filter("t").alias("s")).collect()] == [True] * len(good) + [False] * len(bad)
    names = [("LHD_FXX_0958_6279_MNT.tif", True), ("tile.laz", True), ("../evil.tif", False), ("..\\evil.tif", False), ("C:\\x.tif", False), ("..", False), ("", False), ("a\0b.tif", False)]
    df = spark.createDataFrame(names, "n string, want boolean")
    assert all(r.got == r.want for r in df.select(C.safe_name("n").alias("got"), "want").collect())
    assert one(spark, V.area_name_point(F.lit(43.3156), F.lit(6.0423)).alias("n")).n == "gps_43_31560_6_04230"
    assert one(spark, V.area_name_bbox(geo.bbox_lit((6.0, 43.3, 6.1, 43.4))).alias("n")).n == "bbox_6_00000_43_30000_6_10000_43_40000"


# -- catalogue, requests, state -------------------------------------------------------------------

def test_grid_references(spark):
    def ref(e, n, km):
        return one(spark, geo.british_grid_ref(F.lit(e), F.lit(n), km).alias("r")).r

    assert ref(158000, 607000, 1) == "NR5807" and ref(317000, 1000000, 1) == "HY1700"
    assert ref(158000, 607000, 10) == "NR50" and ref(158000, 607000, 5) == "NR50NE"


def test_aligned_box_takes_no_extra_cells(spark):
    def count(box, closed=False):
        return C.grid_cells(spark.range(1).select(geo.bbox_lit(box).alias("bbox")), closed=closed).count()

    assert count((880000, 6250000, 890000, 6260000)) == 100
    assert count((880000, 6250000, 890000, 6260000), closed=True) == 121
    assert count((158000, 607000, 160000, 609000)) == 4


def test_shading_requests(spark):
    specs = [("svf:dist=10,gamma=1.5,conv=rvt", None), ("oneg", None), ("315:elevation=35", None), ("svf:sweep=0", None), ("vat:dist=30,gamma=1.5", None),
             ("foo", "unknown type"), ("svf:bidule=1", "unknown parameter"), ("svf:conv=xx", "bad value"), ("svf:dist=abc", "bad value")]
    df = spark.createDataFrame(specs, "s string, want string").withColumn("p", warp.parse_shading("s"))
    rows = df.collect()
    assert [r.p.problem for r in rows] == [r.want for r in rows]
    assert rows[0].p.params == {"dist": "10", "gamma": "1.5", "conv": "rvt"}
    names = df.filter("want is null").select(warp.product_name(F.lit("zz"), "p.type", "p.params").alias("n")).collect()
    assert [r.n for r in names][:3] == ["zz_svf_rvt_10m_g1p5_ombrage.tif", "zz_oneg_ombrage.tif", "zz_315_e35_ombrage.tif"]


def test_presets(spark):
    rows = warp.preset_requests(spark.createDataFrame([(0.5,), (1.0,), (5.0,)], "res double"), "res").collect()
    assert {r.res: r.preset for r in rows} == {0.5: "micro", 1.0: "standard", 5.0: "landscape"}
    assert [r.sigma for r in rows if r.res == 5.0 and r.type == "lrm"] == [40.0]
    assert [r.elevation for r in rows if r.res == 5.0 and r.type == "multi"] == [30.0]


def test_chunks_and_blocks(spark):
    area = spark.range(1).select(geo.bbox_lit((0, 0, 10000, 10000)).alias("bbox"))
    chunks = G.split_area(area, side_m=5000.0).collect()
    assert sorted(c.chunk for c in chunks) == ["001x001", "001x002", "002x001", "002x002"]
    assert {c.chunk_box.x1 - c.chunk_box.x0 for c in chunks} == {5000.0}
    thirds = spark.range(1, 4).select(geo.bbox_lit((0, 0, 3000, 3000)).alias("bbox"), F.col("id").alias("i"))
    boxes = [r.bbox for r in G.area_block(thirds, F.col("i"), 3).collect()]
    assert sum((b.x1 - b.x0) * (b.y1 - b.y0) for b in boxes) == pytest.approx(9e6)


def test_manifest_cycle(spark):
    chunks = spark.createDataFrame([("001x001", 1), ("001x002", 1), ("001x003", 0)], "chunk string, n_sources int")
    empty = spark.createDataFrame([], "chunk string, done boolean")
    made = spark.createDataFrame([("001x001", True, True), ("001x002", True, False), ("001x002", False, True)], "chunk string, requested boolean, complete boolean")
    state = G.next_manifest(empty, G.chunk_outcome(chunks, made))
    assert [r.chunk for r in G.pending_chunks(chunks, state).collect()] == ["001x002"]
    assert G.pending_chunks(chunks, state, overwrite=True).count() == 3


def test_signature_ignores_tag_order_and_extent(spark):
    def sign(tags, step=1000, zoom=18):
        return one(spark, G.config_signature([F.lit(zoom)], F.array(*map(F.lit, tags)), F.lit(650000), F.lit(6300000), F.lit(step)).alias("s")).s

    assert sign(["a", "b"]) == sign(["b", "a"]) != sign(["a"])
    assert sign(["a"], step=2000) != sign(["a"]) != sign(["a"], zoom=17)


def test_warp_moves_a_plane(spark):
    rows = [("r", r, c, float(r * 10 + c)) for r in range(10) for c in range(10)]
    cells = spark.createDataFrame(rows, "raster_id string, row long, col long, z double")
    targets = spark.createDataFrame([("r", i, j) for i in range(4) for j in range(4)], "raster_id string, row long, col long")
    out = {(r.row, r.col): r.z for r in warp.warp_bilinear(cells, targets, F.col("row") * 2.0 + 0.5, F.col("col") * 2.0 + 0.25).collect()}
    assert out[(1, 2)] == pytest.approx(2.5 * 10 + 4.25)


def test_block_warp_equals_cell_warp(spark):
    class Shift:
        """Target grid of half the resolution, moved by a quarter of a cell."""

        def to_target(self, row, col):
            return (row - 0.5) / 2, (col - 0.25) / 2

        def to_source(self, row, col):
            return row * 2 + 0.5, col * 2 + 0.25

    rng = np.random.default_rng(8)
    z = rng.normal(0, 1, (40, 40))
    z[rng.random(z.shape) < 0.2] = np.nan
    blocks = to_blocks(spark, z, 8)
    moved = to_array(warp.warp_blocks(blocks, "z", Shift(), 8, 6), "z", (20, 20), 6)
    from reliefspark.operators.blocks import blocks_to_cells

    targets = spark.range(400).selectExpr("'r' as raster_id", "floor(id/20) as row", "id % 20 as col")
    cells = warp.warp_bilinear(blocks_to_cells(blocks, ["z"], 8), targets, F.col("row") * 2.0 + 0.5, F.col("col") * 2.0 + 0.25)
    want = np.full((20, 20), np.nan)
    for r in cells.collect():
        want[r.row, r.col] = r.z
    assert np.allclose(moved, want, equal_nan=True)


def test_stored_pyramid_equals_lazy_one(spark, tmp_path):
    from reliefspark.sinks.writers import write_pyramid

    rng = np.random.default_rng(9)
    v = rng.integers(1, 256, (32, 32)).astype(float)
    blocks = to_blocks(spark, v, 8, "v")
    write_pyramid(blocks, str(tmp_path / "p"), 3, 5, "v", 8)
    stored = to_array(spark.read.parquet(str(tmp_path / "p" / "zoom=3")), "v", (8, 8), 8)
    lazy = to_array(T.pyramid(blocks, 3, 5, "v", 8).filter("zoom = 3").drop("zoom"), "v", (8, 8), 8)
    assert np.array_equal(stored, lazy) and (stored > 0).all()


def test_positions_are_those_of_the_mapping():
    """The polynomial against the projection itself, and a mapping that is no polynomial at all."""
    from reliefspark.functions.arrays import LambertToPixels

    mapping = LambertToPixels(900000.0, 6250000.0, 0.5, 18)
    row, col = (int(v) // 256 for v in mapping.to_target(np.array([4000.0]), np.array([3000.0])))
    r, c = np.meshgrid(np.arange(256.0) + 256 * row, np.arange(256.0) + 256 * col, indexing="ij")
    for got, want in zip(warp._Positions(mapping, 256).of(row, col), mapping.to_source(r, c)):
        assert np.abs(got - want).max() < 1e-7

    class Bent:
        def to_source(self, row, col):
            return np.where(row > 100, row + 0.5, row), np.abs(col - 77.3)

    r, c = np.meshgrid(np.arange(256.0), np.arange(256.0), indexing="ij")
    for got, want in zip(warp._Positions(Bent(), 256).of(0, 0), Bent().to_source(r, c)):
        assert np.array_equal(got, want)
