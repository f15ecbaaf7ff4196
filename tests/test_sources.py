"""Small hand-made files through every reader and writer."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.sinks import writers
from reliefspark.sources import features as SF
from reliefspark.sources import grids, indexes, las
from reliefspark.streaming.new_tiles import process_new_tiles


def las_file(path, xs, ys, zs, classes, fmt=0, withheld=()):
    size = 20 if fmt == 0 else 30
    head = bytearray(375 if fmt else 227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 4 if fmt else 2])
    struct.pack_into("<I", head, 96, len(head))
    struct.pack_into("<BHI", head, 104, fmt, size, 0 if fmt else len(xs))
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0, max(xs), min(xs), max(ys), min(ys), max(zs), min(zs))
    if fmt:
        struct.pack_into("<Q", head, 247, len(xs))
    body = b""
    for i, (x, y, z, c) in enumerate(zip(xs, ys, zs, classes)):
        record = bytearray(size)
        struct.pack_into("<3i", record, 0, round(x * 100), round(y * 100), round(z * 100))
        if fmt:
            record[15], record[16] = (4 if i in withheld else 0), c
        else:
            record[15] = c | (0x80 if i in withheld else 0)
        body += bytes(record)
    path.write_bytes(bytes(head) + body)


@pytest.mark.parametrize("fmt", [0, 6])
def test_las_points(spark, tmp_path, fmt):
    xs = np.arange(10) * 1.25
    las_file(tmp_path / "a.las", xs, xs + 1, xs + 100, [2, 7, 9, 1, 2, 2, 2, 2, 2, 4], fmt, withheld={3})
    las_file(tmp_path / "b.las", [5.0], [6.0], [7.0], [2], fmt)
    las.register(spark)
    df = spark.read.format("las").option("pointsPerPartition", 4).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    rows = df.orderBy("cloud_id", "x").collect()
    assert len(rows) == 11 and [r.cls for r in rows[:4]] == [2, 7, 9, 1] and [r.withheld for r in rows[:4]] == [False, False, False, True]
    assert rows[4].x == pytest.approx(5.0) and rows[4].z == pytest.approx(105.0)
    heads = las.las_headers(spark, str(tmp_path)).orderBy("cloud_id").collect()
    assert heads[0].n_points == 10 and heads[0].min_x == 0.0 and heads[0].max_y == pytest.approx(12.25)


def test_las_filters_prune_files_and_records(spark, tmp_path):
    for k in range(8):
        las_file(tmp_path / f"c{k}.las", np.arange(10) + 100.0 * k, np.arange(10) + 5.0, np.arange(10) + 50.0 * k, [2] * 10)
    (tmp_path / "notes.txt").write_text("no cloud")
    las.register(spark)

    def planned(where):
        reader = las.LasReader({"path": f"file:{tmp_path}"})
        list(reader.pushFilters(where))
        splits = reader.partitions()
        rows = [r for s in splits for b in reader.read(s) for r in b.to_pylist()]
        return reader.planned, len(rows)

    assert planned([]) == ((8, 8), 80)
    assert planned([las.GreaterThanOrEqual(("x",), 305.0), las.LessThan(("x",), 404.0)]) == ((8, 2), 5 + 5)
    assert planned([las.EqualTo(("z",), 102.0)]) == ((8, 1), 1) and planned([las.EqualTo(("cloud_id",), "c3.las")]) == ((8, 1), 10)
    assert planned([las.GreaterThan(("y",), 14.5)]) == ((8, 0), 0)
    window = las.read_las(spark, str(tmp_path), (305, 0, 403, 20))
    assert sorted(r.x for r in window.collect()) == [305, 306, 307, 308, 309, 400, 401, 402, 403]
    assert window.rdd.getNumPartitions() == 2


def test_las_write_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"c{i % 2}", float(x), float(y), float(z), int(c), bool(i % 7 == 0)) for i, (x, y, z, c) in enumerate(
        zip(rng.integers(0, 90000, 500) / 100 + 4e6, rng.integers(-30000, 0, 500) / 100, rng.integers(0, 9999, 500) / 100, rng.integers(0, 70, 500)))]
    points = spark.createDataFrame(rows, las.SCHEMA)
    for _ in range(2):  # a repeated write leaves the same files
        written = las.write_las(points, str(tmp_path / "out"), tile_m=100.0, per_file=60).collect()
    assert len(list((tmp_path / "out").glob("*.las"))) == len(written) > 6 and max(r.n_points for r in written) <= 60
    back = las.read_las(spark, str(tmp_path / "out")).collect()
    got = sorted((r.cloud_id.split("_")[0], round(r.x, 2), round(r.y, 2), round(r.z, 2), r.cls, r.withheld) for r in back)
    assert got == sorted((c, round(x, 2), round(y, 2), round(z, 2), k, w) for c, x, y, z, k, w in rows)
    heads = {r.cloud_id: r for r in las.las_headers(spark, str(tmp_path / "out")).collect()}
    assert {n: (h.n_points, round(h.min_x, 2), round(h.max_y, 2)) for n, h in heads.items()} == {r.cloud_id: (r.n_points, round(r.min_x, 2), round(r.max_y, 2)) for r in written}


def test_compressed_las_is_refused(tmp_path):
    las_file(tmp_path / "a.las", [1.0], [1.0], [1.0], [2])
    data = bytearray((tmp_path / "a.las").read_bytes())
    data[104] |= 0x80
    with pytest.raises(ValueError, match="compressed"):
        las.parse_header(bytes(data))


def test_xyz_last_line_wins(spark, tmp_path):
    from reliefspark.operators.points import grid_from_text

    (tmp_path / "t.xyz").write_text("0 0 1\n2  0  2\n0 2 3\n2 2 oops\n0 0 9\n")
    rows = grids.read_xyz(spark, str(tmp_path / "t.xyz"))
    counts = grids.bad_line_count(rows).first()
    assert (counts.n_bad, counts.n_lines) == (1, 5)
    cells = {(r.row, r.col): r for r in grid_from_text(rows.filter("not bad")).collect()}
    assert cells[(1, 0)].z == 9.0 and cells[(1, 0)].res == 2.0 and cells[(1, 0)].left == -1.0 and cells[(1, 0)].top == 3.0


def test_csv_tile_and_ascii_grid(spark, tmp_path):
    folder = tmp_path / "15" / "7"
    folder.mkdir(parents=True)
    (folder / "9.txt").write_text("\n".join(",".join("e" if (i + j) % 2 else str(i) for j in range(256)) for i in range(256)))
    cells = grids.read_csv_tiles(spark, str(folder))
    assert cells.count() == 32768 and cells.agg(F.min("row"), F.min("col")).first() == (9 * 256, 7 * 256)
    (tmp_path / "g.asc").write_text("NCOLS 3\nNROWS 2\nXLLCENTER 11\nYLLCENTER 21\nCELLSIZE 2\nNODATA_VALUE -1\n1 2 3\n4 -1 6\n")
    asc = grids.read_ascii_grids(spark, str(tmp_path / "g.asc"), 2154).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.z) for r in asc] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 2, 6)]
    assert (asc[0].left, asc[0].top, asc[0].epsg) == (10.0, 24.0, 2154)


def test_text_grids_over_many_splits(spark, tmp_path):
    """A grid whose lines break anywhere, read by many tasks; a blank line and several files stand between."""
    nx, ny = 90, 400
    z = np.arange(nx * ny) * 7 % 1000
    for k in range(3):
        rows = [" ".join(map(str, z[i:i + 53 + k])) + " " for i in range(0, nx * ny, 53 + k)]
        head = f"ncols {nx}\nnrows {ny}\nxllcorner {k}\nyllcorner 0\ncellsize 1\n"
        (tmp_path / f"g{k}.asc").write_text(head + "\n".join(rows[:9]) + "\n\n" + "\n".join(rows[9:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        lines = grids.numbered_lines(spark, str(tmp_path), " ")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        cells = grids.read_ascii_grids(spark, str(tmp_path), 2154).toPandas()
        numbers = lines.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("line").alias("d"), F.max("line").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(numbers) == 3 and all(r.n == r.d == r.m + 1 for r in numbers)
    for _, one in cells.groupby("raster_id"):
        got = np.full((ny, nx), -1)
        got[one.row, one.col] = one.z
        assert (got.ravel() == z).all()


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


LINE = {"type": "Feature", "properties": {"highway": "track"}, "geometry": {"type": "LineString", "coordinates": [[6.04, 43.326], [6.045, 43.33, 12]]}}
HOLED = {"type": "Feature", "properties": {"building": "yes"}, "geometry": {"type": "MultiPolygon", "coordinates": [
    [[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]]}}


def test_geojson_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(collection(LINE))
    with gzip.open(tmp_path / "b.geojson.gz", "wt") as f:
        f.write(collection(HOLED, LINE))
    rows = SF.read_features(spark, str(tmp_path / "*.geojson*")).orderBy("source", "kind").collect()
    assert [(r.source, r.kind, len(r.rings), len(r.rings[0])) for r in rows] == [
        ("a.geojson", "LineString", 1, 2), ("b.geojson.gz", "LineString", 1, 2), ("b.geojson.gz", "Polygon", 2, 4)]
    (tmp_path / "c.geojson").write_text("{broken")
    with pytest.raises(Exception):
        SF.read_features(spark, str(tmp_path / "c.geojson")).collect()


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(collection(LINE, HOLED))
    read = SF.read_features(spark, str(tmp_path / "a.geojson")).withColumn("key", F.element_at(F.map_keys("props"), 1))
    writers.write_geojson(read, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "all")).collect()]
    assert {f["geometry"]["type"] for f in lines} == {"LineString", "Polygon"}
    assert [len(f["geometry"]["coordinates"]) for f in lines if f["geometry"]["type"] == "Polygon"] == [2]
    one = spark.read.text(str(tmp_path / "out" / "by_key" / "key=highway"))
    assert one.count() == 1
    back = SF.read_feature_lines(spark, str(tmp_path / "out" / "all")).select("kind", "rings", "props").collect()
    assert sorted(back) == sorted(read.select("kind", "rings", "props").collect())
    with pytest.raises(Exception, match="no feature collection"):
        SF.read_features(spark, str(tmp_path / "out" / "all")).collect()


def test_parts_of_multi_geometries(spark, tmp_path):
    def feature(kind, coordinates):
        return {"type": "Feature", "properties": {"k": "v"}, "geometry": {"type": kind, "coordinates": coordinates}}

    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "m.geojson").write_text(collection(
        feature("MultiPolygon", [[square, square], [square]]), feature("MultiPoint", [[1, 2], [3, 4], [5, 6]]), feature("Point", [7, 8]), feature("MultiLineString", [square[:2], square])))
    rows = SF.read_features(spark, str(tmp_path / "m.geojson")).collect()
    assert sorted((r.kind, r.part, [len(x) for x in r.rings]) for r in rows) == [
        ("LineString", 0, [2]), ("LineString", 1, [4]), ("Point", 0, [1]), ("Point", 0, [1]), ("Point", 1, [1]), ("Point", 2, [1]), ("Polygon", 0, [4, 4]), ("Polygon", 1, [4])]
    several = spark.createDataFrame([("Point", [[{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]], {"a": "b"})], "kind string, rings array<array<struct<x:double,y:double>>>, props map<string,string>")
    assert json.loads(writers.feature_json(several).first().json)["geometry"] == {"type": "MultiPoint", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}


def test_map_object_xml(spark, tmp_path):
    (tmp_path / "m.osm").write_text(
        '<osm><node id="1" lat="43.0" lon="6.0"><tag k="natural" v="tree"/></node><node id="2" lat="43.1" lon="6.1"/>'
        '<way id="9"><nd ref="2"/><nd ref="1"/><tag k="highway" v="path"/></way><way id="8"><nd ref="1"/><nd ref="2"/><tag k="a" v="b"/><tag k="c" v="d"/></way></osm>')
    t = SF.read_map_objects(spark, str(tmp_path / "m.osm"))
    assert t["nodes"].count() == 2 and t["tags"].count() == 4
    from reliefspark.operators.vector import way_lines

    lines = {r.way_id: [(p.x, p.y) for p in r.line] for r in way_lines(t["way_nodes"], t["nodes"]).collect()}
    assert lines[9] == [(6.1, 43.1), (6.0, 43.0)]


def test_indexes_from_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"features": [
        {"properties": {"url": "u1", "name": "LHD_FXX_0932_6257_MNT", "projection": "epsg:2154"}, "geometry": None},
        {"properties": {"url": "u2", "name": "LHD_REU_0001_0002_MNT", "projection": "EPSG:2975"}}, {"properties": {"name": "LHD_FXX_1_2_"}}]}))
    rows = indexes.geojson_index_rows(indexes.read_documents(spark, str(tmp_path / "i.json")), 2154).collect()
    assert [(r.key_x, r.key_y, r.url) for r in rows] == [(932, 6257, "u1")]
    (tmp_path / "y.gml").write_text("".join(
        f"<wfs:member><g><gml:lowerCorner>{x}.5 2.5</gml:lowerCorner><a:url_do_pobrania>http://{x}</a:url_do_pobrania></g></wfs:member>" for x in (1, 2, 2)))
    members = indexes.read_members(spark, str(tmp_path / "y.gml"))
    assert {(r.x, r.y, r.url) for r in indexes.gml_index_rows(members, F.lit(2019)).collect()} == {(1, 2, "http://1"), (2, 2, "http://2")}
    (tmp_path / "s.xml").write_text('<feed><entry><title>DTM_1_2</title><link href="x.html" type="text/html"/><link href="sub.xml" type="application/atom+xml"/></entry></feed>')
    entries = indexes.read_atom(spark, str(tmp_path / "s.xml"))
    assert indexes.atom_links(entries, "atom+xml").first().href == "sub.xml"


def test_stac_surveys_stay_apart(spark):
    def item(tag, i):
        return {"id": f"Survey{tag}_{i}_{i}-{i}", "assets": {"dtm": {"href": f"{tag}{i}", "type": "t"}}}

    docs = spark.createDataFrame([("A", json.dumps({"features": [item("A", 1), item("A", 2)]})), ("B", json.dumps({"features": [item("B", 3), item("B", 4)]}))], "box string, doc string")
    rows = {}
    for box in "AB":
        d = indexes.parsed_json(docs.filter(F.col("box") == box), "doc", indexes.FEATURE_SCHEMA)
        rows[box] = {r.url for r in indexes.stac_asset_rows(d, lambda name, a: name == "dtm", r"_(\d+)_(\d+)-(\d+)").collect()}
    assert rows == {"A": {"A1", "A2"}, "B": {"B3", "B4"}}


def test_points_table_prunes_by_window(spark, tmp_path):
    cloud = spark.range(4000).selectExpr("'c' as cloud_id", "(id % 40)*100e0 as x", "floor(id/40)*40e0 as y", "1e0 as z", "2 as cls", "false as withheld")
    grids.write_points(cloud, str(tmp_path / "p"))
    window = grids.read_points(spark, str(tmp_path / "p"), (500.0, 500.0, 1500.0, 900.0))
    assert window.count() == cloud.filter("x between 500 and 1500 and y between 500 and 900").count() > 0
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_x" in plan and "PushedFilters: [IsNotNull(x)" in plan
    both = grids.read_points(spark, [str(tmp_path / "p"), str(tmp_path / "p")])
    assert both.count() == 8000


def test_raster_and_tile_writers(spark, tmp_path):
    blocks = spark.createDataFrame([("r", 0, 0, [1.0, None]), ("r", 1, 0, [2.0, 3.0])], "raster_id string, brow long, bcol long, z array<double>")
    writers.write_raster(writers.checked_raster(blocks, "z"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    bad = blocks.withColumn("z", F.array(F.lit(-9999.0)))
    with pytest.raises(Exception, match="implausible"):
        writers.write_raster(writers.checked_raster(bad, "z"), str(tmp_path / "bad"))
    tiles = spark.createDataFrame([(12, 5, 7, 4088, bytearray(b"a"))], "zoom int, x long, y long, row long, data binary").withColumn("col", F.col("x"))
    writers.write_tiles(tiles, spark.createDataFrame([("name", "n")], "name string, value string"), str(tmp_path / "t"))
    stored, meta = SF.read_tile_set(spark, str(tmp_path / "t"))
    assert stored.count() == 1 and meta.count() == 1
    writers.write_sqlitedb_tables(tiles, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q" / "tiles")).first().y == 4095 - 4088


def test_manifest_runs_stay_apart(spark, tmp_path):
    for run in ("a", "b", "a"):
        writers.write_manifest(spark.createDataFrame([("001x001", True)], "chunk string, done boolean"), str(tmp_path / "m"), run)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_only_new_files_are_processed(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "x double, z double"

    def land(value):
        spark.createDataFrame([(value, value)], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        process_new_tiles(spark, source, schema, target, progress, lambda df: df.withColumn("y", F.col("x") * 2))

    land(1.0)
    run()
    land(2.0)
    run()
    run()
    assert sorted(r.y for r in spark.read.parquet(target).collect()) == [2.0, 4.0]


def test_projected_layer(spark):
    ring = [[{"x": 700000.0, "y": 6600000.0}]]
    df = spark.createDataFrame([("roads", ring), ("other", ring)], "layer string, rings array<array<struct<x:double,y:double>>>")
    p = SF.read_layer(df, "roads").first().rings[0][0]
    assert p.x == pytest.approx(3.0, abs=1e-7) and p.y == pytest.approx(46.5, abs=1e-7)


def test_utm_and_envelope(spark):
    row = spark.range(1).select(geo.transverse_mercator_from_lonlat(F.lit(6.04), F.lit(43.33), F.lit(9.0)).alias("t")).select(
        "t.*", geo.lonlat_from_transverse_mercator("t.x", "t.y", F.lit(9.0)).alias("b")).first()
    assert row.b.lon == pytest.approx(6.04, abs=1e-9) and row.b.lat == pytest.approx(43.33, abs=1e-9)

    def bulge(x, y):
        return F.struct(x.alias("x"), (y + F.sin(x / 10.0 * F.pi())).alias("y"))

    def top(samples):
        box = geo.bbox_lit((0, 0, 10, 1))
        return spark.range(1).select(geo.bbox_transform_envelope(box, bulge, samples=samples).alias("e")).first().e.y1

    assert top(21) > 1.99 and abs(top(1) - 1.0) < 1e-3
