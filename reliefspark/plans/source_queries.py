"""Registered source and sink queries: index documents, text grids and outputs built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliefspark.functions import geo, geom
from reliefspark.operators import points as P
from reliefspark.operators import vector as V
from reliefspark.operators.blocks import blocks_to_cells, cells_to_blocks
from reliefspark.plans import fixtures as fx
from reliefspark.plans.fixtures import FEATURES, INDEX, PTS
from reliefspark.plans.registry import query
from reliefspark.session import staging_folder, table
from reliefspark.sinks import writers
from reliefspark.sources import features as SF
from reliefspark.sources import grids, indexes, las

# -- index documents ------------------------------------------------------------------------------

_GEOJSON_DOC = """concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[',
    cast(key_x*1000 as string), '.5,', cast(key_y*1000 as string), '],[', cast(key_x*1000+1000 as string), ',', cast(key_y*1000+1000 as string), ',12.5]]]},"properties":{"name":"LHD_FXX_',
    lpad(cast(key_x as string), 4, '0'), '_', lpad(cast(key_y as string), 4, '0'), '_MNT","projection":"', case when order_id % 3 = 0 then 'EPSG:2975' else 'epsg:2154' end,
    '"', case when order_id % 7 = 0 then '' else concat(',"url":"', url, '"') end, ',"NR":"', cast(key_x*100 + key_y as string), '","ALS_TAVA_1":"', cast(vintage as string), '"',
    case when order_id % 4 = 0 then ',"ALS_TAVA_2":"2020"' else '' end, '}}]}') as doc"""


def _docs(spark, sf_dir, expression, schema):
    """Documents written to the shared folder, one per line, and scanned from there."""
    folder = staging_folder(spark, "documents")
    fx.tile_index(spark, sf_dir).selectExpr(expression).write.text(folder)
    return indexes.read_document_lines(spark, folder, schema)


@query("source_geojson_index", f"with {INDEX} select key_x, key_y, url from idx where order_id % 3 <> 0 and order_id % 7 <> 0")
def _geojson(spark, sf_dir):
    # lpad cuts what is longer: keys of five digits must stay whole
    doc = _GEOJSON_DOC
    for key in ("key_x", "key_y"):
        doc = doc.replace(f"lpad(cast({key} as string), 4, '0')", f"lpad(cast({key} as string), greatest(4, length(cast({key} as string))), '0')")
    return indexes.geojson_index_rows(_docs(spark, sf_dir, doc, indexes.FEATURE_SCHEMA), 2154)


@query("source_sheet_polygons", f"""with {INDEX} select cast(key_x*100 + key_y as string) as number, cast(case when order_id % 4 = 0 and vintage < 2020 then 2020 else vintage end as int) as year, key_x, key_y,
    key_x*1e3 + 5e-1 as x0, key_y*1e3 + 1e3 as y1 from idx""")
def _sheets(spark, sf_dir):
    rows = indexes.sheet_polygon_rows(_docs(spark, sf_dir, _GEOJSON_DOC, indexes.FEATURE_SCHEMA), "NR", ["ALS_TAVA_1", "ALS_TAVA_2", "ALS_TAVA_3"])
    return rows.select("number", "year", "key_x", "key_y", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"))


_MEMBER = """concat('<wfs:member><gugik:Skorowidz><gml:boundedBy><gml:Envelope><gml:lowerCorner>', cast(key_x*1000 as string), '.75 ', cast(key_y*1000 as string), '.25</gml:lowerCorner></gml:Envelope></gml:boundedBy>',
    case when order_id % 11 = 0 then '' else concat('<gugik:url_do_pobrania> ', url, ' </gugik:url_do_pobrania>') end, '</gugik:Skorowidz>') as value"""


def _landed_lines(spark, rows, *by, spread=False):
    """A text column written to the shared folder, in a folder per value of the columns ``by``.

    With ``spread`` a folder holds several files: where values are few, no task gets all lines of one.
    """
    folder = staging_folder(spark, "lines")
    if spread:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(width, *by, F.pmod(F.xxhash64(*rows.columns), F.lit(width)))
    elif by:
        rows = rows.repartition(*by)
    rows.write.partitionBy(*by).text(folder)
    return folder


def _landed_documents(rows, folder, head, tail):
    """``name, value`` rows as files with a first and a last line around them."""
    body = rows.select("name", F.monotonically_increasing_id().alias("line"), "value")
    edges = [F.struct(F.lit(line).cast("bigint").alias("line"), F.lit(text).alias("value")) for line, text in ((-1, head), (1 << 62, tail))]
    around = rows.select("name").distinct().select("name", F.explode(F.array(*edges)).alias("e")).select("name", "e.*")
    return fx.land(body.unionByName(around), folder)


@query("source_gml_members", f"""with {INDEX}, r as (select *, row_number() over (partition by key_x, key_y order by vintage desc, url) as n from idx where order_id % 11 <> 0)
    select key_x*1000 as x, key_y*1000 as y, vintage as year, url from r where n = 1""")
def _members(spark, sf_dir):
    """Files by vintage, cut at the closing tags of its members; members without a link drop out."""
    folder = _landed_lines(spark, fx.tile_index(spark, sf_dir).selectExpr(_MEMBER.replace("</gugik:Skorowidz>'", "</gugik:Skorowidz></wfs:member>'"), "vintage"), "vintage", spread=True)
    m = indexes.read_members(spark, folder)
    return indexes.gml_index_rows(m, F.regexp_extract("file", r"vintage=(\d+)", 1).cast("bigint")).select("x", "y", "year", "url")


_STAC = """concat('{"features":[{"id":"swissalti3d_', cast(vintage as string), '_', cast(key_x as string), '-', cast(key_y as string), '","assets":{"swissalti3d_', cast(vintage as string), '_', cast(key_x as string), '-', cast(key_y as string),
    '_0.5_2056.tif":{"href":"', url, '","type":"image/tiff"},"preview_', cast(order_id as string), '.png":{"href":"x","type":"image/png"}}}]}') as doc"""


@query("source_stac_assets", f"""with {INDEX}, r as (select *, row_number() over (partition by key_x, key_y order by vintage desc, url) as n from idx)
    select key_x, key_y, vintage as year, 'swissalti3d_' || vintage || '_' || key_x || '-' || key_y || '_0.5_2056.tif' as asset, url from r where n = 1""")
def _stac(spark, sf_dir):
    docs = _docs(spark, sf_dir, _STAC, indexes.FEATURE_SCHEMA)
    rows = indexes.stac_asset_rows(docs, lambda name, asset: name.endswith("_0.5_2056.tif"), r"swissalti3d_(\d+)_(\d+)-(\d+)")
    return rows.select("key_x", "key_y", "year", "asset", "url")


@query("source_atom_feeds", f"""with {INDEX} select 'DTM_' || key_x as key, url from idx where key_x % 5 <> 0 and order_id % 6 <> 0""")
def _atom(spark, sf_dir):
    """A service feed and the dataset feeds it names, landed as files and scanned entry by entry."""
    idx = fx.tile_index(spark, sf_dir)

    def feed(name, title, links):
        entry = F.concat(F.lit("  <entry>\n    <title>"), title, F.lit("</title>\n    "), links, F.lit("\n  </entry>"))
        return name.alias("name"), entry.alias("value")

    def link(href, kind):
        return F.concat(F.lit('<link href="'), href, F.lit(f'" type="{kind}" rel="alternate"/>'))

    datasets = F.concat(F.lit("data/feed_"), F.col("key_x").cast("string"), F.lit(".xml"))
    title = F.concat(F.when(F.col("key_x") % 5 == 0, "DSM_").otherwise("DTM_"), F.col("key_x").cast("string"))
    service = idx.select("key_x").distinct().select(*feed(F.lit("service.xml"), title, F.concat(link(F.lit("page"), "text/html"), link(datasets, "application/atom+xml"))))
    files = idx.select(*feed(datasets, F.lit("file &amp; more"), F.when(F.col("order_id") % 6 == 0, link(F.lit("x"), "application/pdf")).otherwise(link(F.col("url"), "image/tiff"))))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">'
    folder = _landed_documents(service.unionByName(files), staging_folder(spark, "atom"), head, "</feed>")
    relative = F.regexp_extract("feed", r"(data/[^/]+)$", 1)
    return indexes.atom_index_rows(indexes.read_atom(spark, f"{folder}/service.xml"), indexes.read_atom(spark, f"{folder}/data").withColumn("feed", relative), r"^(DTM_\d+)$")


@query("source_metalink_keys", f"with {INDEX} select distinct key_x, key_y from idx")
def _metalink(spark, sf_dir):
    lines = fx.tile_index(spark, sf_dir).selectExpr("""concat('<file name="', cast(key_x as string), '_', cast(key_y as string), '.tif"><url>', url, '</url></file>') as value""")
    return indexes.name_keys(spark.read.text(_landed_lines(spark, lines)))


@query("source_file_list", f"with {INDEX} select 'dgm1_32_' || key_x || '_' || key_y || '_1_nw.zip' as name, key_x, key_y, order_id as size from idx")
def _file_list(spark, sf_dir):
    doc = """concat('{"datasets":[{"name":"dgm","files":[{"name":"dgm1_32_', cast(key_x as string), '_', cast(key_y as string), '_1_nw.zip","size":', cast(order_id as string), '},{"name":"readme.txt","size":1}]}]}') as doc"""
    return indexes.file_list_rows(_docs(spark, sf_dir, doc, indexes.FILE_LIST_SCHEMA), r"^dgm1_32_(\d+)_(\d+)_")


@query("source_attribute_features", f"""with {INDEX} select 'N' || key_x as NAME, cast(key_y as string) as BLOK, case when order_id % 2 = 0 then url else 'alt/' || order_id end as url from idx where order_id % 9 <> 0""")
def _attributes(spark, sf_dir):
    doc = """concat('{"features":[{"attributes":{"NAME":"N', cast(key_x as string), '","BLOK":"', cast(key_y as string), '"',
      case when order_id % 9 = 0 then '' when order_id % 2 = 0 then concat(',"URL_A":"', url, '"') else concat(',"URL_A":" ","URL_B":"alt/', cast(order_id as string), '"') end, '}}]}') as doc"""
    return indexes.attribute_rows(_docs(spark, sf_dir, doc, indexes.FEATURE_SCHEMA), ["NAME", "BLOK"], ["URL_A", "URL_B"])


@query("source_object_listing", f"with {INDEX} select 'NR' || lpad(cast(key_x as string), 2, '0') || lpad(cast(key_y % 100 as string), 2, '0') as ref, 'https://s3.example/lidar/dtm/NR' || lpad(cast(key_x as string), 2, '0') || lpad(cast(key_y % 100 as string), 2, '0') || '_50CM_' || order_id || '.tif' as url from idx")
def _listing(spark, sf_dir):
    keys = fx.tile_index(spark, sf_dir).selectExpr("concat('lidar/dtm/NR', lpad(cast(key_x as string), 2, '0'), lpad(cast(key_y % 100 as string), 2, '0'), '_50CM_', cast(order_id as string), '.tif') as value")
    return indexes.listing_rows(spark.read.text(_landed_lines(spark, keys)), "https://s3.example")


@query("source_cloud_names", f"with {INDEX} select distinct (2400 + key_x) || '-' || key_y % 2 || order_id % 2 || '-' || 1 + order_id % 5 || 1 + key_y % 5 as name, cast(2400 + key_x as string) as sheet from idx where order_id % 13 <> 0")
def _cloud_names(spark, sf_dir):
    lines = fx.tile_index(spark, sf_dir).selectExpr("""case when order_id % 13 = 0 then 'https://s3.example/readme.txt' else concat('https://s3.example/las/', cast(2400 + key_x as string), '/', cast(2400 + key_x as string), '-',
      cast(key_y % 2 as string), cast(order_id % 2 as string), '-', cast(1 + order_id % 5 as string), cast(1 + key_y % 5 as string), '.las') end as value""")
    return indexes.cloud_name_rows(spark.read.text(_landed_lines(spark, lines)))


# -- text heights ---------------------------------------------------------------------------------

@query("source_xyz_text", f"""with {PTS} select cloud_id, cls, count(*) filter (where suppkey % 9 <> 0) as n_points, count(*) filter (where suppkey % 9 = 0) as n_bad,
    cast(floor(sum(case when suppkey % 9 <> 0 then cast(round_even(z*1e2, 0) as bigint) end)) as bigint) as z_sum_cm from pts group by all""")
def _xyz(spark, sf_dir):
    text = fx.points(spark, sf_dir).selectExpr(
        "cloud_id", "cls", """case when suppkey % 9 = 0 then concat(cast(x as string), ' oops') when suppkey % 2 = 0 then concat(cast(x as string), ' ', cast(y as string), '  ', cast(z as string))
        else concat(cast(x as string), ';', cast(y as string), ';', cast(z as string)) end as value""")
    # one folder a cloud and class, as deliveries sort them; what stands in the folder names comes from the paths of the lines
    rows = grids.read_xyz(spark, _landed_lines(spark, text, "cloud_id", "cls"))
    cloud, cls = F.regexp_extract("cloud_id", r"cloud_id=(\w+)", 1), F.regexp_extract("cloud_id", r"cls=(\d+)", 1).cast("int")
    return rows.groupBy(cloud.alias("cloud_id"), cls.alias("cls")).agg(
        F.count_if(~F.col("bad")).alias("n_points"), F.count_if("bad").alias("n_bad"),
        F.sum(F.when(~F.col("bad"), F.bround(F.col("z") * 100.0, 0).cast("bigint"))).alias("z_sum_cm"))


_CSV_VALUE = "case when (r + c + t) % 4 = 0 then 'e' else cast((r*7 + c*13 + t) % 1000 as string) end"


@query("source_csv_height_tiles", """with t as (select distinct cast(floor(s_suppkey/25e0) as bigint) as t from supplier),
    c as (select t, r, c, (r*7 + c*13 + t) % 1000 as z from t, range(256) a(r), range(256) b(c) where (r + c + t) % 4 <> 0)
    select 15 as zoom, t % 4 as tile_x, t as tile_y, count(*) as n_cells, cast(sum(z) as bigint) as z_sum, cast(sum(r*z) as bigint) as rz_sum, cast(sum(c*z) as bigint) as cz_sum from c group by t""")
def _csv_tiles(spark, sf_dir):
    """Tiles of 256 lines of 256 values, landed as files named by zoom, column and row."""
    tiles = table(spark, sf_dir, "supplier").selectExpr("cast(floor(s_suppkey/25e0) as bigint) as t").distinct().selectExpr("t", "explode(sequence(0L, 255L)) as r")
    lines = tiles.selectExpr("concat('15/', cast(t % 4 as string), '/', cast(t as string), '.txt') as name", "r as line", f"array_join(transform(sequence(0L, 255L), c -> {_CSV_VALUE}), ',') as value")
    cells = grids.read_csv_tiles(spark, f"{fx.land(lines, staging_folder(spark, 'height-tiles'))}/15/*/*.txt")
    row, col, z = F.col("row") % 256, F.col("col") % 256, F.col("z")
    return cells.groupBy("zoom", F.floor(F.col("col") / 256).alias("tile_x"), F.floor(F.col("row") / 256).alias("tile_y")).agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.sum(v).cast("bigint").alias(n) for v, n in ((z, "z_sum"), (row * z, "rz_sum"), (col * z, "cz_sum"))])


@query("source_ascii_grids", """with t as (select distinct cast(floor(s_suppkey/25e0) as bigint) as t from supplier),
    c as (select t, r, c, (r*3 + c*11 + t) % 900 as z from t, range(120) a(r), range(200) b(c) where (r + c + t) % 5 <> 0)
    select 'g' || t as raster_id, t*1e0 as "left", 100e0 + 240e0 as top, 2e0 as res, 2154 as epsg, count(*) as n_cells, cast(sum(z) as bigint) as z_sum, cast(sum(r*z) as bigint) as rz_sum,
    cast(sum(c*z) as bigint) as cz_sum from c group by t""")
def _ascii(spark, sf_dir):
    """Grids landed as files; every other one breaks its lines after 37 values instead of at the end of a row."""
    t = table(spark, sf_dir, "supplier").selectExpr("cast(floor(s_suppkey/25e0) as bigint) as t").distinct()
    head = t.selectExpr("t", "posexplode(array('ncols 200', 'NROWS  120', concat('xllcorner ', cast(t as string)), 'yllcorner 100', 'cellsize 2', 'NODATA_value -9999')) as (line, value)")
    values = "transform(sequence(line*w, least(line*w + w, 24000) - 1), i -> case when (floor(i/200) + i % 200 + t) % 5 = 0 then '-9999' else cast((floor(i/200)*3 + i % 200 * 11 + t) % 900 as string) end)"
    body = t.selectExpr("t", "case when t % 2 = 0 then 200L else 37L end as w").selectExpr("t", "w", "explode(sequence(0L, cast(ceil(24000/w) as bigint) - 1)) as line")
    lines = head.selectExpr("t", "cast(line as bigint) as line", "value").unionByName(body.selectExpr("t", "line + 6 as line", f"array_join({values}, ' ') as value"))
    cells = grids.read_ascii_grids(spark, fx.land(lines.selectExpr("concat('g', cast(t as string), '.asc') as name", "line", "value"), staging_folder(spark, "ascii-grids")), 2154)
    z = F.col("z")
    return cells.groupBy("raster_id", "left", "top", "res", "epsg").agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.sum(v).cast("bigint").alias(n) for v, n in ((z, "z_sum"), (F.col("row") * z, "rz_sum"), (F.col("col") * z, "cz_sum"))])


@query("source_block_window", f"""with {PTS}, c as (select cast(floor(-y/2e0) as bigint) r, cast(floor(x/2e0) as bigint) k, min(z) as z from pts group by all)
    select cast(floor(r/5e1) as bigint) as brow, cast(floor(k/5e1) as bigint) as bcol, count(*) as n_cells, cast(sum(cast(floor(z*1e3 + 5e-1) as bigint)) as bigint) as z_sum_mm from c
    where r between 60 and 140 and k between 10 and 99 group by all""")
def _block_window(spark, sf_dir):
    """A window of a stored raster: its blocks lie in folders of 4 x 4, so only those that the window meets are read."""
    lowest = P.bin_min(fx.points(spark, sf_dir), fx.GRID, {"z": range(256)})
    folder = staging_folder(spark, "blocks")
    grids.write_blocks(cells_to_blocks(lowest, ["z"], 50), folder)
    blocks = grids.read_blocks(spark, folder, (60, 140), (10, 99), 50)
    cells = blocks_to_cells(blocks, ["z"], 50).filter("row between 60 and 140 and col between 10 and 99")
    return cells.groupBy(geo.floor_long(F.col("row") / F.lit(50)).alias("brow"), geo.floor_long(F.col("col") / F.lit(50)).alias("bcol")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(F.floor(F.col("z") * 1000.0 + 0.5).cast("bigint")).alias("z_sum_mm"))


@query("cloud_window_scan", f"""with {PTS} select cls, count(*) as n_points, min(z) as z_min, max(x) as x_max from pts
    where x between 100 and 300.05 and y between -300 and -100.05 group by cls""")
def _window_scan(spark, sf_dir):
    """A window of a stored cloud: whole tiles are left out by partition, the rest by Parquet statistics."""
    folder = staging_folder(spark, "cloud")
    grids.write_points(fx.points(spark, sf_dir), folder, tile_m=100.0)
    window = grids.read_points(spark, folder, (100, -300, 300.05, -100.05), tile_m=100.0)
    return window.groupBy("cls").agg(F.count(F.lit(1)).alias("n_points"), F.min("z").alias("z_min"), F.max("x").alias("x_max"))


@query("source_las_window", f"""with {PTS} select cls, withheld, count(*) as n_points, min(cast(floor(z*1e2 + 5e-1) as bigint)) as z_min_cm, max(cast(floor(x*1e2 + 5e-1) as bigint)) as x_max_cm,
    cast(sum(cast(floor(y*1e2 + 5e-1) as bigint)) as bigint) as y_sum_cm from pts where x between 100 and 300 and y between -300 and -100 group by all""")
def _las_window(spark, sf_dir):
    """Clouds landed as LAS files; the box prunes files by their headers, then records."""
    folder = staging_folder(spark, "las")
    las.write_las(fx.points(spark, sf_dir), folder, tile_m=50.0)
    window = las.read_las(spark, folder, (100, -300, 300, -100))

    def cm(name):
        return F.floor(F.col(name) * 100.0 + 0.5).cast("bigint")

    return window.groupBy("cls", "withheld").agg(
        F.count(F.lit(1)).alias("n_points"), F.min(cm("z")).alias("z_min_cm"), F.max(cm("x")).alias("x_max_cm"), F.sum(cm("y")).cast("bigint").alias("y_sum_cm"))


@query("source_las_headers", f"""with {PTS} select cast(sum(1) as bigint) as n_files, cast(sum(n) as bigint) as n_points, cast(sum(x0) as bigint) as x_min_sum_cm, cast(sum(y1) as bigint) as y_max_sum_cm from (
    select cloud_id, floor(y/5e1) as strip, count(*) as n, min(cast(floor(x*1e2 + 5e-1) as bigint)) as x0, max(cast(floor(y*1e2 + 5e-1) as bigint)) as y1 from pts group by all)""")
def _las_headers(spark, sf_dir):
    """What the headers of landed clouds say, without a look at the points."""
    folder = staging_folder(spark, "las")
    las.write_las(fx.points(spark, sf_dir), folder, tile_m=50.0)
    heads = las.las_headers(spark, folder)
    x0, y1 = F.floor(F.col("min_x") * 100.0 + 0.5).cast("bigint"), F.floor(F.col("max_y") * 100.0 + 0.5).cast("bigint")
    sums = [F.sum(F.lit(1)), F.sum("n_points"), F.sum(x0), F.sum(y1)]
    return heads.agg(*[s.cast("bigint").alias(n) for s, n in zip(sums, ("n_files", "n_points", "x_min_sum_cm", "y_max_sum_cm"))])


@query("several_clouds_as_one", f"""with {PTS} select cloud_id, count(*) as n_points, min(z) as z_min, count(suppkey) as n_supp from pts group by cloud_id""")
def _several(spark, sf_dir):
    """Clouds stored apart and read as one."""
    cloud, folders = fx.points(spark, sf_dir), []
    for part in range(2):
        folders.append(staging_folder(spark, f"cloud-{part}"))
        grids.write_points(cloud.filter(F.col("suppkey") % 2 == part), folders[-1], tile_m=100.0)
    return grids.read_points(spark, folders).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("z").alias("z_min"), F.count("suppkey").alias("n_supp"))


@query("source_geojson_features", f"""with {FEATURES} select feature_id, 'file_' || feature_id % 3 || '.geojson' as source, case when feature_id % 2 = 0 then 'LineString' else 'Polygon' end as kind, key as tag,
    case when feature_id % 2 = 0 then 2 else 4 end as n_vertices, cast(floor((feature_id % 90)*1e1 + 5e-1) as bigint) as x0 from feat""")
def _features(spark, sf_dir):
    doc = """concat('{"features":[{"geometry":{"type":"', case when feature_id % 2 = 0 then 'LineString' else 'MultiPolygon' end, '","coordinates":',
      case when feature_id % 2 = 0 then '[[X,1],[Y,2.5]]' else '[[[[X,1],[Y,1],[Y,2],[X,1]]]]' end, '},"properties":{"fid":"', cast(feature_id as string), '","tag":"', key, '"}}]}') as doc"""
    f = fx.features(spark, sf_dir).selectExpr("feature_id", "key", "concat('dir/file_', cast(feature_id % 3 as string), '.geojson') as file", doc)
    f = f.withColumn("doc", F.replace(F.replace("doc", F.lit("X"), (F.col("feature_id") % 90).cast("string")), F.lit("Y"), (F.col("feature_id") % 90 + 1).cast("string")))
    rows = SF.feature_rows(indexes.parsed_json(f.select("file", "doc"), "doc", indexes.FEATURE_SCHEMA))
    return rows.select(F.col("props")["fid"].cast("bigint").alias("feature_id"), "source", "kind", F.col("props")["tag"].alias("tag"),
                       F.size(F.element_at("rings", 1)).alias("n_vertices"), F.floor(geom.rings_bbox("rings").x0 * 10.0 + 0.5).cast("bigint").alias("x0"))


def _stored_lines(spark, features):
    """The features after a write to the shared folder and a read."""
    folder = staging_folder(spark, "features")
    writers.write_geojson(features, folder, by_key=False)
    return SF.read_feature_lines(spark, f"{folder}/all")


@query("geojson_round_trip", f"""with {FEATURES} select feature_id, 'LineString' as kind, 2 as n_vertices, cast(floor(ax*1e7 + 5e-1) as bigint) as x0_1e7,
    cast(floor(ay*1e7 + 5e-1) as bigint) as y0_1e7, cast(floor("by"*1e7 + 5e-1) as bigint) as y1_1e7 from feat
    union all select feature_id, 'Polygon', 3, cast(floor(ax*1e7 + 5e-1) as bigint), cast(floor(ay*1e7 + 5e-1) as bigint), cast(floor(ay*1e7 + 5e-1) as bigint) from feat""")
def _round_trip(spark, sf_dir):
    fid = F.create_map(F.lit("fid"), F.col("feature_id").cast("string"))
    both = fx.line_features(spark, sf_dir).unionByName(fx.ring_features(spark, sf_dir)).withColumn("props", fid)
    ring = F.element_at("rings", 1)

    def step(value):
        return F.floor(value * 1e7 + 0.5).cast("bigint")

    return _stored_lines(spark, both).select(
        F.col("props")["fid"].cast("bigint").alias("feature_id"), "kind", F.size(ring).alias("n_vertices"), step(ring[0].x).alias("x0_1e7"), step(ring[0].y).alias("y0_1e7"), step(ring[1].y).alias("y1_1e7"))


_MULTI = """concat('{"features":[{"geometry":{"type":"MultiPolygon","coordinates":[[[[X,1],[Y,1],[Y,2],[X,1]],[[X,1.25],[X,1.5],[Y,1.5],[X,1.25]]],[[[X,5],[Y,5],[Y,6],[X,5]]]]},"properties":{"fid":"', cast(feature_id as string),
    '"}},{"geometry":{"type":"MultiPoint","coordinates":[[X,7],[Y,8],[X,9]]},"properties":{"fid":"', cast(feature_id as string),
    '"}},{"geometry":{"type":"MultiLineString","coordinates":[[[X,3],[Y,4]],[[Y,5],[X,6],[X,7]]]},"properties":{"fid":"', cast(feature_id as string), '"}}]}') as doc"""


@query("multi_geometry_round_trip", f"""with {FEATURES} select feature_id, kind, part, n_rings, n_vertices, cast(floor(y_sum*1e2 + 5e-1) as bigint) as y_sum_1e2 from feat,
    (values ('Polygon', 0, 2, 8, 10.5e0), ('Polygon', 1, 1, 4, 21e0), ('Point', 0, 1, 1, 7e0), ('Point', 1, 1, 1, 8e0), ('Point', 2, 1, 1, 9e0),
            ('LineString', 0, 1, 2, 7e0), ('LineString', 1, 1, 3, 18e0)) t(kind, part, n_rings, n_vertices, y_sum)""")
def _multi(spark, sf_dir):
    f = fx.features(spark, sf_dir).selectExpr("feature_id", "'m.geojson' as file", _MULTI)
    x = F.col("feature_id") % 90
    f = f.withColumn("doc", F.replace(F.replace("doc", F.lit("X"), x.cast("string")), F.lit("Y"), (x + 1).cast("string")))
    rows = SF.feature_rows(indexes.parsed_json(f.select("file", "doc"), "doc", indexes.FEATURE_SCHEMA))
    kept = F.map_concat("props", F.create_map(F.lit("part"), F.col("part").cast("string")))
    back = _stored_lines(spark, rows.withColumn("props", kept))
    points = F.flatten("rings")
    y_sum = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p.y)
    return back.select(
        F.col("props")["fid"].cast("bigint").alias("feature_id"), "kind", F.col("props")["part"].cast("int").alias("part"), F.size("rings").alias("n_rings"),
        F.size(points).alias("n_vertices"), F.floor(y_sum * 100.0 + 0.5).cast("bigint").alias("y_sum_1e2"))


@query("source_map_object_xml", """with e as (select event_id, user_id, event_type from events),
    n as (select distinct user_id + d as id from e, (values (0), (3), (6)) t(d)),
    v as (select event_id as way_id, event_type as highway, user_id + p*3 as id, p from e, (values (0), (1), (2)) t(p))
    select way_id, highway, count(*) as n_vertices, cast(sum((p + 1)*(id % 360)) as bigint) as lon_sum, cast(sum((p + 1)*(id % 90)) as bigint) as lat_sum,
      count(*) filter (id % 4 = 0) as n_tagged from v join n using (id) where id % 7 <> 0 group by all""")
def _map_xml(spark, sf_dir):
    """A map extract landed as XML: one scan per kind of object, locations and tags joined to the ways.

    Nodes whose number is a multiple of 7 are missing, as at the edge of an extract; every fourth has a tag.
    """
    e = table(spark, sf_dir, "events")
    node = """concat('<node id="', cast(id as string), '" lon="', cast(id % 360 as string), '" lat="', cast(id % 90 as string), '"',
      case when id % 4 = 0 then '><tag k="barrier" v="gate &amp; wall"/></node>' else '/>' end) as value"""
    name = "concat('extract_', cast(pmod(hash(value), 16) as string), '.xml') as name"
    nodes = e.selectExpr("explode(array(user_id, user_id + 3, user_id + 6)) as id").distinct().filter("id % 7 <> 0").selectExpr(node)
    ways = e.selectExpr("""concat('<way id="', cast(event_id as string), '">\n <nd ref="', cast(user_id as string), '"/><nd ref="', cast(user_id + 3 as string), '"/>\n <nd ref="', cast(user_id + 6 as string),
      '"/><tag k="highway" v="', event_type, '"/></way>') as value""")
    both = nodes.unionByName(ways).selectExpr(name, "value")
    objects = SF.read_map_objects(spark, _landed_documents(both, staging_folder(spark, "extract"), '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">', "</osm>"))
    lines = V.way_lines(objects["way_nodes"], objects["nodes"])
    key = objects["tags"].filter("key = 'highway'").select(F.expr("cast(substring(object_id, 2) as bigint)").alias("way_id"), F.col("value").alias("highway"))
    gates = objects["tags"].filter("key = 'barrier' and value = 'gate & wall'").select(F.expr("cast(substring(object_id, 2) as bigint)").alias("node_id"))
    n_tagged = objects["way_nodes"].join(gates, "node_id").groupBy("way_id").agg(F.count(F.lit(1)).alias("n_tagged"))
    # vertices keep their places, so the twin can tell a lost order
    first = objects["way_nodes"].join(objects["nodes"], "node_id").groupBy("way_id").agg(
        F.sum((F.col("pos") + 1) * F.col("lon")).cast("bigint").alias("lon_sum"), F.sum((F.col("pos") + 1) * F.col("lat")).cast("bigint").alias("lat_sum"))
    return lines.join(key, "way_id").join(first, "way_id").join(n_tagged, "way_id", "left").select(
        "way_id", "highway", F.size("line").cast("bigint").alias("n_vertices"), "lon_sum", "lat_sum", F.coalesce("n_tagged", F.lit(0)).alias("n_tagged"))


@query("source_projected_layer", f"""with {FEATURES} select feature_id, cast(floor(ax*1e7 + 5e-1) as bigint) as lon_1e7, cast(floor(ay*1e7 + 5e-1) as bigint) as lat_1e7 from feat where source = 'layer_1'""")
def _layer(spark, sf_dir):
    projected = fx.features(spark, sf_dir).select("feature_id", F.col("source").alias("layer"), F.array(F.array(geo.lambert93_from_lonlat("ax", "ay"))).alias("rings"))
    moved = SF.read_layer(projected, "layer_1")
    p = F.element_at(F.element_at("rings", 1), 1)
    return moved.select("feature_id", F.floor(p.x * 1e7 + 0.5).cast("bigint").alias("lon_1e7"), F.floor(p.y * 1e7 + 0.5).cast("bigint").alias("lat_1e7"))


# -- outputs --------------------------------------------------------------------------------------

@query("sink_feature_json", """select event_id as feature_id, '{"type":"Feature","properties":{"key":"' || event_type || '"},"geometry":{"type":"LineString","coordinates":[[' || user_id || '.5,' || event_id % 90 || '.25],[' || user_id + 1 || '.5,' || event_id % 90 || '.75]]}}' as json from events""")
def _json(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id as feature_id", "user_id + 5e-1 as x", "event_id % 90 + 25e-2 as y", "event_type")

    def vertex(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    f = e.select("feature_id", F.lit("LineString").alias("kind"), F.create_map(F.lit("key"), "event_type").alias("props"),
                 F.array(F.array(vertex(F.col("x"), F.col("y")), vertex(F.col("x") + 1.0, F.col("y") + 0.5))).alias("rings"))
    return writers.feature_json(f).select("feature_id", "json")


@query("sink_index_sheet", """with c as (select o_custkey as product, o_orderkey % 4 as r, o_custkey % 2 + o_orderkey % 3 as c, o_orderkey*1e0 as x0, o_totalprice as y0 from orders),
    b as (select product, r, c, min(x0) as x0, min(y0) as y0, max(x0 + 1e1) as x1, max(y0 + 1e1) as y1, count(*) as n_tiles from c group by all),
    w as (select product, max(c) + 1 as n from b group by product)
    select product, printf('%03dx%03d', r + 1, c + 1) as chunk, x0, y0, x1, y1, n_tiles, cast(r*n + c + 1 as int) as number from b join w using (product)""")
def _index_sheet(spark, sf_dir):
    from reliefspark.operators.state import chunk_key

    o = table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_custkey").alias("product"), chunk_key(F.col("o_orderkey") % 4, F.col("o_custkey") % 2 + F.col("o_orderkey") % 3).alias("chunk"),
                     F.col("o_orderkey").cast("double").alias("x0"), F.col("o_totalprice").alias("y0"))
    return writers.index_sheet(cells.withColumn("x1", F.col("x0") + 10.0).withColumn("y1", F.col("y0") + 10.0))


@query("sink_manifest_runs", """select 'first' as run, o_orderstatus as status, count(*) as n_chunks, cast(sum(o_orderkey) as bigint) as key_sum from orders where o_orderstatus <> 'F' group by all
    union all select 'second', o_orderstatus, count(*), cast(sum(o_orderkey) as bigint) from orders group by all""")
def _manifest_runs(spark, sf_dir):
    """The manifests of two runs; the second is written, half-written by a failed attempt, and written again: one copy stays."""
    folder = staging_folder(spark, "manifest")
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("status"))
    writers.write_manifest(chunks.filter("status <> 'F'"), folder, "first")
    writers.write_manifest(chunks, folder, "second")
    writers.write_manifest(chunks.filter("status = 'O'"), folder, "second")
    writers.write_manifest(chunks, folder, "second")
    return writers.read_manifests(spark, folder).groupBy("run", "status").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk").cast("bigint").alias("key_sum"))


@query("sink_coverage_features", """select c_custkey as region, '{"type":"Feature","properties":{"title":"' || case when c_custkey % 5 = 0 then c_name else 'Name p' || c_custkey % 40 end || '","providers":"p' || c_custkey % 40 || '","laz":"' ||
    case when c_custkey % 40 % 6 = 0 then 'true' else 'false' end || '"},"geometry":{"type":"Polygon","coordinates":[[[' || c_custkey || '.5,1.5],[' || c_custkey + 1 || '.5,1.5],[' || c_custkey + 1 || '.5,2.5],[' || c_custkey || '.5,1.5]]]}}' as json from customer""")
def _coverage_features(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr("concat('p', cast(c_custkey % 40 as string)) as code", "c_custkey % 40 as n").distinct()
    providers = base.selectExpr("code", "concat('Name ', code) as name").unionByName(
        base.filter("n % 6 = 0").selectExpr("concat(code, '-laz') as code", "concat('Name ', code, ' cloud') as name"))
    regions = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as region", "case when c_custkey % 5 = 0 then c_name end as label", "array(concat('p', cast(c_custkey % 40 as string))) as codes")
    x = F.col("c_custkey") + 0.5
    ring = F.array(*[F.struct(a.alias("x"), F.lit(b).alias("y")) for a, b in ((x, 1.5), (x + 1.0, 1.5), (x + 1.0, 2.5), (x, 1.5))])
    outlines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("region"), F.array(ring).alias("rings"))
    return writers.coverage_features(regions, providers, outlines)
