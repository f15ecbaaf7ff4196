"""Registered map-tile queries."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.operators import tiles as T
from reliefspark.operators.blocks import blocks_to_cells
from reliefspark.plans import fixtures as fx
from reliefspark.plans.fixtures import BARE, FEATURES, TILES, mm, sql_mm
from reliefspark.plans.registry import query
from reliefspark.plans.relief_queries import WARP, bare, cells_of, mercator_blocks, sql_warp
from reliefspark.session import staging_folder, table
from reliefspark.sinks import writers
from reliefspark.sources.features import read_tile_set

_ZOOM = 15


@query("tile_address", f"""with {FEATURES}, f as (select *, cast(13 + event_no % 6 as int) as zoom from (select *, feature_id as event_no from feat))
    select feature_id, zoom, greatest(0, least(cast(floor((ax + 18e1)/36e1*(1 << zoom)) as bigint), (1 << zoom) - 1)) as x,
      greatest(0, least(cast(floor((1e0 - asinh(tan(radians(ay)))/pi())/2e0*(1 << zoom)) as bigint), (1 << zoom) - 1)) as y from f""")
def _address(spark, sf_dir):
    f = fx.features(spark, sf_dir).withColumn("zoom", (F.col("feature_id") % 6 + 13).cast("int"))
    return f.select("feature_id", "zoom", geo.tile_x("ax", F.col("zoom")).alias("x"), geo.tile_y("ay", F.col("zoom")).alias("y"))


@query("tile_corners", f"""with {TILES} select set_id, zoom, x, y, x*36e1/(1 << zoom) - 18e1 as west,
      cast(floor(degrees(atan(sinh(pi()*(1e0 - 2e0*y/(1 << zoom)))))*1e9 + 5e-1) as bigint) as north_1e9,
      cast(floor((x*40075016.685578488e0/(1 << zoom) - 20037508.342789244e0)*1e3 + 5e-1) as bigint) as left_mm from tl""")
def _corners(spark, sf_dir):
    t = fx.tile_set(spark, sf_dir)
    return t.select("set_id", "zoom", "x", "y", geo.tile_lon("x", F.col("zoom")).alias("west"),
                    F.floor(geo.tile_lat("y", F.col("zoom")) * 1e9 + 0.5).cast("bigint").alias("north_1e9"),
                    F.floor(geo.tile_mercator_bounds("x", "y", F.col("zoom")).x0 * 1e3 + 0.5).cast("bigint").alias("left_mm"))


@query("native_zoom", """with p as (select c_custkey, 0.25e0*(1 + c_custkey % 23) as res, (c_custkey % 70) - 5e0 as lat from customer)
    select c_custkey, greatest(1, least(22, cast(ceil(log2(156543.033928e0*cos(radians(abs(lat)))/res)) as int))) as zoom,
      cast(floor(156543.033928e0*cos(radians(lat))/(1 << 16)*1e6 + 5e-1) as bigint) as metres_1e6 from p""")
def _native(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey", "0.25e0*(1 + c_custkey % 23) as res", "(c_custkey % 70) - 5e0 as lat")
    return p.select("c_custkey", geo.native_zoom("res", "lat").alias("zoom"),
                    F.floor(geo.ground_resolution("lat", F.lit(16)) * 1e6 + 0.5).cast("bigint").alias("metres_1e6"))


#: deep enough that some tiles are full
_DEEP = 18


def _pixels(spark, sf_dir, zoom=_ZOOM):
    """One row a pixel; positions and corners are dealt with block by block, so no row is made for them."""
    warped = blocks_to_cells(mercator_blocks(spark, sf_dir, zoom=zoom, steps=10.0), ["z"], T.TILE)
    code = (F.floor(F.col("z") * 10.0).cast("bigint") % 255 + 1).cast("int")
    return warped.select(F.lit(zoom).alias("zoom"), F.col("row").alias("prow"), F.col("col").alias("pcol"), code.alias("v"))


_PX = """, px as (select "row" as prow, col as pcol, cast(cast(floor(z*1e1) as bigint) % 255 + 1 as int) as v from warped)"""
PIXELS, DEEP_PIXELS = WARP + _PX, sql_warp(_DEEP) + _PX
_PACK = f"""select {_DEEP} as zoom, cast(floor(pcol/256e0) as bigint) as x, cast(floor(prow/256e0) as bigint) as y, cast(count(*) as {{kind}}) as filled{{more}} from px group by all"""
#: every pixel weighs by its place in the tile, so a sum that agrees leaves no room for swapped rows or columns
_PLACED = "cast(sum(v*(((prow % 256)*256 + pcol % 256) % 997 + 1)) as bigint) as placed_sum"


def _placed_sum(read):
    """Column function: the place-weighted sum of the grey values that ``read`` takes from each payload."""
    def run(bodies: pd.Series) -> pd.Series:
        weights = np.arange(256 * 256) % 997 + 1
        return pd.Series([int((read(body).astype(np.int64).reshape(-1) * weights).sum()) for body in bodies], dtype="int64")

    return F.pandas_udf(run, "bigint")


def _raw_grey(body):
    return np.frombuffer(body, np.uint8)


def _png_grey(body):
    """Grey values of a PNG without filters, with or without alpha."""
    channels = 2 if body[25] == 4 else 1
    size = int.from_bytes(body[33:37], "big")
    rows = np.frombuffer(zlib.decompress(body[41:41 + size]), np.uint8).reshape(256, 1 + 256 * channels)
    return rows[:, 1::channels]


@query("tile_summary", f"with {DEEP_PIXELS} " + _PACK.format(kind="bigint", more=", count(*) = 65536 as interior"))
def _summary(spark, sf_dir):
    return T.tile_summary(_pixels(spark, sf_dir, _DEEP))


def _pixel_blocks(spark, sf_dir, zoom=_ZOOM):
    code = F.transform("z", lambda z: F.floor(z * 10.0).cast("bigint") % 255 + 1)
    return mercator_blocks(spark, sf_dir, zoom=zoom, steps=10.0).select("raster_id", "brow", "bcol", code.cast("array<double>").alias("v"))


@query("tile_packing", f"with {DEEP_PIXELS} " + _PACK.format(kind="int", more=f", {_PLACED}"))
def _packing(spark, sf_dir):
    tiles = T.block_tiles(_pixel_blocks(spark, sf_dir, _DEEP), "v", _DEEP)
    return tiles.select("zoom", "x", "y", "filled", _placed_sum(_raw_grey)("pixels").alias("placed_sum"))


@query("tile_packing_from_pixels", f"with {DEEP_PIXELS} " + _PACK.format(kind="int", more=f", {_PLACED}"))
def _packing_pixels(spark, sf_dir):
    tiles = T.pixel_tiles(_pixels(spark, sf_dir, _DEEP))
    return tiles.select("zoom", "x", "y", "filled", _placed_sum(_raw_grey)("pixels").alias("placed_sum"))


@query("tile_png", f"with {DEEP_PIXELS} " + _PACK.format(kind="int", more=f", {_PLACED}, 'png' as kind, 256 as width, case when count(*) = 65536 then 0 else 4 end as colour_type"))
def _png(spark, sf_dir):
    png = T.png_tiles(T.block_tiles(_pixel_blocks(spark, sf_dir, _DEEP), "v", _DEEP))
    return png.select("zoom", "x", "y", "filled", _placed_sum(_png_grey)("data").alias("placed_sum"), T.payload_kind("data").alias("kind"),
                      F.conv(F.hex(F.substring("data", 17, 4)), 16, 10).cast("int").alias("width"),
                      F.conv(F.hex(F.substring("data", 26, 1)), 16, 10).cast("int").alias("colour_type"))


@query("tile_set_write_read", f"with {DEEP_PIXELS} " + _PACK.format(kind="int", more=f", {_PLACED}, 'png' as declared"))
def _stored_set(spark, sf_dir):
    """A tile set written to the shared folder and read back with its metadata."""
    folder = staging_folder(spark, "tile_set")
    tiles = T.block_tiles(_pixel_blocks(spark, sf_dir, _DEEP), "v", _DEEP)
    writers.write_tiles(tiles, spark.createDataFrame([("format", "png")], "name string, value string"), folder)
    stored, meta = read_tile_set(spark, folder)
    rows = stored.select(F.col("zoom").cast("int").alias("zoom"), "x", "y", "filled", _placed_sum(_raw_grey)("pixels").alias("placed_sum"), F.lit("format").alias("name"))
    return rows.join(meta.withColumnRenamed("value", "declared"), "name").drop("name")


@query("raster_write_read", f"""with {BARE} select "row", count(*) as n_cells, cast(sum({sql_mm('z')}) as bigint) as z_sum_mm from bare group by "row\"""")
def _stored_raster(spark, sf_dir):
    """Raster blocks checked, written to the shared folder and read back."""
    folder = staging_folder(spark, "raster")
    writers.write_raster(writers.checked_raster(bare(spark, sf_dir), "z"), folder)
    cells = cells_of(spark.read.parquet(folder), "z")
    return cells.groupBy("row").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(mm("z")).alias("z_sum_mm"))


def _sql_reduce(source: str, name: str) -> str:
    """CTE ``name(prow, pcol, v)``: one pyramid step."""
    return f"""{name} as (select (prow + dr) // 2 as prow, (pcol + dc) // 2 as pcol,
      cast(floor(sum(v*(case when prow % 2 = 1 then 2 else 1 end)*(case when pcol % 2 = 1 then 2 else 1 end))
        /cast(sum((case when prow % 2 = 1 then 2 else 1 end)*(case when pcol % 2 = 1 then 2 else 1 end)) as double) + 5e-1) as int) as v
      from {source}, (values (0), (-1)) a(dr), (values (0), (-1)) b(dc)
      where (dr = 0 or prow % 2 = 0) and (dc = 0 or pcol % 2 = 0) group by all)"""


# the pyramid reads blocks the pixels fill; parents that only an edge line reaches are no tiles
_KEEP = "where exists (select 1 from {src} s where s.prow // 512 = t.prow // 256 and s.pcol // 512 = t.pcol // 256)"


@query("tile_pyramid", f"""with {PIXELS}, {_sql_reduce('px', 'r14')}, k14 as (select * from r14 t {_KEEP.format(src='px')}), {_sql_reduce('k14', 'r13')},
    k13 as (select * from r13 t {_KEEP.format(src='k14')})
    select 15 as zoom, prow, pcol, v from px union all select 14, prow, pcol, v from k14 union all select 13, prow, pcol, v from k13""")
def _pyramid(spark, sf_dir):
    levels = T.pyramid(_pixel_blocks(spark, sf_dir), 13, 15)
    result = None
    for zoom in (15, 14, 13):
        cells = blocks_to_cells(levels.filter(F.col("zoom") == zoom), ["v"], T.TILE).filter(F.col("v") > 0)
        part = cells.select(F.lit(zoom).alias("zoom"), F.col("row").alias("prow"), F.col("col").alias("pcol"), F.col("v").cast("int").alias("v"))
        result = part if result is None else result.unionByName(part)
    return result


@query("overview_factors", """select event_id, coalesce((select string_agg(cast(1 << i as varchar), ',' order by i) from range(1, 1 + cast(greatest(0, user_id % 9 - 1) as bigint)) r(i)), '') as factors from events""")
def _factors(spark, sf_dir):
    f = T.overview_factors(F.lit(10), (F.col("user_id") % 9 + 9))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", f.cast("array<string>")).alias("factors"))


@query("byte_range_guard", """select case when v >= 0 and v <= 255 and v = floor(v) then 'ok' else 'refused' end as verdict, count(*) as n
    from (select case when l_linenumber = 1 then l_extendedprice else l_quantity end as v from lineitem) group by 1""")
def _bytes(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(T.byte_verdict(v).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_PRODUCT = "case event_id % 5 when 0 then 'zone_svf_flux_20m' when 1 then 'zone_hillshade_multi' when 2 then 'zone_lrm' when 3 then 'Zone_VAT' else 'zone_slope' end"
_WANTED = "case user_id % 3 when 0 then 'auto' when 1 then 'png' else 'jpeg' end"
_FORMAT_SQL = f"""f as (select event_id, user_id, {_PRODUCT} as product, {_WANTED} as wanted from events),
    b as (select *, case when wanted in ('png', 'jpeg') then wanted when lower(product) like '%svf%' or lower(product) like '%vat%' then 'png' else 'jpeg' end as base from f)"""


@query("tile_base_format", f"""with {_FORMAT_SQL} select event_id, base, case when event_id % 2 = 0 and wanted in ('auto', 'jpeg') then 85 end as quality,
      'zone_ortho_z10-16' || case when event_id % 2 = 0 and wanted in ('auto', 'jpeg') then '_q85' else '' end as name from b""")
def _format(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_PRODUCT} as product", f"{_WANTED} as wanted")
    quality = T.convert_quality(F.when(F.col("event_id") % 2 == 0, "image/png").otherwise("image/jpeg"), "wanted", F.lit(85))
    return e.select("event_id", T.base_format("product", "wanted").alias("base"), quality.alias("quality"),
                    T.set_name(F.lit("zone"), F.lit("ortho"), F.lit(10), F.lit(16), quality).alias("name"))


@query("tile_set_format", f"""with {_FORMAT_SQL}, t as (select user_id as set_id, case when event_id % 11 = 0 then 'png' when base = 'png' and user_id % 2 = 0 then 'png' else 'jpeg' end as format from b)
    select set_id, case when bool_or(format = 'png') then 'png' else 'jpeg' end as format, count(*) filter (where format = 'png') as n_png, count(*) filter (where format = 'jpeg') as n_jpeg from t group by set_id""")
def _set_format(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id as set_id", f"{_PRODUCT} as product", f"{_WANTED} as wanted")
    base = T.base_format("product", "wanted")
    edge = F.col("event_id") % 11 == 0
    t = e.select("set_id", F.when(edge | ((base == "png") & (F.col("set_id") % 2 == 0)), "png").otherwise("jpeg").alias("format"))
    return T.set_format(t, "set_id")


@query("row_flip", f"with {TILES} select set_id, zoom, x, y, (1 << zoom) - 1 - y as tms_row from tl")
def _flip(spark, sf_dir):
    return fx.tile_set(spark, sf_dir).withColumn("tms_row", geo.flip_row("y", F.col("zoom")))


@query("sqlitedb_layout", f"with {TILES} select x, y, zoom as z, 0 as s, set_id as image from tl")
def _sqlitedb(spark, sf_dir):
    t = fx.tile_set(spark, sf_dir)
    stored = t.select("zoom", F.col("x").alias("col"), geo.flip_row("y", F.col("zoom")).alias("row"), F.col("set_id").alias("data"))
    return T.to_sqlitedb(stored)


@query("sqlitedb_info", f"with {TILES} select min(zoom) as minzoom, max(zoom) as maxzoom, 'simple' as tilenumbering from tl")
def _info(spark, sf_dir):
    return T.sqlitedb_info(fx.tile_set(spark, sf_dir))


@query("tile_set_bounds", f"""with {TILES}, m as (select set_id, max(zoom) as zoom from tl group by set_id),
    c as (select set_id, zoom, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from tl join m using (set_id, zoom) group by all)
    select set_id, zoom, cast(floor((x0*36e1/(1 << zoom) - 18e1)*1e9 + 5e-1) as bigint) as west, cast(floor(degrees(atan(sinh(pi()*(1e0 - 2e0*(y1 + 1)/(1 << zoom)))))*1e9 + 5e-1) as bigint) as south,
      cast(floor(((x1 + 1)*36e1/(1 << zoom) - 18e1)*1e9 + 5e-1) as bigint) as east, cast(floor(degrees(atan(sinh(pi()*(1e0 - 2e0*y0/(1 << zoom)))))*1e9 + 5e-1) as bigint) as north from c""")
def _bounds(spark, sf_dir):
    b = T.set_bounds(fx.tile_set(spark, sf_dir))
    return b.select("set_id", "zoom", *[F.floor(F.col(c) * 1e9 + 0.5).cast("bigint").alias(c) for c in ("west", "south", "east", "north")])


@query("tile_zoom_range", f"""with {TILES}, m as (select distinct concat('set_', cast(floor(o_orderkey/3.75e3) as bigint)) as set_id from orders where floor(o_orderkey/3.75e3) % 2 = 0)
    select set_id, case when set_id in (select set_id from m) then 10 else min(zoom) end as minzoom, max(zoom) as maxzoom from tl group by set_id""")
def _zooms(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").selectExpr("cast(floor(o_orderkey/3.75e3) as bigint) as n").filter("n % 2 = 0").distinct().selectExpr(
        "concat('set_', cast(n as string)) as set_id", "10 as minzoom", "cast(null as int) as maxzoom")
    return T.zoom_range(fx.tile_set(spark, sf_dir), meta)


@query("tile_set_split", f"""with {TILES}, m as (select set_id, max(zoom) as top from tl group by set_id),
    t as (select set_id, top, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from tl join m using (set_id) where zoom = top group by all),
    p as (select tl.*, t.*, unnest(range(3)) as part_col from tl join t using (set_id)),
    q as (select set_id, zoom, x, y, top, x0, x1, y0, y1, part_col, unnest(range(2)) as part_row from p),
    pos as (select *, 1 << (top - zoom) as span from q)
    select set_id, zoom, x, y, cast(part_col as bigint) as part_col, cast(part_row as bigint) as part_row from pos
    where part_col between (greatest(x0, least(x1, x*span)) - x0)*3//(x1 - x0 + 1) and (greatest(x0, least(x1, (x + 1)*span - 1)) - x0)*3//(x1 - x0 + 1)
      and part_row between (greatest(y0, least(y1, y*span)) - y0)*2//(y1 - y0 + 1) and (greatest(y0, least(y1, (y + 1)*span - 1)) - y0)*2//(y1 - y0 + 1)""")
def _split(spark, sf_dir):
    return T.split_set(fx.tile_set(spark, sf_dir), 3, 2).select("set_id", "zoom", "x", "y", "part_col", "part_row")


@query("split_counts_by_width", f"""with {FEATURES}, b as (select feature_id, ax as west, ay as south, ax + 5e-1 as east, ay + 25e-2 as north from feat)
    select feature_id, greatest(1, cast(ceil(radians(east - west)*6378.137e0*cos(radians((north + south)/2e0))/1e1) as int)) as n_cols,
      greatest(1, cast(ceil(radians(north - south)*6378.137e0/1e1) as int)) as n_rows from b""")
def _by_width(spark, sf_dir):
    b = fx.features(spark, sf_dir).select("feature_id", F.col("ax").alias("west"), F.col("ay").alias("south"), (F.col("ax") + 0.5).alias("east"), (F.col("ay") + 0.25).alias("north"))
    return T.split_counts_by_width(b, 10.0).select("feature_id", "n_cols", "n_rows")


@query("part_metadata", """select o_orderkey, 'part_' || o_orderkey as name, 'png' as format, o_orderpriority as attribution from orders""")
def _meta(spark, sf_dir):
    meta = F.create_map(F.lit("name"), F.lit("base"), F.lit("format"), F.lit("png"), F.lit("attribution"), F.col("o_orderpriority"))
    part = T.part_metadata(meta, F.concat(F.lit("part_"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", part.alias("m")).select(
        "o_orderkey", *[F.element_at("m", F.lit(k)).alias(k) for k in ("name", "format", "attribution")])


@query("sparse_coverage_guard", f"""with {TILES}, z as (select set_id, zoom, (max(x) - min(x) + 1)*(max(y) - min(y) + 1) as p, count(*) as n from tl group by all)
    select set_id, cast(sum(p) as bigint) as positions, cast(sum(n) as bigint) as n_tiles, sum(p) > sum(n)*5e0 as refused from z group by set_id""")
def _sparse(spark, sf_dir):
    return T.coverage_guard(fx.tile_set(spark, sf_dir), limit=5.0)


_FETCH = ["event_id", "user_id as tile", "user_id % 2 = 0 as discover_exact",
          "case event_id % 10 when 0 then 404 when 1 then 204 when 2 then 503 when 3 then 403 else 200 end as status",
          "case event_type when 'view' then 'image/png' when 'click' then 'application/xml' when 'error' then 'text/html' when 'signup' then 'image/jpeg' else 'application/octet-stream' end as content_type",
          "case event_type when 'view' then '89504E470D0A1A0A' when 'click' then '3C53657276696365' when 'error' then '3C68746D6C3E' when 'signup' then 'FFD8FFE0' else case when event_id % 3 = 0 then '7B226572726F7222' else '4142' end end as head",
          "cast(value*20 as int) as body_length"]
_ANSWER = f"""fl as (select {', '.join(_FETCH)} from events), an as (select *, case when status in (404, 204) then 'absent' when status <> 200 then 'error'
    when head in ('89504E470D0A1A0A', 'FFD8FFE0') then 'data' when content_type similar to '.*(xml|html|json).*' or head like '7B%' then 'error'
    when body_length < 500 then 'absent' else 'error' end as answer from fl),
    pr as (select *, case when answer = 'absent' and discover_exact then 'error' else answer end as promised from an)"""


def _answers(spark, sf_dir):
    # the twin's cast to whole numbers rounds, Spark's cuts off
    fetch = [c.replace("cast(value*20 as int)", "cast(rint(value*20) as int)") for c in _FETCH]
    log = table(spark, sf_dir, "events").selectExpr(*fetch)
    answer = T.answer_class("status", "content_type", F.unhex("head"), F.col("body_length"))
    return log.withColumn("answer", answer).withColumn("promised", T.promised_answer("answer", "discover_exact"))


@query("tile_answer_class", f"with {_ANSWER} select event_id, answer, promised from pr")
def _answer(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", "answer", "promised")


@query("publish_gate", f"""with {_ANSWER}, g as (select cast(floor(event_id/3e0) as bigint) as product, count(*) filter (where answer = 'data') as n_data, count(*) filter (where answer = 'absent') as n_absent,
      count(*) filter (where answer = 'error') as n_error from an group by all)
    select *, case when n_error > 0 then 'blocked' when n_data = 0 then 'out of coverage' else 'publish' end as verdict from g""")
def _gate(spark, sf_dir):
    answers = _answers(spark, sf_dir).withColumn("product", F.floor(F.col("event_id") / 3.0).cast("bigint"))
    return T.publish_gate(answers, "product")


@query("payload_kind", f"""with fl as (select {', '.join(_FETCH)} from events) select event_id, case when head = '89504E470D0A1A0A' then 'png' when head = 'FFD8FFE0' then 'jpeg' else 'other' end as kind from fl""")
def _kind(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_FETCH).select("event_id", T.payload_kind(F.unhex("head")).alias("kind"))


@query("tile_cache_namespace", """select event_id, substring(sha256('https://wmts.example|' || event_type || '|normal|' || case when event_id % 2 = 0 then 'png' else 'jpeg' end), 1, 16) as folder from events""")
def _namespace(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fmt = F.when(F.col("event_id") % 2 == 0, "png").otherwise("jpeg")
    return e.select("event_id", T.cache_namespace(F.lit("https://wmts.example"), "event_type", F.lit("normal"), fmt).alias("folder"))
