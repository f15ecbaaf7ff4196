"""Registered catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliefspark.functions import geo, geom
from reliefspark.operators import catalogue as C
from reliefspark.plans import fixtures as fx
from reliefspark.plans.fixtures import FEATURES, INDEX
from reliefspark.plans.registry import query
from reliefspark.session import table

# request boxes derived from customers: metres, some edges on grid lines
_BOX = ["c_custkey", "(c_custkey % 40)*1e3 + (c_custkey % 4)*25e1 as x0", "(c_custkey % 30)*1e3 + (c_custkey % 3)*5e2 as y0",
        "(c_custkey % 40)*1e3 + 15e2 + (c_custkey % 5)*5e2 as x1", "(c_custkey % 30)*1e3 + 2e3 + (c_custkey % 2)*7e2 as y1"]
BOXES = f"box as (select {', '.join(_BOX)} from customer)"


def boxes(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*_BOX).select("c_custkey", geo.bbox("x0", "y0", "x1", "y1").alias("bbox"))


def _sql_axis(low, high, edge):
    last = f"cast(floor({high}/1e3) as bigint)"
    if edge:
        last = f"(case when {high} % 1e3 = 0 and {last} > cast(floor({low}/1e3) as bigint) then {last} - 1 else {last} end)"
    return f"unnest(range(cast(floor({low}/1e3) as bigint), {last} + 1))"


@query("grid_cells", f"""with {BOXES}, a as (select *, {_sql_axis('x0', 'x1', True)} as key_x from box)
    select c_custkey, key_x, {_sql_axis('y0', 'y1', True)} as key_y from a""")
def _grid(spark, sf_dir):
    return C.grid_cells(boxes(spark, sf_dir)).select("c_custkey", "key_x", "key_y")


@query("grid_cells_closed", f"""with {BOXES}, a as (select *, {_sql_axis('x0', 'x1', False)} as key_x from box)
    select c_custkey, key_x, {_sql_axis('y0', 'y1', False)} as key_y from a""")
def _grid_closed(spark, sf_dir):
    return C.grid_cells(boxes(spark, sf_dir), closed=True).select("c_custkey", "key_x", "key_y")


@query("mercator_tile_range", f"""with {BOXES}, s as (select 40075016.685578488e0/32768 as step, 20037508.342789244e0 as h),
    a as (select c_custkey, x0 + 15.5e6 as x0, x1 + 15.5e6 as x1, y0 + 4.2e6 as y0, y1 + 4.2e6 as y1 from box),
    b as (select a.*, step, h, unnest(range(cast(floor((x0 + h)/step) as bigint), cast(floor((x1 + h)/step) as bigint) + 1)) as x from a, s)
    select c_custkey, x, unnest(range(cast(floor((h - y1)/step) as bigint), cast(floor((h - y0)/step) as bigint) + 1)) as y from b""")
def _tile_range(spark, sf_dir):
    moved = boxes(spark, sf_dir).select("c_custkey", geo.bbox(
        F.col("bbox.x0") + 15.5e6, F.col("bbox.y0") + 4.2e6, F.col("bbox.x1") + 15.5e6, F.col("bbox.y1") + 4.2e6).alias("bbox"))
    return C.mercator_tiles(moved, 15).select("c_custkey", "x", "y")


@query("clip_to_coverage", f"""with {BOXES}, c as (select c_custkey, greatest(x0, 5e3) as x0, greatest(y0, 8e3) as y0, least(x1, 25e3) as x1, least(y1, 21e3) as y1 from box)
    select * from c where x0 < x1 and y0 < y1""")
def _clip(spark, sf_dir):
    return C.clip_to_extent(boxes(spark, sf_dir), (5000, 8000, 25000, 21000)).select("c_custkey", "bbox.*")


@query("tile_names_and_urls", f"""with {INDEX} select order_id, 'dtm_' || collection || '_' || key_x || '_' || key_y || '.tif' as name,
    'https://wms.example/ows?SERVICE=WMS&LAYERS=mnt%3A' || collection || '&BBOX=' || key_x*1000 || '%2C' || key_y*1000 || '%2C' || (key_x + 1)*1000 || '%2C' || (key_y + 1)*1000 as url from idx""")
def _names(spark, sf_dir):
    idx = fx.tile_index(spark, sf_dir)
    x, y = F.col("key_x"), F.col("key_y")
    box = F.concat_ws(",", *[v.cast("string") for v in (x * 1000, y * 1000, (x + 1) * 1000, (y + 1) * 1000)])
    return idx.select(
        "order_id", C.tile_name(F.concat(F.lit("dtm_"), F.col("collection")), "key_x", "key_y").alias("name"),
        C.service_url("https://wms.example/ows", {"SERVICE": "WMS", "LAYERS": F.concat(F.lit("mnt:"), F.col("collection")), "BBOX": box}).alias("url"))


@query("tile_name_parts", f"""with {INDEX} select order_id, key_x, key_y, vintage, cast(null as bigint) as absent from idx""")
def _parts(spark, sf_dir):
    pattern = r"^dtm_(\d+)_(\d+)_(\d{4})_(\d+)\.tif$"
    return fx.tile_index(spark, sf_dir).select(
        "order_id", C.name_part("tile_name", pattern, 1).alias("key_x"), C.name_part("tile_name", pattern, 2).alias("key_y"),
        C.name_part("tile_name", pattern, 3).alias("vintage"), C.name_part("tile_name", r"^LHD_(\d+)", 1).alias("absent"))


_CELLS_SQL = f"{BOXES}, ax as (select *, {_sql_axis('x0', 'x1', True)} as key_x from box), cells as (select c_custkey, key_x, {_sql_axis('y0', 'y1', True)} as key_y from ax)"


@query("cells_in_index", f"""with {_CELLS_SQL}, {INDEX} select * from cells where exists (select 1 from idx where idx.key_x = cells.key_x and idx.key_y = cells.key_y)""")
def _in_index(spark, sf_dir):
    return C.existing_cells(C.grid_cells(boxes(spark, sf_dir)), fx.tile_index(spark, sf_dir)).select("c_custkey", "key_x", "key_y")


@query("cells_outside_index", f"""with {_CELLS_SQL}, {INDEX}
    select c_custkey, count(*) as n_missing from cells where not exists (select 1 from idx where idx.key_x = cells.key_x and idx.key_y = cells.key_y) group by c_custkey""")
def _outside(spark, sf_dir):
    return C.missing_cells(C.grid_cells(boxes(spark, sf_dir)), fx.tile_index(spark, sf_dir)).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_missing"))


@query("latest_vintage", f"""with {INDEX}, r as (select *, row_number() over (partition by key_x, key_y order by vintage desc, url) as n from idx)
    select key_x, key_y, vintage, url, tile_name from r where n = 1""")
def _latest(spark, sf_dir):
    idx = fx.tile_index(spark, sf_dir).select("key_x", "key_y", "vintage", "url", "tile_name")
    return C.latest_vintage(idx).select("key_x", "key_y", "vintage", "url", "tile_name")


@query("latest_year_and_month", f"""with {INDEX}, r as (select *, row_number() over (partition by key_x, key_y order by vintage desc, survey_month desc, url) as n from idx)
    select key_x, key_y, vintage, survey_month, url from r where n = 1""")
def _latest_month(spark, sf_dir):
    idx = fx.tile_index(spark, sf_dir).select("key_x", "key_y", "vintage", "survey_month", "url")
    best = C.best_per_key(idx, ["key_x", "key_y"], [-F.col("vintage"), -F.col("survey_month"), F.col("url")])
    return best.select("key_x", "key_y", "vintage", "survey_month", "url")


@query("latest_iso_date", """with s as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as stamp, o_orderkey from orders),
    r as (select *, row_number() over (partition by o_custkey order by stamp desc, o_orderkey) as n from s) select o_custkey, stamp, o_orderkey from r where n = 1""")
def _latest_iso(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"), "o_orderkey")
    return C.latest_dated(s, ["o_custkey"], "stamp", "o_orderkey").select("o_custkey", "stamp", "o_orderkey")


@query("first_delivery_wins", f"""with {INDEX}, r as (select *, row_number() over (partition by key_x, key_y order by order_id) as n from idx)
    select key_x, key_y, order_id, tile_name from r where n = 1""")
def _first(spark, sf_dir):
    idx = fx.tile_index(spark, sf_dir).select("key_x", "key_y", "order_id", "tile_name")
    return C.best_per_key(idx, ["key_x", "key_y"], [F.col("order_id")])


@query("campaign_union", f"""with {INDEX}, u as (select key_x, key_y, url, cast(6 - order_id % 7 as int) as campaign from idx),
    r as (select *, row_number() over (partition by key_x, key_y order by campaign, url) as n from u) select key_x, key_y, campaign, url from r where n = 1""")
def _campaigns(spark, sf_dir):
    idx = fx.tile_index(spark, sf_dir)
    campaigns = [idx.filter(F.col("order_id") % 7 == 6 - k).select("key_x", "key_y", "url") for k in range(7)]
    return C.union_campaigns(campaigns, ["key_x", "key_y"], "url").select("key_x", "key_y", "campaign", "url")


_COORDS = ("concat('[[[', cast(user_id as string), '.5, ', cast(event_id % 91 as string), '.25, 7.5], [', cast(user_id + 3 as string), '.0, ', "
           "cast(event_id % 91 + 1 as string), '.75, 8.5],[', cast(user_id as string), '.5,', cast(event_id % 91 as string), '.25,7.5]]]')")


@query("geometry_bbox", "select event_id, user_id + 5e-1 as x0, event_id % 91 + 25e-2 as y0, user_id + 3e0 as x1, event_id % 91 + 175e-2 as y1 from events")
def _geometry_bbox(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_COORDS} as coords")
    return e.select("event_id", geom.coordinates_bbox("coords").alias("b")).select("event_id", "b.*")


_TILE_BOX = ["o_orderkey", "(o_custkey % 40)*1e3 as tx0", "cast(floor(o_custkey/4e1) as bigint)*1e3 as ty0"]
_PAIRS = (f"{BOXES}, t as (select {', '.join(_TILE_BOX)} from orders), "
          "p as (select c_custkey as request_id, o_orderkey as tile_id, box.*, tx0, ty0, tx0 + 1e3 as tx1, ty0 + 1e3 as ty1 from box, t where x1 >= tx0 and x0 <= tx0 + 1e3 and y1 >= ty0 and y0 <= ty0 + 1e3)")


def _request_tiles(spark, sf_dir, edges):
    requests = boxes(spark, sf_dir).withColumnRenamed("c_custkey", "request_id")
    t = table(spark, sf_dir, "orders").selectExpr(*_TILE_BOX)
    tiles = t.select(F.col("o_orderkey").alias("tile_id"), geo.bbox("tx0", "ty0", F.col("tx0") + 1000.0, F.col("ty0") + 1000.0).alias("bbox"))
    return C.bbox_requests(requests, tiles, 2000.0, edges).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("tile_id").alias("id_sum"))


@query("bbox_touches", f"with {_PAIRS} select request_id, count(*) as n_tiles, cast(sum(tile_id) as bigint) as id_sum from p group by request_id")
def _touches(spark, sf_dir):
    return _request_tiles(spark, sf_dir, True)


@query("bbox_overlaps", f"with {_PAIRS} select request_id, count(*) as n_tiles, cast(sum(tile_id) as bigint) as id_sum from p where x1 > tx0 and x0 < tx1 and y1 > ty0 and y0 < ty1 group by request_id")
def _overlaps(spark, sf_dir):
    return _request_tiles(spark, sf_dir, False)


@query("bbox_or_name", f"""with {INDEX}, b as (select order_id, key_x*1e3 as x0, key_y*1e3 as y0 from idx)
    select order_id, x0, y0 from b where x0 + 1e3 >= 5e3 and x0 <= 205e2 and y0 + 1e3 >= 3e3 and y0 <= 17e3""")
def _bbox_or_name(spark, sf_dir):
    idx = fx.tile_index(spark, sf_dir)
    pattern = r"^dtm_(\d+)_(\d+)_"
    own = F.when(F.col("order_id") % 3 == 0, geo.bbox(F.col("key_x") * 1e3, F.col("key_y") * 1e3, (F.col("key_x") + 1) * 1e3, (F.col("key_y") + 1) * 1e3))
    named = C.nominal_bounds(C.name_part("tile_name", pattern, 1), C.name_part("tile_name", pattern, 2), F.lit("sw"))
    known = idx.withColumn("b", F.coalesce(own, named))
    return known.filter(geo.bbox_touches(F.col("b"), geo.bbox_lit((5000, 3000, 20500, 17000)))).select("order_id", "b.x0", "b.y0")


@query("priority_cover", f"""with {_CELLS_SQL}, {INDEX},
    uc as (select distinct key_x, key_y from cells),
    g as (select cast(collection as int) as priority, case collection when '1' then 1e0 when '2' then 1e0 when '3' then 5e0 when '4' then 1e1 else 2e1 end as step, * exclude (collection) from idx),
    i as (select priority, step, cast(floor(key_x/step) as bigint) as kx, cast(floor(key_y/step) as bigint) as ky, min(url) as url from g group by all),
    m as (select uc.key_x, uc.key_y, priority, url, row_number() over (partition by uc.key_x, uc.key_y order by priority, url) as n
      from uc join i on kx = cast(floor(uc.key_x/step) as bigint) and ky = cast(floor(uc.key_y/step) as bigint))
    select key_x, key_y, cast(priority as int) as priority, url from m where n = 1""")
def _priority(spark, sf_dir):
    cells = C.grid_cells(boxes(spark, sf_dir)).select("key_x", "key_y").distinct()
    idx = fx.tile_index(spark, sf_dir)

    def ref(step):
        return F.concat_ws("_", *[F.floor(F.col(k) / step).cast("string") for k in ("key_x", "key_y")])

    # five collections, the fine grids first; every row of the index belongs to one of them
    grids = {"1km": 1.0, "5km": 5.0, "10km": 10.0, "20km": 20.0}
    grid_of = {1: "1km", 2: "1km", 3: "5km", 4: "10km", 5: "20km"}
    index = None
    for priority, grid in grid_of.items():
        chosen = idx.filter(F.col("collection") == str(priority))
        part = chosen.select(F.lit(priority).alias("priority"), F.lit(grid).alias("grid"), ref(grids[grid]).alias("ref"), "url")
        index = part if index is None else index.unionByName(part)
    return C.priority_cover(cells, index, {g: ref(s) for g, s in grids.items()})


@query("index_or_grid", f"""with {INDEX}, last as (select collection, max(vintage) as vintage from idx group by all),
    i as (select distinct collection as area, key_x, key_y, 'dtm_' || key_x || '_' || key_y || '.tif' as tile_name from idx join last using (collection, vintage)),
    g as (select distinct collection as area, key_x, key_y, 'dtm_' || key_x || '_' || key_y || '.tif' as tile_name from idx),
    f as (select collection as area from idx group by collection having sum(case when size < 3e3 then 1 else 0 end) > 11 or min(size) > 2e3)
    select *, 'index' as origin from i union all select g.*, 'grid' from g where area in (select area from f)
      and not exists (select 1 from i where i.area = g.area and i.key_x = g.key_x and i.key_y = g.key_y)""")
def _index_or_grid(spark, sf_dir):
    """The index of an area lists its last vintage; reading it failed where many deliveries came in cut short."""
    idx = fx.tile_index(spark, sf_dir).withColumnRenamed("collection", "area")
    name = C.tile_name(F.lit("dtm"), "key_x", "key_y")
    last = idx.groupBy("area").agg(F.max("vintage").alias("vintage"))
    index = idx.join(last, ["area", "vintage"]).select("area", "key_x", "key_y", name.alias("tile_name")).distinct()
    short = F.count_if(F.col("size") < 3e3)
    log = idx.groupBy("area").agg(F.when((short > 11) | (F.min("size") > 2e3), short + 1).otherwise(0).alias("n_errors"), F.count(F.lit(1)).alias("n_found"))
    cells = idx.select("area", "key_x", "key_y").distinct()
    return C.index_or_grid(index, cells, log, lambda: C.tile_name(F.lit("dtm"), "key_x", "key_y"))


_BNG = "('ABCDEFGHJKLMNOPQRSTUVWXYZ')"


@query("british_grid_reference", f"""with p as (select event_id, (user_id*4793 + event_id*37) % 700000 as e, (event_id*7919 + user_id) % 1200000 as n from events),
    q as (select *, 19 - n//100000 as nn, e//100000 + 10 as ee, (e % 100000)//1000 as ek, (n % 100000)//1000 as nk from p),
    r as (select *, {_BNG}[cast(nn - nn % 5 + ee//5 + 1 as int)] || {_BNG}[cast((nn % 5)*5 + ee % 5 + 1 as int)] as sq from q)
    select event_id, sq || lpad(cast(ek as varchar), 2, '0') || lpad(cast(nk as varchar), 2, '0') as ref_1km, sq || ek//10 || nk//10 as ref_10km,
      sq || ek//10 || nk//10 || case when nk % 10 >= 5 then 'N' else 'S' end || case when ek % 10 >= 5 then 'E' else 'W' end as ref_5km from r""")
def _bng(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("event_id", "(user_id*4793 + event_id*37) % 700000 as e", "(event_id*7919 + user_id) % 1200000 as n")
    return p.select("event_id", *[geo.british_grid_ref("e", "n", k).alias(f"ref_{k}km") for k in (1, 5, 10)])


@query("estonian_sheet_number", """with p as (select event_id, 370000 + (event_id*5000) % 350000 as x, 6380000 + (user_id*5000) % 250000 as y from events)
    select event_id, (y//100000 - 59) || '' || (x//100000 - 2) || ((y % 100000)//10000) || ((x % 100000)//10000)
      || (1 + case when x % 10000 >= 5000 then 1 else 0 end + case when y % 10000 >= 5000 then 2 else 0 end) as sheet from p""")
def _sheet(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("event_id", "370000 + (event_id*5000) % 350000 as x", "6380000 + (user_id*5000) % 250000 as y")
    return p.select("event_id", geo.estonian_sheet("x", "y").alias("sheet"))


_SHEET_NAME = "concat(cast(2400 + l_orderkey % 90 as string), '-', cast(l_suppkey % 2 as string), cast(l_partkey % 2 as string), '-', cast(1 + l_linenumber % 5 as string), cast(1 + l_partkey % 5 as string))"


@query("sheet_cells", f"""with n as (select distinct {_SHEET_NAME} as name from lineitem),
    p as (select name, split_part(name, '-', 1) as s, cast(split_part(name, '-', 2)[1] as int) qr, cast(split_part(name, '-', 2)[2] as int) qc, cast(split_part(name, '-', 3)[1] as int) cr, cast(split_part(name, '-', 3)[2] as int) cc from n)
    select name, (cast(s as bigint)*7 + qc*5 + cc - 1) as key_x, (cast(s as bigint)*3 + qr*5 + cr - 1) as key_y from p""")
def _sheet_cells(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").selectExpr(f"{_SHEET_NAME} as name").distinct()
    # header minima of every cloud: the sheet origin plus the position of the cloud, and some metres
    part = "cast(substring({}, {}, 1) as int)"
    origins = names.selectExpr(
        "name",
        f"(cast(split_part(name, '-', 1) as bigint)*7 + {part.format('name', 7)}*5 + {part.format('name', 10)} - 1)*1e3 + 12.25e0 as min_x",
        f"(cast(split_part(name, '-', 1) as bigint)*3 + {part.format('name', 6)}*5 + {part.format('name', 9)} - 1)*1e3 + 700.5e0 as min_y")
    return C.sheet_cells(names, origins)


@query("polish_zone", "select event_id, 2171 + greatest(5, least(8, cast(round_even((12e0 + (event_id % 140)/1e1)/3e0, 0) as int))) as epsg from events")
def _zone(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", geo.polish_zone_epsg(F.lit(12.0) + (F.col("event_id") % 140) / 10.0).alias("epsg"))


@query("dominant_zone", """with c as (select user_id as lot, 2945 + event_id % 7 as epsg, count(*) as n from events group by all),
    r as (select *, row_number() over (partition by lot order by n desc, epsg) as k, count(*) over (partition by lot) as n_values from c) select lot, epsg, n_values from r where k = 1""")
def _dominant(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id as lot", "2945 + event_id % 7 as epsg")
    return C.dominant(e, "lot", "epsg").select("lot", "epsg", "n_values")


@query("corner_key", """with p as (select event_id, -75e0 + (event_id % 977)/977e0 as lon, 45e0 + (user_id % 331)/331e0 as lat, event_id % 4 = 0 as swapped from events)
    select event_id, cast(round_even((lon + 18e1)*1e4, 0) as bigint) as x, cast(round_even(lat*1e4, 0) as bigint) as y from p""")
def _corner(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("event_id", "-75e0 + (event_id % 977)/977e0 as lon", "45e0 + (user_id % 331)/331e0 as lat", "event_id % 4 = 0 as swapped")
    key = geo.corner_key(F.when(F.col("swapped"), F.col("lat")).otherwise(F.col("lon")), F.when(F.col("swapped"), F.col("lon")).otherwise(F.col("lat")))
    return p.select("event_id", key.alias("k")).select("event_id", "k.x", "k.y")


@query("product_filter", """select o_custkey as "group", count(*) filter (where o_orderpriority like '1-%' or o_orderpriority like '2-%') as n_kept,
    count(*) filter (where not (o_orderpriority like '1-%' or o_orderpriority like '2-%')) as n_dropped from orders group by o_custkey""")
def _product_filter(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), "o_orderpriority")
    return C.product_filter(files, F.col("o_orderpriority").rlike("^[12]-"))


_UNSAFE = ("case event_id % 7 when 0 then concat('tile_', cast(event_id as string), '.tif') when 1 then concat('../', cast(event_id as string), '.tif') when 2 then 'C:\\x.tif' "
           "when 3 then '..' when 4 then '' when 5 then concat('sub/', cast(event_id as string)) else '0958.copc.laz' end")


@query("safe_tile_names", f"""with n as (select event_id, {_UNSAFE} as name from events) select event_id, name from n where event_id % 7 in (0, 6)""")
def _safe(spark, sf_dir):
    names = table(spark, sf_dir, "events").selectExpr("event_id", _UNSAFE.replace("\\", "\\\\") + " as name")
    return names.filter(C.safe_name("name"))


@query("cross_recognised_names", f"""with {INDEX}, t as (select order_id, 'p' || collection as code, case when collection in ('1', '2') then 'xa' else 'xb' end as country,
      case collection when '1' then 'alpha_' when '2' then 'alpha_beta_' when '3' then 'gamma_' when '4' then 'gamma' else 'delta_' end || key_x || '_' || key_y || '.tif' as tile_name from idx)
    select order_id, code, country, tile_name, case code when 'p2' then 'p1' when 'p3' then 'p4' end as taken_by from t where code in ('p2', 'p3')""")
def _cross(spark, sf_dir):
    stem = "case collection when '1' then 'alpha_' when '2' then 'alpha_beta_' when '3' then 'gamma_' when '4' then 'gamma' else 'delta_' end"
    pattern = "case collection when '1' then '^alpha_.*tif$' when '2' then '^alpha_beta_' when '3' then '^gamma_' when '4' then '^gamma' else '^delta_' end"
    country = "case when collection in ('1', '2') then 'xa' else 'xb' end"
    idx = fx.tile_index(spark, sf_dir).selectExpr(
        "order_id", "concat('p', collection) as code", f"{country} as country",
        f"concat({stem}, cast(key_x as string), '_', cast(key_y as string), '.tif') as tile_name", f"{pattern} as pattern")
    providers = idx.select("code", "country", "pattern").distinct()
    found = C.cross_recognised(idx.select("code", "country", "tile_name").distinct(), providers)
    return idx.select("order_id", "code", "country", "tile_name").join(found, ["code", "country", "tile_name"]).select(
        "order_id", "code", "country", "tile_name", "taken_by")


@query("selection_volume", """select o_custkey, sum(0.5e0 + (o_orderkey % 8)*25e-2) as mb, count(*) as n_tiles, sum(0.5e0 + (o_orderkey % 8)*25e-2) > 15e0 as too_large from orders group by o_custkey""")
def _volume(spark, sf_dir):
    return C.selection_volume(table(spark, sf_dir, "orders"), "o_custkey", (F.col("o_orderkey") % 8) * 0.25 + 0.5, 15.0)


@query("request_cache_key", """select event_id, substring(md5(event_type || '|' || user_id || ',' || event_id % 90 || ',' || (user_id + 1) || ',' || (event_id % 90 + 1)), 1, 12) as key from events""")
def _cache_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u, v = F.col("user_id"), F.col("event_id") % 90
    return e.select("event_id", C.request_key("event_type", u, v, u + 1, v + 1).alias("key"))


@query("service_ranking", """with c as (select 'host' || o_custkey % 97 || '.example' as host, o_orderkey as url, o_totalprice > 250000 as usable, 0.25e0*(1 + o_orderkey % 20) as resolution_m from orders),
    r as (select *, row_number() over (partition by host order by usable desc, resolution_m, url) as n from c) select host, url, usable, resolution_m from r where n = 1""")
def _services(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr(
        "concat('host', cast(o_custkey % 97 as string), '.example') as host", "o_orderkey as url", "o_totalprice > 250000 as usable", "0.25e0*(1 + o_orderkey % 20) as resolution_m")
    return C.rank_services(c).select("host", "url", "usable", "resolution_m")


_PROVIDER_NAME = "case c_custkey % 3 when 0 then c_name when 1 then concat(c_name, ' 50 cm') else concat(c_name, ' DTM 1m') end"
_RES_M = "case c_custkey % 4 when 0 then 0.5e0 when 1 then 1e0 when 2 then 2.5e0 end"
_COUNTRY = "case c_nationkey % 4 when 0 then 'fr' when 1 then 'jp' when 2 then 'gb' else 'us' end"


@query("provider_list", f"""with p as (select c_custkey, {_PROVIDER_NAME} as name, {_RES_M} as res, {_COUNTRY} as country from customer),
    k(country, country_rank, country_name) as (values ('fr', 0, 'France'), ('gb', 1, 'UK'), ('us', 21, 'USA'), ('jp', 26, 'Japan'))
    select c_custkey, country_rank, country_name, case when name like '% cm' or name like '% 1m' or res is null then name else
      name || case res when 0.5 then ' (0.5 m)' when 1 then ' (1 m)' else ' (2.5 m)' end end as display_name from p join k using (country)""")
def _providers(spark, sf_dir):
    names = F.create_map(*[F.lit(v) for i, (code, name) in enumerate(C.COUNTRY_ORDER) for v in (code, f"{i}|{name}")])
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PROVIDER_NAME} as name", f"{_RES_M} as res", f"{_COUNTRY} as country")
    ranked = p.withColumn("c", F.split(F.element_at(names, F.col("country")), r"\|"))
    return ranked.select("c_custkey", F.col("c")[0].cast("int").alias("country_rank"), F.col("c")[1].alias("country_name"),
                         C.display_name("name", "res").alias("display_name"))


@query("nominal_bounds", f"""with {INDEX}, b as (select order_id, key_x, case when order_id % 2 = 0 then key_y else key_y - 1 end as s from idx)
    select order_id, key_x*1e3 as x0, s*1e3 as y0, (key_x + 1)*1e3 as x1, (s + 1)*1e3 as y1 from b""")
def _nominal(spark, sf_dir):
    convention = F.when(F.col("order_id") % 2 == 0, "sw").otherwise("top")
    return fx.tile_index(spark, sf_dir).select("order_id", C.nominal_bounds("key_x", "key_y", convention).alias("b")).select("order_id", "b.*")


@query("layer_alias_and_zoom", """with r as (select event_id, case event_type when 'view' then 'planign' when 'click' then 'ortho' else event_type end as alias, cast(user_id % 12 as int) as zmin, cast(10 + event_id % 13 as int) as zmax from events),
    l(alias, identifier, layer_min, layer_max) as (values ('planign', 'PLAN.V2', 3, 16), ('ortho', 'ORTHO.BD', 6, 19))
    select event_id, coalesce(identifier, r.alias) as layer, greatest(zmin, coalesce(layer_min, 0)) as z0, least(zmax, coalesce(layer_max, 22)) as z1 from r left join l on r.alias = l.alias""")
def _alias(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr(
        "event_id", "case event_type when 'view' then 'planign' when 'click' then 'ortho' else event_type end as wanted", "cast(user_id % 12 as int) as zmin", "cast(10 + event_id % 13 as int) as zmax")
    layers = spark.createDataFrame([("planign", "PLAN.V2", 3, 16), ("ortho", "ORTHO.BD", 6, 19)], "alias string, identifier string, layer_min int, layer_max int")
    return C.zoom_request("wanted", "zmin", "zmax", layers, r).select("event_id", "layer", "z0", "z1")
