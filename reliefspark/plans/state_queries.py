"""Registered run-state, coverage and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliefspark.functions import geo, geom
from reliefspark.operators import points as P
from reliefspark.operators import quality as Q
from reliefspark.operators import state as G
from reliefspark.plans import fixtures as fx
from reliefspark.plans.catalogue_queries import BOXES, boxes
from reliefspark.plans.fixtures import INDEX, PTS
from reliefspark.plans.registry import query
from reliefspark.session import staging_folder, table
from reliefspark.streaming.new_tiles import process_new_tiles

# -- chunks and manifests -------------------------------------------------------------------------

_KEY = "printf('%03dx%03d', r + 1, c + 1)"


@query("chunks_by_grid", f"""with {BOXES}, a as (select *, 1 + c_custkey % 3 as nx, 2 + c_custkey % 2 as ny from box),
    b as (select *, unnest(range(ny)) as r from a), k as (select *, unnest(range(nx)) as c from b)
    select c_custkey, {_KEY} as chunk, x0 + c*((x1 - x0)/nx) as cx0, y0 + r*((y1 - y0)/ny) as cy0, x0 + (c + 1)*((x1 - x0)/nx) as cx1, y0 + (r + 1)*((y1 - y0)/ny) as cy1 from k""")
def _chunks(spark, sf_dir):
    chunks = G.split_area(boxes(spark, sf_dir), F.col("c_custkey") % 3 + 1, F.col("c_custkey") % 2 + 2)
    return chunks.select("c_custkey", "chunk", *[F.col(f"chunk_box.{k}").alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])


@query("chunks_by_side", f"""with {BOXES}, a as (select *, greatest(1, cast(ceil((x1 - x0)/9e2) as int)) as nx, greatest(1, cast(ceil((y1 - y0)/9e2) as int)) as ny from box),
    b as (select *, unnest(range(ny)) as r from a), k as (select *, unnest(range(nx)) as c from b)
    select c_custkey, {_KEY} as chunk, x0 + c*9e2 as cx0, y0 + (r + 1)*9e2 as cy1 from k""")
def _chunks_side(spark, sf_dir):
    chunks = G.split_area(boxes(spark, sf_dir), side_m=900.0)
    return chunks.select("c_custkey", "chunk", F.col("chunk_box.x0").alias("cx0"), F.col("chunk_box.y1").alias("cy1"))


@query("area_blocks", f"""with {BOXES}, b as (select *, unnest(range(1, 4)) as block from box)
    select c_custkey, cast(block as int) as block, x0 + (block - 1)*((x1 - x0)/3e0) as bx0, x0 + block*((x1 - x0)/3e0) as bx1 from b""")
def _blocks(spark, sf_dir):
    parts = boxes(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return G.area_block(parts, F.col("i"), 3).select("c_custkey", "block", F.col("bbox.x0").alias("bx0"), F.col("bbox.x1").alias("bx1"))


def _chunk_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    chunks = orders.selectExpr("o_orderkey as chunk", "cast(o_orderkey % 6 as int) as n_sources")
    manifest = orders.selectExpr("o_orderkey as chunk", "o_orderstatus = 'F' as done")
    deliverables = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as chunk", "l_linenumber % 2 = 1 as requested", "l_quantity > 12 as complete")
    return chunks, manifest, deliverables


@query("pending_chunks", "select o_orderkey as chunk, cast(o_orderkey % 6 as int) as n_sources from orders where o_orderstatus <> 'F'")
def _pending(spark, sf_dir):
    chunks, manifest, _ = _chunk_tables(spark, sf_dir)
    return G.pending_chunks(chunks, manifest)


_OUTCOME = """d as (select l_orderkey as chunk, bool_and(l_quantity > 12) as complete from lineitem where l_linenumber % 2 = 1 group by l_orderkey),
    o as (select o_orderkey as chunk, cast(o_orderkey % 6 as int) as n_sources, complete from orders left join d on chunk = o_orderkey)"""


@query("chunk_outcome", f"""with {_OUTCOME} select chunk, n_sources, case when n_sources = 0 then 'empty' when coalesce(complete, false) then 'done' else 'open' end as outcome,
    n_sources = 0 or coalesce(complete, false) as done from o""")
def _outcome(spark, sf_dir):
    chunks, _, deliverables = _chunk_tables(spark, sf_dir)
    return G.chunk_outcome(chunks, deliverables)


@query("next_manifest", f"""with {_OUTCOME} select chunk, n_sources = 0 or coalesce(complete, false) as done from o where chunk in (select o_orderkey from orders where o_orderstatus = 'P')
    union all select o_orderkey, o_orderstatus = 'F' from orders where o_orderstatus <> 'P'""")
def _next(spark, sf_dir):
    chunks, manifest, deliverables = _chunk_tables(spark, sf_dir)
    current = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").selectExpr("o_orderkey as chunk")
    return G.next_manifest(manifest, G.chunk_outcome(chunks.join(current, "chunk"), deliverables))


@query("config_signature", """select o_orderkey, sha256((10 + o_orderkey % 4) || '|' || '18' || '|' || case when o_custkey % 2 = 0 then 'png' else '-' end || '|' ||
    case when o_orderkey % 2 = 0 then 'highway,waterway' else 'highway' end || '|' || (650000 + o_custkey) || '|' || 6300000 || '|' || 1000) as signature from orders""")
def _signature(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("waterway"), F.lit("highway"))).otherwise(F.array(F.lit("highway")))
    settings = [F.col("o_orderkey") % 4 + 10, F.lit(18), F.when(F.col("o_custkey") % 2 == 0, "png")]
    return o.select("o_orderkey", G.config_signature(settings, tags, F.col("o_custkey") + 650000, F.lit(6300000), F.lit(1000)).alias("signature"))


@query("valid_manifest", """select o_custkey as run, o_orderkey as chunk, 'v' || o_orderkey % 3 as signature from orders where o_orderkey % 3 = o_custkey % 3""")
def _valid(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    manifest = o.selectExpr("o_custkey as run", "o_orderkey as chunk", "concat('v', cast(o_orderkey % 3 as string)) as signature")
    current = table(spark, sf_dir, "customer").selectExpr("c_custkey as run", "concat('v', cast(c_custkey % 3 as string)) as signature")
    return G.valid_manifest(manifest, current).select("run", "chunk", "signature")


@query("stale_products", """with p as (select l_orderkey as key, count(*) filter (where l_quantity > 10) as n_tiles, min(l_linenumber) < 3 as readable, max(l_shipdate) as made from lineitem group by l_orderkey)
    select o_orderkey as key, case when made is null then 'missing' when not readable then 'unreadable' when n_tiles = 0 then 'empty' when o_orderdate > made then 'outdated' end as reason
    from orders left join p on key = o_orderkey""")
def _stale(spark, sf_dir):
    products = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.count_if(F.col("l_quantity") > 10).alias("n_tiles"), (F.min("l_linenumber") < 3).alias("readable"), F.max("l_shipdate").alias("modified"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("modified"))
    return G.stale_products(products, sources).select("key", "reason")


@query("cached_fragments", """with f as (select c_custkey as file, c_acctbal as x0, c_custkey*1e0 as y0, c_acctbal + 3e3 as x1, c_custkey + 5e1 as y1 from customer)
    select o_orderkey from orders join f on file = o_custkey where x0 <= o_totalprice/1e2 and y0 <= o_custkey + 1 and x1 >= o_totalprice/1e2 + 5e2 and y1 >= o_custkey + o_orderkey % 60""")
def _cached(spark, sf_dir):
    fragments = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("file"), geo.bbox("c_acctbal", "c_custkey", F.col("c_acctbal") + 3000.0, F.col("c_custkey") + 50.0).alias("bbox"))
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file"), geo.bbox(
        F.col("o_totalprice") / 100.0, F.col("o_custkey") + 1, F.col("o_totalprice") / 100.0 + 500.0, F.col("o_custkey") + F.col("o_orderkey") % 60).alias("bbox"))
    return G.cached_fragments(requests, fragments).select("o_orderkey")


_FILES = ["o_custkey as chunk_no", "concat('dalle_', cast((o_custkey + o_orderkey % 3) % 1000 as string), '_', cast(o_orderkey % 5 as string)) as file", "case when o_orderkey % 4 = 0 then 'cache' else 'work' end as folder"]


@query("cleanup_plan", f"""with f as (select {', '.join(_FILES)} from orders) select chunk_no, file, folder from f
    where folder <> 'cache' and not exists (select 1 from f n where n.chunk_no = f.chunk_no + 1 and n.file = f.file)""")
def _cleanup(spark, sf_dir):
    return G.cleanup_plan(table(spark, sf_dir, "orders").selectExpr(*_FILES), ["cache"]).select("chunk_no", "file", "folder")


@query("purge_small_tiles", """select o_orderkey, o_totalprice as length, o_custkey % 10 as code from orders where o_totalprice < 20000e0*(1 + o_custkey % 10)""")
def _purge_small(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice as length", "o_custkey % 10 as code")
    limits = table(spark, sf_dir, "customer").selectExpr("c_custkey % 10 as code").distinct().selectExpr("code", "20000e0*(1 + code) as min_length")
    return G.purge_small(files, limits).select("o_orderkey", "length", "code")


@query("purge_outside_zone", f"""with {INDEX}, zone as (select distinct l_orderkey from lineitem where l_returnflag = 'R')
    select order_id, tile_name from idx where regexp_matches(tile_name, '^dtm_[0-9]+_1[0-9]_') and order_id not in (select l_orderkey from zone)""")
def _purge_outside(spark, sf_dir):
    """The zone names the tiles of all orders with a returned part."""
    idx = fx.tile_index(spark, sf_dir)
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id")).distinct()
    return G.purge_outside(idx, idx.join(returned, "order_id", "left_semi"), r"^dtm_[0-9]+_1[0-9]_").select("order_id", "tile_name")


_NEW = ["key_x", "key_y", "vintage", "order_id"]


@query("new_tiles_only", f"""with {INDEX} select key_x, cast(order_id % 2 as int) as generation, cast(order_id % 2 as int) as run, count(*) as n_tiles, max(vintage) as newest from idx group by all""")
def _new_tiles(spark, sf_dir):
    """Two generations of index files land one after the other, with a run after each and one more at the end.

    The column ``run`` tells which run wrote a row: the second one must give the second generation alone, the last
    one nothing.
    """
    folder = staging_folder(spark, "new_tiles")
    landed = table(spark, sf_dir, "orders").select("*", (F.col("o_orderkey") % 2).cast("int").alias("generation"))
    for generation in (0, 1, None):
        if generation is not None:
            landed.filter(F.col("generation") == generation).write.mode("append").parquet(f"{folder}/in")
        process_new_tiles(spark, f"{folder}/in", landed.schema, f"{folder}/out", f"{folder}/progress",
                          lambda batch: batch.selectExpr(*fx.INDEX_COLUMNS, "generation").select(*_NEW, "generation"))
    return spark.read.parquet(f"{folder}/out").groupBy("key_x", "generation", F.col("batch").alias("run")).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.max("vintage").alias("newest"))


# -- coverage -------------------------------------------------------------------------------------

_PROVIDERS = "concat('p', cast(c_custkey % 40 as string))"


@query("coverage_map", """with p as (select distinct 'p' || o_custkey % 40 as code from orders),
    r as (select c_custkey as region, case when c_custkey % 5 = 0 then c_name end as label, 'p' || c_custkey % 40 as a, 'p' || (c_custkey*7 + 1) % 40 as b from customer)
    select region, coalesce(label, 'Name ' || a || ' + Name ' || b) as title, a || ',' || b as codes,
      cast(substring(a, 2) as int) % 6 = 0 or cast(substring(b, 2) as int) % 6 = 0 as has_cloud from r""")
def _coverage(spark, sf_dir):
    base = table(spark, sf_dir, "orders").selectExpr("concat('p', cast(o_custkey % 40 as string)) as code", "o_custkey % 40 as n").distinct()
    twins = base.filter("n % 6 = 0").selectExpr("concat(code, '-laz') as code", "concat('Name ', code, ' cloud') as name")
    providers = base.selectExpr("code", "concat('Name ', code) as name").unionByName(twins)
    regions = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as region", "case when c_custkey % 5 = 0 then c_name end as label",
        f"array({_PROVIDERS}, concat('p', cast((c_custkey*7 + 1) % 40 as string))) as codes")
    return Q.coverage_map(regions, providers)


@query("coverage_style", """with r as (select c_custkey as region, case when c_custkey % 5 = 0 then c_name end as label, 'p' || c_custkey % 40 as a, 'p' || (c_custkey*7 + 1) % 40 as b, '#' || lpad(cast(c_custkey % 1000 as varchar), 6, '0') as color from customer),
    p as (select distinct 'p' || o_custkey % 40 as code from orders)
    select region, coalesce(label, cast(region as varchar)) as label, 'Provider(s) : ' || a || ', ' || b as description, color as fill, 0.35e0 as fill_opacity, color as stroke, 1.5e0 as stroke_width
    from r where a in (select code from p) and b in (select code from p)""")
def _coverage_style(spark, sf_dir):
    """How each region is drawn."""
    base = table(spark, sf_dir, "orders").selectExpr("concat('p', cast(o_custkey % 40 as string)) as code").distinct()
    regions = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as region", "case when c_custkey % 5 = 0 then c_name end as label", "concat('#', lpad(cast(c_custkey % 1000 as string), 6, '0')) as color",
        f"array({_PROVIDERS}, concat('p', cast((c_custkey*7 + 1) % 40 as string))) as codes")
    return Q.coverage_map(regions, base.selectExpr("code", "concat('Name ', code) as name")).select("region", "shown_as.*")


@query("region_codes_without_provider", """select distinct 'p' || c_custkey % 40 as code from customer where c_custkey % 40 not in (select o_custkey % 37 from orders)""")
def _no_provider(spark, sf_dir):
    providers = table(spark, sf_dir, "orders").selectExpr("concat('p', cast(o_custkey % 37 as string)) as code").distinct()
    regions = table(spark, sf_dir, "customer").selectExpr(f"array({_PROVIDERS}) as codes")
    return Q.codes_without_provider(regions, providers)


@query("countries_without_name", """select distinct 'c' || c_nationkey as country from customer where c_nationkey % 5 <> 0""")
def _no_name(spark, sf_dir):
    providers = table(spark, sf_dir, "customer").selectExpr("concat('c', cast(c_nationkey as string)) as country")
    names = table(spark, sf_dir, "customer").filter("c_nationkey % 5 = 0").selectExpr("concat('c', cast(c_nationkey as string)) as country").distinct()
    return Q.countries_without_name(providers, names)


@query("country_count", """select count(distinct case when c_nationkey % 6 <> 0 then c_nationkey end) as n_countries from customer""")
def _countries(spark, sf_dir):
    return Q.country_count(table(spark, sf_dir, "customer").selectExpr("case when c_nationkey % 6 = 0 then '' else cast(c_nationkey as string) end as country"))


_RING_A = "array(named_struct('x', c_acctbal, 'y', c_custkey*1e0), named_struct('x', c_acctbal + 5e1, 'y', c_custkey*1e0), named_struct('x', c_acctbal + 5e1, 'y', c_custkey + 1e1))"
_RING_B = "array(named_struct('x', c_acctbal*2, 'y', c_custkey*1e0), named_struct('x', c_acctbal*2 + 5e1, 'y', c_custkey*1e0), named_struct('x', c_acctbal*2 + 5e1, 'y', c_custkey + 1e1))"


@query("multipolygon_clip", """with a as (select c_custkey, c_acctbal + 50 >= 2000 and c_acctbal <= 4000 and c_custkey + 10 >= 100 and c_custkey <= 900 as a,
      c_acctbal*2 + 50 >= 2000 and c_acctbal*2 <= 4000 and c_custkey + 10 >= 100 and c_custkey <= 900 as b from customer)
    select c_custkey, case when a and b then 2 when a or b then 1 else 2 end as n_parts from a""")
def _clip_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"array(array({_RING_A}), array({_RING_B})) as parts")
    return parts.select("c_custkey", F.size(geom.parts_in_box("parts", (2000, 100, 4000, 900))).alias("n_parts"))


@query("region_label_point", """select c_custkey, cast(floor((c_acctbal + (c_acctbal + 5e1) + (c_acctbal + 5e1))/3e0*1e3 + 5e-1) as bigint) as x_1e3, cast(floor((c_custkey + c_custkey + (c_custkey + 1e1))/3e0*1e3 + 5e-1) as bigint) as y_1e3,
    (c_acctbal + (c_acctbal + 5e1) + (c_acctbal + 5e1))/3e0 < 1e2 as west_panel from customer""")
def _label(spark, sf_dir):
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_RING_A} as ring").withColumn("m", geom.ring_mean("ring"))
    return r.select("c_custkey", F.floor(F.col("m.x") * 1e3 + 0.5).cast("bigint").alias("x_1e3"), F.floor(F.col("m.y") * 1e3 + 0.5).cast("bigint").alias("y_1e3"),
                    (F.col("m.x") < 100.0).alias("west_panel"))


@query("storage_by_tier", """select case event_type when 'view' then 'cache' when 'click' then 'production' else 'projects' end as tier, cast(sum(event_id*10 + user_id) as bigint) as bytes, count(*) as n_files from events group by 1""")
def _storage(spark, sf_dir):
    return Q.storage_by_tier(table(spark, sf_dir, "events").selectExpr(
        "case event_type when 'view' then 'cache' when 'click' then 'production' else 'projects' end as tier", "event_id*10 + user_id as length"))


# -- quality --------------------------------------------------------------------------------------

_SAMPLE = ["l_orderkey as tile", "l_orderkey % 12 as code", "case l_orderkey % 7 when 0 then null when 1 then 3857 else 2154 end as epsg",
           "0.5e0 + (l_orderkey % 3)*4e-2 as pixel", "case when l_orderkey % 11 <> 0 then l_quantity end as z"]


@query("tile_check", f"""with t as (select {', '.join(_SAMPLE)} from lineitem), f as (select tile, code, max(epsg) as epsg, max(pixel) as pixel, count(z) as n_valid, min(z) as z_min, max(z) as z_max from t group by all)
    select *, case when n_valid = 0 then 'no valid cell' when epsg is null then 'no crs' when epsg = 2154 and abs(pixel - 5e-1) > 5e-1*0.1e0 then 'wrong resolution' else 'pass' end as verdict from f""")
def _tile_check(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").selectExpr(*_SAMPLE)
    declared = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 12 as code").distinct().selectExpr("code", "2154 as native_epsg", "5e-1 as resolution_m")
    return Q.tile_check(tiles, declared)


_DETAIL = ("case event_id % 5 when 0 then 'discover -> None (network)' when 1 then concat('TimeoutError: ', cast(user_id as string)) when 2 then '0 tiles' "
           "when 3 then concat('download=erreur (', cast(event_id as string), ')') else 'KeyError: x' end")


@query("status_summary", f"""with r as (select case event_type when 'error' then 'FAIL' when 'view' then 'PASS' when 'click' then 'SKIP' else 'FAIL' end as status, {_DETAIL} as detail from events)
    select status, count(*) as n, count(*) filter (where status = 'FAIL' and (detail like 'discover -> None%' or detail like 'download=erreur%' or detail like '%TimeoutError%')) as n_retry from r group by status""")
def _status(spark, sf_dir):
    return Q.status_summary(table(spark, sf_dir, "events").selectExpr(
        "case event_type when 'error' then 'FAIL' when 'view' then 'PASS' when 'click' then 'SKIP' else 'FAIL' end as status", f"{_DETAIL} as detail"))


@query("raster_difference", f"""with {PTS}, a as (select cast(floor(-y/4e0) as bigint) r, cast(floor(x/4e0) as bigint) c, min(z) as z from pts where cls = 2 group by all),
    b as (select cast(floor(-y/4e0) as bigint) r, cast(floor(x/4e0) as bigint) c, min(z) as z from pts where cls in (9, 66) group by all),
    d as (select floor(abs(a.z - b.z)*1e3 + 5e-1) as s from a join b using (r, c))
    select count(*) as n_cells, cast(floor(avg(s)*1e3 + 5e-1) as bigint) as mean_1e6, cast(floor(quantile_cont(s, 0.95)*1e3 + 5e-1) as bigint) as p95_1e6 from d""")
def _difference(spark, sf_dir):
    cloud = fx.points(spark, sf_dir)
    grid = P.Grid(res=4.0)
    first, second = P.bin_min(cloud, grid, {"z": (2,)}), P.bin_min(cloud, grid, {"z": (9, 66)})
    d = Q.raster_difference(first, second, "z", digits=3)
    return d.select("n_cells", F.floor(F.col("mean_abs") * 1e6 + 0.5).cast("bigint").alias("mean_1e6"), F.floor(F.col("p95_abs") * 1e6 + 0.5).cast("bigint").alias("p95_1e6"))
