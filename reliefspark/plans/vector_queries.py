"""Registered vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliefspark.functions import geo, geom
from reliefspark.operators import vector as V
from reliefspark.operators.tiles import payload_kind
from reliefspark.plans import fixtures as fx
from reliefspark.plans.fixtures import FEATURES
from reliefspark.plans.registry import query
from reliefspark.session import table

_TOKEN = ("case event_id % 6 when 0 then event_type when 1 then concat(event_type, '=*') when 2 then concat(event_type, '=', cast(user_id % 5 as string)) "
          "when 3 then concat(event_type, ' = ', cast(user_id % 3 as string), ',', cast(user_id % 7 as string)) when 4 then '  ' else concat('natural=w', cast(user_id % 4 as string)) end")


@query("tag_filter_parse", f"""with t as (select event_id, cast(floor(event_id/5e0) as bigint) as g, {_TOKEN} as token from events),
    k as (select g, event_id, trim(split_part(token, '=', 1)) as key, case when contains(token, '=') then trim(split_part(token, '=', 2)) else '*' end as v from t),
    u as (select g, event_id, key, v = '*' as bare, trim(unnest(string_split(v, ','))) as value from k where key <> ''),
    a as (select g, key, bool_or(bare) as any_value, min(event_id) as position, string_agg(distinct case when not bare then value end, ',' order by case when not bare then value end) as vals from u group by all)
    select g, key, any_value, position, case when any_value then '' else coalesce(vals, '') end as wanted from a""")
def _tag_filters(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").selectExpr("event_id as position", "cast(floor(event_id/5e0) as bigint) as g", f"{_TOKEN} as token")
    return V.parse_tag_filters(tokens, by=["g"]).select("g", "key", "any_value", "position", F.concat_ws(",", "wanted").alias("wanted"))


_OBJECT_TAGS = f"""{FEATURES}, tags as (select user_id*1000 + feature_id % 40 as object_id, key, value from feat),
    flt(key, v, any_value, pos) as (values ('click', '1', false, 0), ('click', '2', false, 0), ('click', '35', false, 0), ('view', null, true, 1), ('error', null, true, 2)),
    hit as (select object_id, tags.key, value, pos from tags join flt on tags.key = flt.key and (any_value or flt.v = value)),
    r as (select *, row_number() over (partition by object_id order by pos, value) as n from hit)"""


@query("classify_by_first_filter", f"with {_OBJECT_TAGS} select object_id, key, value from r where n = 1")
def _classify(spark, sf_dir):
    tags = fx.features(spark, sf_dir).selectExpr("user_id*1000 + feature_id % 40 as object_id", "key", "value")
    filters = V.tag_filters(spark, ["click=1,2", "view", "click=35", "error=*"])
    return V.classify(tags, filters).select("object_id", "key", "value")


@query("way_lines", """with n as (select event_id as node_id, 5.5e0 + (user_id % 997)/997e0 as lon, 43e0 + (event_id % 991)/991e0 as lat from events),
    w as (select o_orderkey as way_id, pos, o_custkey*7 + pos*3 + o_orderkey % 11 as node_id from orders, range(5) p(pos))
    select way_id, count(*) as n_vertices, cast(floor(min_by(lon, pos)*1e9 + 5e-1) as bigint) as first_lon, cast(floor(max_by(lat, pos)*1e9 + 5e-1) as bigint) as last_lat from w join n using (node_id) group by way_id""")
def _ways(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    nodes = events.selectExpr("event_id as node_id", "5.5e0 + (user_id % 997)/997e0 as lon", "43e0 + (event_id % 991)/991e0 as lat")
    way_nodes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("way_id"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")).select(
        "way_id", "pos", (F.col("o_custkey") * 7 + F.col("pos") * 3 + F.col("way_id") % 11).alias("node_id"))
    lines = V.way_lines(way_nodes, nodes)
    return lines.select("way_id", F.size("line").cast("bigint").alias("n_vertices"),
                        F.floor(F.element_at("line", 1).x * 1e9 + 0.5).cast("bigint").alias("first_lon"),
                        F.floor(F.element_at("line", -1).y * 1e9 + 0.5).cast("bigint").alias("last_lat"))


_BY = '"by"'


@query("features_in_area", f"""with {FEATURES} select feature_id, key from feat
    where greatest(ax, bx) >= 5.55e0 and least(ax, bx) <= 5.6e0 and greatest(ay, {_BY}) >= 43.2e0 and least(ay, {_BY}) <= 43.6e0""")
def _in_area(spark, sf_dir):
    return V.in_area(fx.line_features(spark, sf_dir), (5.55, 43.2, 5.6, 43.6)).select("feature_id", "key")


_UNSAFE_TOKEN = ("case event_id % 8 when 0 then 'highway=*' when 1 then 'boundary=administrative' when 2 then 'building' when 3 then 'addr:housenumber=*' "
                 "when 4 then concat('highway=* & calc', cast(user_id as string)) when 5 then 'x=y | whoami' when 6 then concat('a;rm ', cast(event_id as string)) else concat('highway=residential,track', cast(user_id as string)) end")


@query("tag_filter_guard", f"select event_id, event_id % 8 in (0, 1, 2, 3, 7) as safe from (select event_id, {_UNSAFE_TOKEN} as token from events)")
def _guard(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_UNSAFE_TOKEN} as token").select("event_id", V.safe_filter("token").alias("safe"))


@query("merged_features", f"""with {FEATURES} select source, count(*) as n, min(least(ax, bx)) as x0, max(greatest(ay, {_BY})) as y1 from feat group by source""")
def _merged(spark, sf_dir):
    lines = fx.line_features(spark, sf_dir)
    files = {f"layer_{i}": lines.filter(F.col("source") == f"layer_{i}").drop("source") for i in range(3)}
    merged = V.merge_files(files).withColumn("b", geom.rings_bbox("rings"))
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("b.x0").alias("x0"), F.max("b.y1").alias("y1"))


@query("merged_total_bbox", f"""with {FEATURES} select min(least(ax, bx)) as x0, min(least(ay, {_BY})) as y0, max(greatest(ax, bx)) as x1, max(greatest(ay, {_BY})) as y1 from feat""")
def _total(spark, sf_dir):
    return V.total_bbox(fx.line_features(spark, sf_dir), geom.rings_bbox("rings"))


_SOURCE = "case event_id % 4 when 0 then 'zone_ign_cours_d_eau' when 1 then 'IGN_batiment' when 2 then 'unknown' end"
_FILE = "case user_id % 2 when 0 then 'zone_ign_plan_d_eau.geojson' else 'zone.geojson' end"


@query("layer_tags", f"""with t as (select event_id, lower(coalesce({_SOURCE}, {_FILE})) as t from events)
    select event_id, case when t like '%cours_d_eau%' then 'waterway=river' when t like '%plan_d_eau%' then 'natural=water' when t like '%batiment%' then 'building=yes' else 'note=' end as tag from t""")
def _layer_tags(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_SOURCE} as source", f"{_FILE} as file")
    return e.select("event_id", V.layer_tags("source", "file").alias("tag"))


@query("degenerate_rings", f"""with {FEATURES} select feature_id, 4 as n_vertices from feat where bx <> ax and {_BY} <> ay""")
def _degenerate(spark, sf_dir):
    return V.drop_degenerate(fx.ring_features(spark, sf_dir)).select("feature_id", F.size(F.element_at("rings", 1)).alias("n_vertices"))


@query("simplify_tolerance", """select p_partkey, case when a < 200 then 3e0 when a < 1000 then 8e0 when a < 15000 then 15e0 when a < 100000 then 25e0 else 40e0 end as metres
    from (select p_partkey, p_retailprice*p_size*p_size/2e1 as a from part)""")
def _tolerance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.simplify_tolerance(F.col("p_retailprice") * F.col("p_size") * F.col("p_size") / 20.0).alias("metres"))


_WAVE = "sin(o_orderkey + i*i*7e-1)*5e-1"


@query("simplified_lines", f"""with recursive v as (select o_orderkey as k, i, i*1e0 as x, {_WAVE} as y from orders, range(12) r(i)),
    seg(k, s, e) as (select o_orderkey, cast(0 as bigint), cast(11 as bigint) from orders
      union all select k, case when h = 0 then s else m end, case when h = 0 then m else e end
      from (select k, s, e, arg_min(i, row(-d, i)) as m, max(d) as d
            from (select seg.k, s, e, p.i, abs((p.x - a.x)*(b.y - a.y) - (p.y - a.y)*(b.x - a.x))/sqrt((b.x - a.x)*(b.x - a.x) + (b.y - a.y)*(b.y - a.y)) as d
                  from seg join v p on p.k = seg.k and p.i > s and p.i < e join v a on a.k = seg.k and a.i = s join v b on b.k = seg.k and b.i = e) group by k, s, e) f,
        (values (0), (1)) t(h) where d > 0.35e0),
    kept as (select distinct k, unnest([s, e]) as i from seg)
    select k as o_orderkey, cast(count(*) as int) as n_vertices, cast(sum(i) as bigint) as x_sum, cast(floor(sum(y)*1e6 + 5e-1) as bigint) as y_sum_1e6 from kept join v using (k, i) group by k""")
def _simplified(spark, sf_dir):
    # twelve vertices on a wave, so that the line is split several times
    vertex = F.expr(f"transform(sequence(0, 11), i -> struct(i*1e0 as x, {_WAVE} as y))")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.array(vertex).alias("rings"), F.lit(0.35).alias("tolerance"))
    ring = F.element_at("rings", 1)

    def total(axis):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis])

    return V.simplify(lines).select("o_orderkey", F.size(ring).alias("n_vertices"), total("x").cast("bigint").alias("x_sum"), F.floor(total("y") * 1e6 + 0.5).cast("bigint").alias("y_sum_1e6"))


@query("simplified_rings", """with s as (select o_orderkey, 2e1 + o_custkey % 30 as side, [((o_orderkey + i*3) % 5)*25e-2 for i in range(4)] as off from orders)
    select o_orderkey, cast(5 + len(list_filter(off, lambda e: e > 5e-1)) as int) as n_vertices,
      cast(floor((side*side + list_sum(list_transform(off, lambda e: case when e > 5e-1 then e*side/2e0 else 0e0 end)))*1e6 + 5e-1) as bigint) as area_1e6 from s""")
def _simplified_rings(spark, sf_dir):
    """Closed squares with a vertex in the middle of each side, pushed out more or less than the tolerance: corners and closure stay."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "2e1 + o_custkey % 30 as s", *[f"((o_orderkey + {3 * i}) % 5)*25e-2 as e{i}" for i in range(4)])
    s, e = F.col("s"), [F.col(f"e{i}") for i in range(4)]
    zero, half = F.lit(0.0), s / 2.0
    vertices = ((zero, zero), (half, -e[0]), (s, zero), (s + e[1], half), (s, s), (half, s + e[2]), (zero, s), (-e[3], half), (zero, zero))
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in vertices])
    done = F.element_at(F.col("rings"), 1)
    out = V.simplify(o.select("o_orderkey", F.array(ring).alias("rings"), F.lit(0.5).alias("tolerance")))
    sides = F.zip_with(F.slice(done, 1, F.size(done) - 1), F.slice(done, 2, F.size(done) - 1), lambda p, q: p.x * q.y - q.x * p.y)
    area = F.abs(F.aggregate(sides, F.lit(0.0), lambda acc, v: acc + v)) / 2.0
    return out.select("o_orderkey", F.size(done).alias("n_vertices"), F.floor(area * 1e6 + 0.5).cast("bigint").alias("area_1e6"))


# a slanted square cut to a box: the twin adds up the trapezoids between all places where an edge bends
@query("clipped_polygons", """with s as (select o_orderkey, (o_custkey % 20) - 5e0 as cx, (o_orderkey % 17) - 4e0 as cy, 1.5e0 + o_custkey % 6 as h from orders),
    b as (select *, unnest([cx - h, cx, cx + h, 0e0, 1e1, cx - (cy + h - 1e1), cx + (cy + h - 1e1), cx - (cy + h), cx + (cy + h), cx - (h - cy), cx + (h - cy), cx - (1e1 - cy + h), cx + (1e1 - cy + h)]) as x from s),
    c as (select *, greatest(0e0, cx - h) as lo, least(1e1, cx + h) as hi from b),
    d as (select distinct o_orderkey, cx, cy, h, greatest(lo, least(hi, x)) as x from c where lo < hi),
    f as (select o_orderkey, x, greatest(0e0, least(1e1, cy + h - abs(x - cx)) - greatest(0e0, cy - h + abs(x - cx))) as y from d),
    t as (select o_orderkey, (x - lag(x) over w)*(y + lag(y) over w)/2e0 as part from f window w as (partition by o_orderkey order by x))
    select o_orderkey, cast(floor(sum(part)*1e6 + 5e-1) as bigint) as area_1e6 from t group by o_orderkey having sum(part) > 0""")
def _clipped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "(o_custkey % 20) - 5e0 as x", "(o_orderkey % 17) - 4e0 as y", "15e-1 + o_custkey % 6 as h")
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    corners = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x - h, y), (x, y - h), (x + h, y), (x, y + h), (x - h, y))])
    clipped = V.clip_polygons(o.select("o_orderkey", F.array(corners).alias("rings")), (0, 0, 10, 10))
    ring = F.element_at("rings", 1)
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p.x * q.y - q.x * p.y)
    area = F.abs(F.aggregate(sides, F.lit(0.0), lambda acc, v: acc + v)) / 2.0
    return clipped.select("o_orderkey", F.floor(area * 1e6 + 0.5).cast("bigint").alias("area_1e6"))


_SEG = ["l_orderkey", "l_linenumber", "l_partkey % 100 as ax", "l_suppkey % 90 as ay", "(l_partkey*7) % 100 as bx", "(l_orderkey*3) % 90 as bb"]


@query("segment_meets_box", f"""with s as (select {', '.join(_SEG)} from lineitem),
    t as (select *, case when bx <> ax then least((4e1 - ax)/(bx - ax), (6e1 - ax)/(bx - ax)) when ax between 40 and 60 then 0e0 else 2e0 end as ex,
      case when bx <> ax then greatest((4e1 - ax)/(bx - ax), (6e1 - ax)/(bx - ax)) when ax between 40 and 60 then 1e0 else -1e0 end as lx,
      case when bb <> ay then least((3e1 - ay)/(bb - ay), (45e0 - ay)/(bb - ay)) when ay between 30 and 45 then 0e0 else 2e0 end as ey,
      case when bb <> ay then greatest((3e1 - ay)/(bb - ay), (45e0 - ay)/(bb - ay)) when ay between 30 and 45 then 1e0 else -1e0 end as ly from s)
    select l_orderkey, l_linenumber, count(*) filter (where greatest(ex, ey, 0e0) <= least(lx, ly, 1e0)) as n_hits from t group by all""")
def _segment_box(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr(*_SEG)
    hit = geom.segment_meets_box(*[F.col(c).cast("double") for c in ("ax", "ay", "bx", "bb")], F.lit(40.0), F.lit(30.0), F.lit(60.0), F.lit(45.0))
    return s.groupBy("l_orderkey", "l_linenumber").agg(F.count_if(hit).alias("n_hits"))


@query("segment_tiles", f"""with {FEATURES}, f as (select feature_id, (ax + 18e1)/36e1*16384 as ax, (bx + 18e1)/36e1*16384 as bx,
      (1e0 - asinh(tan(radians(ay)))/pi())/2e0*16384 as ay, (1e0 - asinh(tan(radians({_BY})))/pi())/2e0*16384 as bb from feat),
    x as (select *, unnest(range(cast(floor(least(ax, bx)) as bigint), cast(floor(greatest(ax, bx)) as bigint) + 1)) as x from f),
    y as (select *, unnest(range(cast(floor(least(ay, bb)) as bigint), cast(floor(greatest(ay, bb)) as bigint) + 1)) as y from x),
    t as (select *, case when bx <> ax then least((x - ax)/(bx - ax), (x + 1 - ax)/(bx - ax)) else 0e0 end as ex, case when bx <> ax then greatest((x - ax)/(bx - ax), (x + 1 - ax)/(bx - ax)) else 1e0 end as lx,
      case when bb <> ay then least((y - ay)/(bb - ay), (y + 1 - ay)/(bb - ay)) else 0e0 end as ey, case when bb <> ay then greatest((y - ay)/(bb - ay), (y + 1 - ay)/(bb - ay)) else 1e0 end as ly from y)
    select feature_id, x, y from t where greatest(ex, ey, 0e0) <= least(lx, ly, 1e0)""")
def _segment_tiles(spark, sf_dir):
    return V.segment_tiles(V.ring_segments(fx.line_features(spark, sf_dir)), 14).select("feature_id", "x", "y")


_PX = "(({lon} + 18e1)/36e1*8192e0*256e0)"
_PY = "((1e0 - asinh(tan(radians({lat})))/pi())/2e0*8192e0*256e0)"


def _sql_crosses(px, py, qx, qy):
    return (f"case when {py} <> {qy} and least({py}, {qy}) <= r + 5e-1 and r + 5e-1 < greatest({py}, {qy}) "
            f"and c + 5e-1 > {px} + (r + 5e-1 - {py})/({qy} - {py})*({qx} - {px}) then 1 else 0 end")


@query("polygon_fill_pixels", f"""with {FEATURES}, f as (select {_PX.format(lon='ax')} as x0, {_PY.format(lat='ay')} as y0, {_PX.format(lon='bx')} as x1, {_PY.format(lat=_BY)} as y1 from feat),
    w as (select *, unnest(range(cast(floor(least(y0, y1)) as bigint), cast(ceil(greatest(y0, y1)) as bigint))) as r from f),
    p as (select *, unnest(range(cast(floor(least(x0, x1)) as bigint), cast(ceil(greatest(x0, x1)) as bigint))) as c from w),
    i as (select distinct r, c from p where ({_sql_crosses('x1', 'y0', 'x1', 'y1')} + {_sql_crosses('x1', 'y1', 'x0', 'y0')}) % 2 = 1)
    select 13 as zoom, cast(floor(c/256e0) as bigint) as x, cast(floor(r/256e0) as bigint) as y, count(*) as n_pixels from i group by all""")
def _fill_pixels(spark, sf_dir):
    rings = fx.ring_features(spark, sf_dir).select("feature_id", F.transform("rings", geom.close_ring).alias("rings"))
    box = geom.rings_bbox("rings")
    placed = (
        rings.withColumn("zoom", F.lit(13))
        .withColumn("x", F.explode(F.sequence(geo.tile_x(box.x0, F.lit(13)), geo.tile_x(box.x1, F.lit(13)))))
        .withColumn("y", F.explode(F.sequence(geo.tile_y(box.y1, F.lit(13)), geo.tile_y(box.y0, F.lit(13))))))
    return V.fill_counts(placed)


# outlines of lines and rings as every pixel column they cross and, in it, every row between entry and exit
@query("transparent_tiles", f"""with {FEATURES}, f as (select {_PX.format(lon='ax')} as x0, {_PY.format(lat='ay')} as y0, {_PX.format(lon='bx')} as x1, {_PY.format(lat=_BY)} as y1 from feat),
    seg as (select x0 as px, y0 as py, x1 as qx, y1 as qy from f union all select x0, y0, x1, y0 from f union all select x1, y0, x1, y1 from f union all select x1, y1, x0, y0 from f),
    cols as (select *, unnest(range(cast(floor(least(px, qx)) as bigint), cast(floor(greatest(px, qx)) as bigint) + 1)) as c from seg),
    cut as (select *, case when px <> qx then py + greatest(0e0, least(1e0, (c - px)/(qx - px)))*(qy - py) else py end as e,
      case when px <> qx then py + greatest(0e0, least(1e0, (c + 1 - px)/(qx - px)))*(qy - py) else qy end as l from cols),
    line as (select distinct c, unnest(range(cast(floor(least(e, l)) as bigint), cast(floor(greatest(e, l)) as bigint) + 1)) as r from cut),
    w as (select *, unnest(range(cast(floor(least(y0, y1)) as bigint), cast(ceil(greatest(y0, y1)) as bigint))) as r from f),
    p as (select *, unnest(range(cast(floor(least(x0, x1)) as bigint), cast(ceil(greatest(x0, x1)) as bigint))) as c from w),
    fill as (select distinct c, r from p where ({_sql_crosses('x1', 'y0', 'x1', 'y1')} + {_sql_crosses('x1', 'y1', 'x0', 'y0')}) % 2 = 1),
    px as (select c, r, max(k) as k from (select c, r, 1 as k from line union all select c, r, 0 from fill) group by c, r)
    select 13 as zoom, cast(floor(c/256e0) as bigint) as x, cast(floor(r/256e0) as bigint) as y, cast(count(*) as int) as painted,
      cast(count(*) filter (where k = 0) as int) as fill_pixels, 'png' as payload from px group by all""")
def _transparent(spark, sf_dir):
    both = fx.line_features(spark, sf_dir).unionByName(fx.ring_features(spark, sf_dir)).select("feature_id", "kind", "rings")
    tiles = V.feature_tiles(both, 13, 13)
    return tiles.select("zoom", "x", "y", "painted", "fill_pixels", payload_kind("data").alias("payload"))


@query("page_completeness", """select o_custkey as layer, count(distinct o_orderkey) as n_features, max(9 + o_custkey % 3) as total,
    case when count(distinct o_orderkey) >= max(9 + o_custkey % 3) then 'complete' else 'rejected' end as verdict from orders group by o_custkey""")
def _pages(spark, sf_dir):
    return V.page_gate(table(spark, sf_dir, "orders").selectExpr("o_custkey as layer", "o_orderkey as feature_id", "9 + o_custkey % 3 as total"))


_TYPE_NAME = "concat(case event_id % 3 when 0 then 'BDTOPO_V3' when 1 then 'NS_X' else 'NS_Y' end, ':', event_type, case event_id % 2 when 0 then '-a' else '_a' end)"


@query("layer_file_name", f"""with t as (select event_id, event_type, {_TYPE_NAME} as n from events)
    select event_id, 'zone_ign_' || event_type || '_a' || case when n like 'BDTOPO_V3:%' then '' else '_' || substring(sha256(n), 1, 8) end || '.geojson.gz' as name from t""")
def _layer_file(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_TYPE_NAME} as n").select("event_id", V.layer_file_name(F.lit("zone"), "n").alias("name"))


@query("area_request", """with p as (select event_id, 9e5 + event_id as x, 62e5 + user_id as y, 2 + event_id % 9 as w, 43e0 + (event_id % 640)/64e0 as lat, 6e0 + (user_id % 320)/32e0 as lon from events)
    select event_id, x - w*5e2 as x0, y - w*5e2 as y0, x + w*5e2 as x1, y + w*5e2 as y1, 'gps_' || replace(printf('%.5f', lat), '.', '_') || '_' || replace(printf('%.5f', lon), '.', '_') as name,
      'bbox_' || replace(printf('%.5f', lon), '.', '_') || '_' || replace(printf('%.5f', lat), '.', '_') || '_' || replace(printf('%.5f', lon + 125e-3), '.', '_') || '_' || replace(printf('%.5f', lat + 25e-2), '.', '_') as box_name from p""")
def _area(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr(
        "event_id", "9e5 + event_id as x", "62e5 + user_id as y", "2 + event_id % 9 as w", "43e0 + (event_id % 640)/64e0 as lat", "6e0 + (user_id % 320)/32e0 as lon")
    reversed_box = geo.bbox_normalised(geo.bbox(F.col("lon") + 0.125, F.col("lat") + 0.25, "lon", "lat"))
    return p.select("event_id", V.area_around("x", "y", "w").alias("b"), V.area_name_point("lat", "lon").alias("name"),
                    V.area_name_bbox(reversed_box).alias("box_name")).select("event_id", "b.*", "name", "box_name")


_EXPR = "concat(cast(1 + user_id % 20 as string), '-', cast(1 + user_id % 20 + event_id % 4 as string), ',', cast(30 + event_id % 60 as string), case when event_id % 5 = 0 then ',2a' else '' end)"


@query("area_codes", f"""with e as (select event_id, unnest(string_split({_EXPR}, ',')) as item from events),
    r as (select event_id, unnest(case when item like '%-%' then list_transform(range(cast(split_part(item, '-', 1) as bigint), cast(split_part(item, '-', 2) as bigint) + 1), lambda i: cast(i as varchar)) else [item] end) as c from e)
    select event_id, case when length(c) < 2 then lpad(c, 2, '0') else upper(c) end as code from r""")
def _codes(spark, sf_dir):
    return V.area_codes(table(spark, sf_dir, "events").selectExpr("event_id", f"{_EXPR} as expression")).select("event_id", "code")


@query("region_envelope", """select c_nationkey as region, min(c_acctbal) as x0, min(c_custkey)*1e0 as y0, max(c_acctbal + 10) as x1, max(c_custkey)*1e0 + 5 as y1, count(*) as n_departments from customer group by c_nationkey""")
def _region(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), geo.bbox("c_acctbal", "c_custkey", F.col("c_acctbal") + 10.0, F.col("c_custkey") + 5).alias("bbox"))
    return V.region_envelope(d)


@query("map_object_ways", f"""with {FEATURES} select feature_id || '/0' as way_id, cast(4 as bigint) as n_refs, cast(3 as bigint) as n_nodes from feat where bx <> ax and {_BY} <> ay""")
def _objects(spark, sf_dir):
    o = V.to_map_objects(fx.ring_features(spark, sf_dir))
    known = o["way_nodes"].join(o["nodes"], "node_id")
    return known.groupBy("way_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("node_id").alias("n_nodes"))


@query("map_object_nodes", f"""with {FEATURES}, p as (select unnest([ax, bx, bx]) as lon, unnest([ay, ay, {_BY}]) as lat from feat where bx <> ax and {_BY} <> ay),
    i as (select cast(round_even((lon + 18e1)*1e7, 0) as bigint)*2147483648 + cast(round_even((lat + 9e1)*1e7, 0) as bigint) as node_id, lon from p)
    select node_id, cast(floor(min(lon)*1e7 + 5e-1) as bigint) as lon_1e7 from i group by node_id""")
def _nodes(spark, sf_dir):
    nodes = V.to_map_objects(fx.ring_features(spark, sf_dir))["nodes"]
    return nodes.select("node_id", F.floor(F.col("lon") * 1e7 + 0.5).cast("bigint").alias("lon_1e7"))


@query("map_object_tags", f"""with {FEATURES} select feature_id || '/0' as way_id, key, value from feat where bx <> ax and {_BY} <> ay""")
def _object_tags(spark, sf_dir):
    return V.to_map_objects(fx.ring_features(spark, sf_dir))["tags"]
