"""Registered point-cloud queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliefspark.operators import points as P
from reliefspark.operators.blocks import blocks_to_cells
from reliefspark.plans import fixtures as fx
from reliefspark.plans.fixtures import BARE, BARE_RAW, CELLS, FEATURE, FEATURE_RAW, GRID, PTS, SIDE, mm, sql_fill, sql_mm
from reliefspark.plans.registry import query
from reliefspark.session import table


def standing_structures(spark, sf_dir, threshold_m=0.4):
    """Cells where the feature model stands above the bare ground, and by how much."""
    return P.standing_out(P.both_models(fx.points(spark, sf_dir), GRID, SIDE), threshold_m, SIDE)


@query("standing_structures", f"""with {FEATURE}, bare_raw as (select "row", col, min(z) as z from addr where cls in (2, 9, 66) group by all),
    {sql_fill('bare_raw', 'z', 50, 'bare', 'dom_all')}
    select dfm."row" as "row", dfm.col as col, {sql_mm('dfm.z')} as z_feature_mm, {sql_mm('bare.z')} as z_bare_mm,
      {sql_mm('dfm.z - bare.z')} as delta_mm
    from dfm join bare using ("row", col) where dfm.z - bare.z > 0.4e0""")
def _standing_structures(spark, sf_dir):
    return standing_structures(spark, sf_dir).select(
        "row", "col", mm("z_feature").alias("z_feature_mm"), mm("z_bare").alias("z_bare_mm"), mm("delta").alias("delta_mm"))


_WHOLE = 1000
DEFAULT_SIDES = PTS + f""", addr as (select *, cast(floor(-y/1e0) as bigint) as "row", cast(floor(x/1e0) as bigint) as col from pts),
    low as (select "row", col, min(z) as z from addr where cls in (2, 9, 66)
      or cloud_id in (select cloud_id from addr group by cloud_id having count(*) filter (where cls in (2, 9, 66)) < 100) group by all),
    whole as (select ty*{_WHOLE} + r as "row", tx*{_WHOLE} + c as col from (select distinct cast(floor("row"/1e3) as bigint) ty,
      cast(floor(col/1e3) as bigint) tx from low) t, range({_WHOLE}) rr(r), range({_WHOLE}) cc(c)), """ + sql_fill("low", "z", 100, "full_fill", "whole")


@query("dtm_default_sides", f"""with {DEFAULT_SIDES} select "row", count(*) as n_cells, max(col) as last_col, cast(sum({sql_mm('z')}) as bigint) as z_sum_mm from full_fill group by "row\"""")
def _default_sides(spark, sf_dir):
    """A tile of the default size with blocks of the default size: filled to its very edge."""
    cells = P.points_to_dtm(fx.points(spark, sf_dir), P.Grid(res=1.0), P.GROUND_CLASSES)
    return cells.groupBy("row").agg(F.count(F.lit(1)).alias("n_cells"), F.max("col").alias("last_col"), F.sum(mm("z")).alias("z_sum_mm"))


@query("cloud_crs_guard", """select o_orderkey as cloud_id,
      case when epsg <> 2154 then 'wrong crs' when lower(unit) not in ('metre', 'meter', 'm') then 'not metric' else 'ok' end as verdict
    from (select o_orderkey, case o_orderkey % 4 when 0 then 2154 when 1 then 2229 when 2 then 2154 end as epsg,
      case o_orderkey % 5 when 0 then 'metre' when 1 then 'US survey foot' when 2 then 'Meter' when 3 then 'm' end as unit
      from orders)""")
def _crs_guard(spark, sf_dir):
    headers = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as cloud_id", "case o_orderkey % 4 when 0 then 2154 when 1 then 2229 when 2 then 2154 end as epsg",
        "case o_orderkey % 5 when 0 then 'metre' when 1 then 'US survey foot' when 2 then 'Meter' when 3 then 'm' end as unit")
    return headers.select("cloud_id", P.crs_verdict("epsg", "unit", 2154).alias("verdict"))


@query("cloud_clean", f"""with {PTS} select cloud_id, cls, count(*) as n_points, min(z) as z_min, max(z) as z_max
    from pts where cls not in (7, 18) and not withheld group by all""")
def _clean(spark, sf_dir):
    return P.drop_noise(fx.points(spark, sf_dir)).groupBy("cloud_id", "cls").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query("cloud_clip_bounds", f"""with {PTS} select cloud_id, suppkey, x, y, z, cls from pts
    where x >= 50 and x < 350 and y >= -250 and y < -20""")
def _clip(spark, sf_dir):
    return P.clip_bounds(fx.points(spark, sf_dir), (50, -250, 350, -20)).select("cloud_id", "suppkey", "x", "y", "z", "cls")


@query("cloud_window_read", f"""with {PTS} select cls, count(*) as n_points, min(z) as z_min from pts
    where x between 100 and 300.05 and y between -300 and -100.05 group by cls""")
def _window(spark, sf_dir):
    return P.read_window(fx.points(spark, sf_dir), (100, -300, 300.05, -100.05)).groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("z").alias("z_min"))


@query("cloud_useful_classes", f"""with {PTS} select cls, withheld, count(*) as n_points from pts
    where cls in (1, 2, 3, 4, 9, 66) group by all""")
def _useful(spark, sf_dir):
    return P.keep_classes(fx.points(spark, sf_dir), P.GROUND_CLASSES, P.REFERENCE_CLASSES, P.LOW_CLASSES).groupBy(
        "cls", "withheld").agg(F.count(F.lit(1)).alias("n_points"))


@query("cloud_extent_grid", f"""with {PTS}, lim as (select cloud_id, min(x) x0, max(x) x1, min(y) y0, max(y) ym
      from pts where cls not in (7, 18) and not withheld group by cloud_id)
    select cloud_id, x0, y0, x1, cast(floor((x1 - x0)/5e-1) + 1 as int) as nx, cast(floor((ym - y0)/5e-1) + 1 as int) as ny,
      y0 + (cast(floor((ym - y0)/5e-1) + 1 as int))*5e-1 as y1 from lim""")
def _extent(spark, sf_dir):
    return P.extent_grid(P.drop_noise(fx.points(spark, sf_dir)), 0.5)


@query("nominal_grid", """with b as (select o_orderkey, o_custkey*1e0 as x0, o_orderkey*5e-1 as y0, o_custkey + o_totalprice/1e3 as x1, o_orderkey*5e-1 + (o_orderkey % 7)*3e-1 as y1 from orders)
    select o_orderkey, x0, y0, x1, y1, cast(greatest(1, round_even((x1 - x0)/5e-1, 0)) as int) as nx, cast(greatest(1, round_even((y1 - y0)/5e-1, 0)) as int) as ny from b""")
def _nominal_grid(spark, sf_dir):
    """Grids of nominal tile bounds; a tile flatter than a cell still has one row."""
    b = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey*1e0 as x0", "o_orderkey*5e-1 as y0", "o_custkey + o_totalprice/1e3 as x1", "o_orderkey*5e-1 + (o_orderkey % 7)*3e-1 as y1")
    return b.select("o_orderkey", P.nominal_grid(F.struct("x0", "y0", "x1", "y1"), 0.5).alias("g")).select("o_orderkey", "g.*")


@query("cloud_local_cells", f"""with {PTS}, lim as (select cloud_id, min(x) x0, max(x) x1, min(y) y0, max(y) ym from pts group by cloud_id),
    g as (select cloud_id, x0, cast(floor((x1 - x0)/4e0) + 1 as int) as nx, cast(floor((ym - y0)/4e0) + 1 as int) as ny,
      y0 + cast(floor((ym - y0)/4e0) + 1 as int)*4e0 as y1 from lim)
    select cloud_id, greatest(0, least(cast(trunc((y1 - y)/4e0) as int), ny - 1)) as "row",
      greatest(0, least(cast(trunc((x - x0)/4e0) as int), nx - 1)) as col, count(*) as n_points
    from pts join g using (cloud_id) group by all""")
def _local_cells(spark, sf_dir):
    cloud = fx.points(spark, sf_dir)
    grid = P.extent_grid(cloud, 4.0)
    fields = F.struct("x0", "y1", "nx", "ny")
    return (
        cloud.join(grid.select("cloud_id", fields.alias("g")), "cloud_id")
        .select("cloud_id", P.cell_in_grid("x", "y", F.col("g"), 4.0).alias("a"))
        .groupBy("cloud_id", F.col("a.row").alias("row"), F.col("a.col").alias("col"))
        .agg(F.count(F.lit(1)).alias("n_points"))
    )


@query("cell_minimum_height", f"""with {CELLS} select "row", col, {sql_mm('min(case when cls = 2 then z end)')} as ref_mm,
      {sql_mm('min(case when cls in (2, 9, 66) then z end)')} as ground_mm, {sql_mm('min(case when cls in (1, 3, 4) then z end)')} as low_mm
    from useful where cls in (1, 2, 3, 4, 9, 66) group by all""")
def _bin_min(spark, sf_dir):
    cells = P.bin_min(P.drop_noise(fx.points(spark, sf_dir)), GRID,
                      {"z_ref": P.REFERENCE_CLASSES, "z_ground": P.GROUND_CLASSES, "z_low": P.LOW_CLASSES})
    return cells.select("row", "col", mm("z_ref").alias("ref_mm"), mm("z_ground").alias("ground_mm"), mm("z_low").alias("low_mm"))


@query("ground_or_all_points", """with """ + PTS + """, c as (select cast(suppkey as string) as cloud_id, z, cls from pts),
    poor as (select cloud_id from c group by cloud_id having count(*) filter (where cls = 2) < 180)
    select cloud_id, count(*) as n_points, min(z) as z_min from c
    where cls = 2 or cloud_id in (select cloud_id from poor) group by cloud_id""")
def _ground_or_all(spark, sf_dir):
    cloud = fx.points(spark, sf_dir).withColumn("cloud_id", F.col("suppkey").cast("string"))
    return P.ground_or_all(cloud, (2,), minimum=180).groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("z").alias("z_min"))


@query("hole_fill", f"""with {CELLS}, src as (select "row", col, min(z) as z from useful where cls = 2 group by all),
    {sql_fill('src', 'z', 7, 'filled')} select "row", col, {sql_mm('z')} as z_mm from filled""")
def _fill(spark, sf_dir):
    cloud = P.drop_noise(fx.points(spark, sf_dir))
    raw = P.bin_min(cloud, GRID, {"z": (2,)})
    return P.fill_cells(raw, "z", P.tile_blocks(cloud, GRID, SIDE), 7, SIDE).select("row", "col", mm("z").alias("z_mm"))


@query("cloud_to_dtm", f"""with {BARE} select "row", col, {sql_mm('z')} as z_mm from bare""")
def _dtm(spark, sf_dir):
    return P.points_to_dtm(fx.points(spark, sf_dir), GRID, P.GROUND_CLASSES, 100.0, SIDE).select("row", "col", mm("z").alias("z_mm"))


@query("height_band_points", f"""with {BARE} select "row", col, cls, {sql_mm('p.z')} as z_mm, {sql_mm('p.z - bare.z')} as h_mm
    from useful p join bare using ("row", col) where cls in (1, 3, 4) and p.z - bare.z >= 0.4e0 and p.z - bare.z <= 2.5e0""")
def _band(spark, sf_dir):
    cloud = fx.points(spark, sf_dir)
    ground = P.dtm_blocks(cloud, GRID, P.GROUND_CLASSES, 100.0, SIDE)
    measured = P.height_above_ground(P.keep_classes(P.drop_noise(cloud), P.LOW_CLASSES), ground, GRID, SIDE)
    return P.height_band(measured).select("row", "col", "cls", mm("z").alias("z_mm"), mm("h").alias("h_mm"))


_AREAS = PTS + """, a as (select *, cast(suppkey % 3 as string) as area, cast(floor(-y/2e0) as bigint) as "row", cast(floor(x/2e0) as bigint) as col,
    cast(floor(-y/5e0) as bigint) r5, cast(floor(x/5e0) as bigint) c5 from pts)"""


def _by_area(spark, sf_dir):
    """Three surveys of the same ground, each an area of its own."""
    return fx.points(spark, sf_dir).withColumn("area", (F.col("suppkey") % 3).cast("string"))


@query("height_band_by_area", f"""with {_AREAS}, g as (select area, "row", col, min(z) as z from a where cls in (2, 9, 66) group by all)
    select area, "row", col, cls, {sql_mm('a.z')} as z_mm, {sql_mm('a.z - g.z')} as h_mm from a join g using (area, "row", col)
    where cls in (1, 3, 4) and not withheld and a.z - g.z >= 0.4e0 and a.z - g.z <= 2.5e0""")
def _band_by_area(spark, sf_dir):
    """Every point is measured against the ground of its own survey, also where all surveys know the cell."""
    cloud = _by_area(spark, sf_dir)
    ground = P.dtm_blocks(cloud, GRID, P.GROUND_CLASSES, 0.0, SIDE, minimum=None, area="area")
    measured = P.height_above_ground(P.keep_classes(P.drop_noise(cloud), P.LOW_CLASSES), ground, GRID, SIDE, area="area")
    return P.height_band(measured).select("area", "row", "col", "cls", mm("z").alias("z_mm"), mm("h").alias("h_mm"))


@query("canopy_by_area", f"""with {_AREAS}, m as (select area, r5, c5, min(z) as z0 from a group by all)
    select area, cls, count(*) as n_kept, {sql_mm('max(z)')} as z_max_mm from a join m using (area, r5, c5) where z <= z0 + 3.5e0 group by area, cls""")
def _canopy_by_area(spark, sf_dir):
    kept = P.canopy_prefilter(_by_area(spark, sf_dir), P.Grid(res=5.0), area="area")
    return kept.groupBy("area", "cls").agg(F.count(F.lit(1)).alias("n_kept"), F.max("z").alias("z")).select("area", "cls", "n_kept", mm("z").alias("z_max_mm"))


@query("feature_reinjection", f"""with {FEATURE_RAW} select "row", col, {sql_mm('z_low')} as low_mm from low""")
def _reinjection(spark, sf_dir):
    cells = blocks_to_cells(P.feature_blocks(fx.points(spark, sf_dir), GRID, side=SIDE), ["z_low"], SIDE)
    return cells.filter(F.col("z_low").isNotNull()).select("row", "col", mm("z_low").alias("low_mm"))


@query("cloud_to_dfm", f"""with {FEATURE} select "row", col, {sql_mm('z')} as z_mm from dfm""")
def _dfm(spark, sf_dir):
    return P.points_to_dfm(fx.points(spark, sf_dir), GRID, side=SIDE).select("row", "col", mm("z").alias("z_mm"))


@query("cloud_slice", f"""with {FEATURE_RAW} select u."row" as "row", u.col as col, {sql_mm('min(u.z)')} as z_mm
    from useful u join ref using ("row", col)
    where u.cls in (1, 3, 4) and u.z - ref.z >= 0.4e0 and u.z - ref.z <= 2.5e0 group by all""")
def _slice(spark, sf_dir):
    return P.points_to_dfm(fx.points(spark, sf_dir), GRID, side=SIDE, classes_ground=()).select("row", "col", mm("z").alias("z_mm"))


@query("canopy_prefilter", f"""with {PTS}, a as (select *, cast(floor(-y/5e0) as bigint) r5, cast(floor(x/5e0) as bigint) c5 from pts),
    m as (select r5, c5, min(z) as z0 from a group by all)
    select cls, count(*) as n_kept, {sql_mm('max(z)')} as z_max_mm from a join m using (r5, c5) where z <= z0 + 3.5e0 group by cls""")
def _canopy(spark, sf_dir):
    kept = P.canopy_prefilter(fx.points(spark, sf_dir), P.Grid(res=5.0))
    return kept.groupBy("cls").agg(F.count(F.lit(1)).alias("n_kept"), F.max("z").alias("z")).select(
        "cls", "n_kept", mm("z").alias("z_max_mm"))


@query("class_histogram", f"""with {PTS} select cloud_id, cls, count(*) as n_points, min(z) as z_min, max(z) as z_max,
    count(*)/4e4 as density from pts group by all""")
def _histogram(spark, sf_dir):
    return P.class_histogram(fx.points(spark, sf_dir), 40000.0)


@query("text_grid_cells", """with src as (select cast(o_custkey % 50 as string) as cloud_id, 9e2 + (o_orderkey % 20)*5e-1 as x,
      (o_custkey % 37)*5e-1 as y, o_totalprice as z, o_orderkey as line_no from orders),
    xs as (select distinct cloud_id, x from src),
    gaps as (select cloud_id, x - lag(x) over (partition by cloud_id order by x) as gap from xs),
    res as (select cloud_id, min(gap) as res from gaps group by cloud_id),
    lim as (select cloud_id, min(x) as x_min, max(y) as y_max from src group by cloud_id)
    select cloud_id, cast(round_even((y_max - y)/res, 0) as bigint) as "row", cast(round_even((x - x_min)/res, 0) as bigint) as col,
      max_by(z, line_no) as z, max(res) as res, max(x_min - res/2) as "left", max(y_max + res/2) as top
    from src join res using (cloud_id) join lim using (cloud_id) group by all""")
def _text_grid(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey % 50 as string) as cloud_id", "9e2 + (o_orderkey % 20)*5e-1 as x", "(o_custkey % 37)*5e-1 as y",
        "o_totalprice as z", "o_orderkey as line_no")
    return P.grid_from_text(lines)


@query("model_difference_mask", f"""with {FEATURE}, {BARE_RAW}, {sql_fill('bare_raw', 'z', 50, 'bare', 'dom_all')}
    select cast(floor(dfm."row"/1e1) as bigint) as band, count(*) as n_cells,
      count(*) filter (where dfm.z - bare.z > 0.4e0) as n_high, count(*) filter (where dfm.z - bare.z < 0) as n_below
    from dfm join bare using ("row", col) group by all""")
def _difference(spark, sf_dir):
    cloud = fx.points(spark, sf_dir)
    delta = P.block_difference(P.dfm_blocks(cloud, GRID, SIDE), P.dtm_blocks(cloud, GRID, P.GROUND_CLASSES, 100.0, SIDE), -1e9, SIDE)
    return delta.groupBy(F.floor(F.col("row") / 10.0).cast("bigint").alias("band")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("delta") > 0.4).alias("n_high"),
        F.count_if(F.col("delta") < 0).alias("n_below"))


_SETTINGS = [
    "l_orderkey", "l_linenumber", "case when l_linestatus = 'F' then 'csf' else 'classes' end as ground",
    "case l_orderkey % 3 when 0 then 0.4e0 when 1 then 0.3e0 else 1.2e0 end as hmin",
    "case l_partkey % 3 when 0 then 2.5e0 when 1 then 3e0 else 12.5e0 end as hmax",
    "case l_suppkey % 3 when 0 then 5e-1 when 1 then 8e-1 else 3.4e0 end as threshold",
    "case l_linenumber % 2 when 0 then 5e-1 else 1e0 end as resolution", "cast(1 + l_linenumber % 4 as int) as rigidness",
    "cast(l_suppkey % 2 as int) as variant",
]


@query("variant_tag", f"""with s as (select {', '.join(_SETTINGS)} from lineitem),
    t as (select *, case when variant = 0 then '' else '_c1-3-34' end as c from s)
    select l_orderkey, l_linenumber, case when ground = 'csf' then
        'laz_csf' || case when threshold <> 5e-1 then '_t' || lpad(cast(cast(round_even(threshold*1e1, 0) as int) as string), 2, '0') else '' end
        || case when resolution <> 5e-1 then '_r' || lpad(cast(cast(round_even(resolution*1e1, 0) as int) as string), 2, '0') else '' end
        || case when rigidness <> 1 then '_g' || cast(rigidness as string) else '' end
      else 'laz_dfm' || case when hmin <> 0.4e0 or hmax <> 2.5e0 then '_h' || lpad(cast(cast(round_even(hmin*1e1, 0) as int) as string), 2, '0')
        || '-' || case when hmax >= 10 then cast(cast(round_even(hmax*1e1, 0) as int) as string)[1:2] else lpad(cast(cast(round_even(hmax*1e1, 0) as int) as string), 2, '0') end else '' end || c end as tag
    from t""")
def _variant_tag(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr(*_SETTINGS)
    usual = F.array(*[F.lit(c) for c in P.DEFAULT_CLASSES])
    classes = F.when(F.col("variant") == 0, usual).otherwise(F.array(F.lit(34), F.lit(1), F.lit(3)))
    return s.select("l_orderkey", "l_linenumber",
                    P.variant_tag("ground", "hmin", "hmax", classes, "threshold", "resolution", "rigidness").alias("tag"))


@query("cloud_setting_problems", f"""with s as (select {', '.join(_SETTINGS)} from lineitem)
    select coalesce(case when not (round_even(threshold, 1) between 0.1e0 and 3e0) then 'threshold'
      when not (round_even(resolution, 1) between 0.1e0 and 3e0) then 'resolution' when rigidness not in (1, 2, 3) then 'rigidness'
      when round_even(hmin*2e0, 1) >= round_even(hmax, 1) then 'height band' end, 'none') as problem, count(*) as n
    from s group by all""")
def _setting_problems(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr(*_SETTINGS)
    problem = P.settings_problem(F.col("hmin") * 2.0, "hmax", "threshold", "resolution", "rigidness")
    return s.groupBy(F.coalesce(problem, F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("class_split", """with c as (select o_orderkey, list_distinct([1 + o_orderkey % 5, 2, 9 - o_custkey % 3, case when o_orderkey % 2 = 0 then 66 else 5 end]) as cs from orders)
    select o_orderkey, list_aggregate(list_sort(list_filter(cs, lambda x: x in (2, 9, 66))), 'string_agg', '-') as base,
      coalesce(list_aggregate(list_sort(list_filter(cs, lambda x: x not in (2, 9, 66))), 'string_agg', '-'), '') as reinjected from c""")
def _class_split(spark, sf_dir):
    classes = F.array(
        (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(2), (F.lit(9) - F.col("o_custkey") % 3).cast("int"),
        F.when(F.col("o_orderkey") % 2 == 0, 66).otherwise(5))
    parts = table(spark, sf_dir, "orders").select("o_orderkey", P.split_classes(classes).alias("s"))

    def text(column):
        return F.concat_ws("-", F.col(column).cast("array<string>"))

    return parts.select("o_orderkey", text("s.base").alias("base"), text("s.reinjected").alias("reinjected"))


@query("archive_largest_cloud", """select o_custkey as archive, max(struct_pack(s := o_totalprice, m := o_orderkey)).m as member,
      max(o_totalprice) as size, count(*) - 1 as n_left_out from orders group by o_custkey""")
def _largest(spark, sf_dir):
    return P.largest_member(table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as archive", "o_orderkey as member", "o_totalprice as size"))
