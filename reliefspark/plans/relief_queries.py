"""Registered relief queries: gradients, smoothing, horizons, stretches, composites, warps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from reliefspark.functions import arrays, geo, shade
from reliefspark.functions.arrays import LambertToPixels
from reliefspark.operators import focal, warp
from reliefspark.operators import points as P
from reliefspark.operators.blocks import blocks_to_cells, cells_to_blocks
from reliefspark.plans import fixtures as fx
from reliefspark.plans.fixtures import BARE, CELLS, GRID, PTS, SIDE, mm, sql_mm
from reliefspark.plans.registry import query
from reliefspark.session import table

RES = GRID.res


def bare(spark, sf_dir):
    """Filled bare-earth model as blocks."""
    return P.dtm_blocks(fx.points(spark, sf_dir), GRID, P.GROUND_CLASSES, 100.0, SIDE)


def holed(spark, sf_dir):
    """Ground minimum with its holes, as blocks."""
    cells = P.bin_min(P.drop_noise(fx.points(spark, sf_dir)), GRID, {"z": P.GROUND_CLASSES})
    return cells_to_blocks(cells, ["z"], SIDE)


def cells_of(blocks, *bands):
    return blocks_to_cells(blocks, bands, SIDE)


# -- SQL twins ------------------------------------------------------------------------------------

# neighbours by lag and lead over the full rectangle: every cell has its eight places there
_N = {n: f"coalesce({n}, z)" for n in "abcdfghi"}
GRAD = BARE + f""", rect as (select r as "row", c as col, z from (select unnest(range(lo, hi + 1)) as r from (select min("row") as lo, max("row") as hi from bare)),
      (select unnest(range(lo, hi + 1)) as c from (select min(col) as lo, max(col) as hi from bare)) left join bare on bare."row" = r and bare.col = c),
    upright as (select "row", col, z, lag(z) over w as b, lead(z) over w as h from rect window w as (partition by col order by "row")),
    around as (select *, lag(z) over w as d, lead(z) over w as f, lag(b) over w as a, lead(b) over w as c, lag(h) over w as g, lead(h) over w as i
      from upright window w as (partition by "row" order by col)),
    grad as (select "row", col,
      ((({_N['c']} + 2e0*{_N['f']}) + {_N['i']}) - (({_N['a']} + 2e0*{_N['d']}) + {_N['g']}))/{8 * RES:.1f}e0 as p,
      ((({_N['g']} + 2e0*{_N['h']}) + {_N['i']}) - (({_N['a']} + 2e0*{_N['b']}) + {_N['c']}))/{8 * RES:.1f}e0 as q
      from around where z is not null)"""


def sql_code(unit: str) -> str:
    return f"coalesce(cast(floor(greatest(0e0, least(1e0, {unit}))*254e0 + 1e0) as int), 0)"


def sql_slope_code() -> str:
    return "coalesce(cast(floor(degrees(atan(sqrt(p*p + q*q)))*254e0/90e0 + 1e0) as int), 0)"


def sql_hillshade(azimuth: float, altitude: float, z_factor: float = 1.0) -> str:
    alt, az = math.radians(altitude), math.radians(azimuth)
    p, q = f"(p*{z_factor!r}e0)", f"(q*{z_factor!r}e0)"
    return (f"greatest(0e0, ({_e(math.sin(alt))} + {_e(math.cos(alt))}*({_e(math.cos(az))}*{q} - {_e(math.sin(az))}*{p}))"
            f"/sqrt({p}*{p} + {q}*{q} + 1e0))")


def _e(value: float) -> str:
    """A double literal in SQL."""
    return f"cast('{value!r}' as double)"


def sql_multi(altitude: float) -> str:
    total, weight = "0e0", "0e0"
    for azimuth in shade.MULTI_AZIMUTHS:
        s, c = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
        across = f"(q*{_e(s)} + p*{_e(c)})"
        w = f"(case when p*p + q*q > 0 then {across}*{across}/(p*p + q*q) else {_e(s * s)} end)"
        total, weight = f"({total} + {w}*{sql_hillshade(azimuth, altitude)})", f"({weight} + {w})"
    return f"{total}/{weight}"


def _mirrored(place: str, low: str, size: str) -> str:
    """A place along an axis of ``size`` cells from ``low`` on, mirrored at both ends."""
    turn = f"((({place} - {low}) % (2*{size}) + 2*{size}) % (2*{size}))"
    return f"{low} + case when {turn} < {size} then {turn} else 2*{size} - 1 - {turn} end"


def sql_gaussian(source: str, sigma: float, name: str, domain: str = "dom", square: bool = False) -> str:
    """CTEs ``name(row, col, g)``: separable mean over known cells, the domain mirrored at its edges."""
    kernel = focal.gaussian_weights(sigma)
    reach = len(kernel) // 2
    values = ", ".join(f"({i - reach}, {_e(float(w))})" for i, w in enumerate(kernel))
    z = "b.z*b.z" if square else "b.z"
    return f"""{name}_k(d, w) as (values {values}),
    {name}_e as (select min("row") as r0, max("row") - min("row") + 1 as nr, min(col) as c0, max(col) - min(col) + 1 as nc from {domain}),
    {name}_x as (select a."row", a.col, coalesce(sum(k.w*{z}), 0e0) as v, coalesce(sum(case when b.z is not null then k.w end), 0e0) as w
      from {domain} a cross join {name}_k k cross join {name}_e e left join {source} b on b."row" = a."row" and b.col = {_mirrored('a.col + k.d', 'e.c0', 'e.nc')} group by all),
    {name} as (select a."row", a.col, sum(k.w*b.v)/nullif(sum(k.w*b.w), 0) as g
      from {domain} a cross join {name}_k k cross join {name}_e e join {name}_x b on b.col = a.col and b."row" = {_mirrored('a."row" + k.d', 'e.r0', 'e.nr')} group by all)"""


HOLED = CELLS + """, src as (select "row", col, min(z) as z from useful where cls in (2, 9, 66) group by all)"""
_LRM_SIGMA = 15.0
LRM = (
    HOLED + """, med as (select quantile_cont(floor(z*1e2 + 5e-1), 0.5)/1e2 as m from src),
    based as (select d."row", d.col, coalesce(s.z, (select m from med)) as z from dom d left join src s using ("row", col)), """
    + sql_gaussian("based", _LRM_SIGMA, "g0") + """,
    lrm as (select s."row", s.col, s.z - g0.g as v from src s join g0 using ("row", col))"""
)

_DIST, _DIRS = 20, 16


def sql_horizons(sampling: str = "bilinear", suffix: str = "", source: str = "bare") -> str:
    rows = [(k, step, dr, dc, w) for k, step, cells in focal.ray_samples(_DIST, _DIRS, sampling) for dr, dc, w in cells]
    need = {}
    for k, step, *_ in rows:
        need[k, step] = need.get((k, step), 0) + 1
    values = ", ".join(f"({k}, {s}, {dr}, {dc}, {_e(w)}, {need[k, s]})" for k, s, dr, dc, w in rows)
    return f"""ray{suffix}(k, s, dr, dc, w, need) as (values {values}),
    smp{suffix} as (select a."row", a.col, k, s, (sum(w*b.z) - any_value(a.z))/(s*{RES}e0) as t
      from {source} a cross join ray{suffix} r join {source} b on b."row" = a."row" + dr and b.col = a.col + dc
      group by a."row", a.col, k, s having count(*) = any_value(need)),
    dirs{suffix} as (select a."row", a.col, kk.k, coalesce(max(t), 0e0) as hi, coalesce(min(t), 0e0) as lo
      from {source} a cross join range({_DIRS}) kk(k) left join smp{suffix} s on s."row" = a."row" and s.col = a.col and s.k = kk.k group by all),
    hor{suffix} as (select "row", col, avg(1e0/(1e0 + greatest(hi, 0e0)*greatest(hi, 0e0))) as svf_flux,
      avg(1e0 - greatest(hi, 0e0)/sqrt(1e0 + greatest(hi, 0e0)*greatest(hi, 0e0))) as svf_rvt,
      avg(5e-1 - atan(hi)/pi()) as opos, avg(5e-1 - atan(lo)/pi()) as oneg from dirs{suffix} group by all)"""


def sql_stretch(source: str, value: str, low: float, high: float, digits: int, name: str, exponent: str = "{u}") -> str:
    """CTE ``name(row, col, unit)``."""
    scale = f"1e{digits}"
    step = f"floor({value}*{scale} + 5e-1)"
    unit = f"greatest(0e0, least(1e0, ({value} - p_low)/(p_high - p_low)))"
    return f"""{name}_b as (select quantile_cont({step}, {low})/{scale} as p_low, quantile_cont({step}, {high})/{scale} as p_high from {source}),
    {name} as (select "row", col, {exponent.format(u=unit)} as unit from {source}, {name}_b where {value} is not null)"""


# -- masks, gradients -----------------------------------------------------------------------------

_RAW_Z = ("case o_orderkey % 7 when 0 then -9999e0 when 1 then 50000e0 when 2 then cast('NaN' as double) when 3 then 0e0 "
          "when 4 then -9000e0 else o_totalprice/1e3 end")


@query("nodata_mask", f"""with z as (select o_orderkey, {_RAW_Z} as z from orders)
    select o_orderkey, case when not isnan(z) and abs(z) <= 9000 then z end as z_open,
      case when not isnan(z) and abs(z) <= 9000 and z <> 0 then z end as z_zero from z""")
def _nodata(spark, sf_dir):
    z = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_RAW_Z} as z")
    return z.select("o_orderkey", shade.clean_height("z").alias("z_open"), shade.clean_height("z", 0.0).alias("z_zero"))


@query("horn_slope", f"""with {GRAD} select "row", col, cast(floor(degrees(atan(sqrt(p*p + q*q)))*1e4 + 5e-1) as bigint) as slope_1e4,
      {sql_slope_code()} as code from grad""")
def _slope(spark, sf_dir):
    g = cells_of(focal.horn_gradient(bare(spark, sf_dir), RES, side=SIDE), "p", "q")
    degrees = shade.slope_degrees("p", "q")
    return g.select("row", "col", F.floor(degrees * 1e4 + 0.5).cast("bigint").alias("slope_1e4"), shade.slope_code("p", "q").alias("code"))


@query("hillshade", f"""with {GRAD} select "row", col, {sql_code(sql_hillshade(315.0, 25.0))} as code_315,
      {sql_code(sql_hillshade(45.0, 45.0, 2.0))} as code_045_z2 from grad""")
def _hillshade(spark, sf_dir):
    g = cells_of(focal.horn_gradient(bare(spark, sf_dir), RES, side=SIDE), "p", "q")
    return g.select("row", "col", shade.code_unit(shade.hillshade("p", "q", 315.0, 25.0)).alias("code_315"),
                    shade.code_unit(shade.hillshade("p", "q", 45.0, 45.0, 2.0)).alias("code_045_z2"))


@query("hillshade_multidirectional", f"""with {GRAD} select "row", col, {sql_code(sql_multi(25.0))} as code from grad""")
def _multi(spark, sf_dir):
    g = cells_of(focal.horn_gradient(bare(spark, sf_dir), RES, side=SIDE), "p", "q")
    return g.select("row", "col", shade.code_unit(shade.hillshade_multi("p", "q", 25.0)).alias("code"))


@query("shadings_one_pass", f"""with {GRAD} select "row", col, {sql_code(sql_hillshade(315.0, 30.0))} as h315, {sql_code(sql_hillshade(135.0, 30.0))} as h135,
      {sql_code(sql_multi(30.0))} as multi, {sql_slope_code()} as slope from grad""")
def _one_pass(spark, sf_dir):
    g = cells_of(focal.horn_gradient(bare(spark, sf_dir), RES, side=SIDE), "p", "q")
    wanted = {"h315": {"type": "315"}, "h135": {"type": "135"}, "multi": {"type": "multi"}, "slope": {"type": "slope"}}
    return g.select("row", "col", *focal.shade_columns(wanted, altitude=30.0))


# -- smoothing ------------------------------------------------------------------------------------

@query("gaussian_smooth", f"""with {HOLED}, {sql_gaussian('src', 2.0, 'g0')} select s."row" as "row", s.col as col, {sql_mm('g0.g')} as g_mm
    from src s join g0 using ("row", col)""")
def _gaussian(spark, sf_dir):
    return cells_of(focal.gaussian(holed(spark, sf_dir), [2.0], side=SIDE), "g0").select("row", "col", mm("g0").alias("g_mm"))


@query("local_relief", f"""with {LRM} select "row", col, {sql_mm('v')} as lrm_mm from lrm""")
def _lrm(spark, sf_dir):
    return cells_of(focal.local_relief(holed(spark, sf_dir), _LRM_SIGMA, side=SIDE), "lrm").select("row", "col", mm("lrm").alias("lrm_mm"))


_MSTP = [(name, [m / RES for m in limits]) for name, limits in shade.MSTP_BANDS.items()]


def _mstp_parts() -> tuple[str, dict[str, str], str]:
    """(CTEs, the deviation of each band as an expression, the joins to ``bare``)."""
    ctes, columns, joins = [], {}, []
    for name, (low, high) in _MSTP:
        for tag, sigma in (("a", low), ("b", high)):
            ctes += [sql_gaussian("bare", sigma, f"{name}_{tag}", "dom_all"), sql_gaussian("bare", sigma, f"{name}_{tag}s", "dom_all", square=True)]
            joins += [f'join {name}_{tag} using ("row", col) join {name}_{tag}s using ("row", col)']

        def dev(tag, name=name):
            m, m2 = f"{name}_{tag}.g", f"{name}_{tag}s.g"
            return f"((bare.z - {m})/(sqrt(greatest({m2} - {m}*{m}, 0e0)) + 1e-3))"

        best = f"case when abs({dev('b')}) > abs({dev('a')}) then {dev('b')} else {dev('a')} end"
        columns[name] = best
    return ", ".join(ctes), columns, " ".join(joins)


_MSTP_CTES, _MSTP_DEV, _MSTP_JOINS = _mstp_parts()
_MSTP_HEAD = f"with {BARE}, {_MSTP_CTES} select bare.\"row\" as \"row\", bare.col as col, "


@query("multiscale_deviation_rgb", _MSTP_HEAD + ", ".join(f"{sql_code(f'(({_MSTP_DEV[b]}) + 2.5e0)/5e0')} as {c}" for c, b in (("r", "broad"), ("g", "meso"), ("b", "local"))) + f" from bare {_MSTP_JOINS}")
def _mstp_rgb(spark, sf_dir):
    """One byte per scale: broad in red, middle in green, local in blue."""
    dev = cells_of(focal.multiscale_deviation(bare(spark, sf_dir), RES, side=SIDE), "local", "meso", "broad")
    return dev.select("row", "col", *[shade.deviation_code(F.col(b)).alias(c) for c, b in (("r", "broad"), ("g", "meso"), ("b", "local"))])


@query("multiscale_deviation", _MSTP_HEAD + ", ".join(f"cast(floor(({v})*1e2 + 5e-1) as bigint) as {k}" for k, v in _MSTP_DEV.items()) + f" from bare {_MSTP_JOINS}")
def _mstp(spark, sf_dir):
    dev = cells_of(focal.multiscale_deviation(bare(spark, sf_dir), RES, side=SIDE), "local", "meso", "broad")
    return dev.select("row", "col", *[F.floor(F.col(b) * 1e2 + 0.5).cast("bigint").alias(b) for b in ("local", "meso", "broad")])


# -- horizons -------------------------------------------------------------------------------------

_HOR = ("svf_flux", "svf_rvt", "opos", "oneg")


def _hor_columns():
    return [F.floor(F.col(b) * 1e5 + 0.5).cast("bigint").alias(b) for b in _HOR]


_SQL_HOR_COLUMNS = ", ".join(f"cast(floor({b}*1e5 + 5e-1) as bigint) as {b}" for b in _HOR)


@query("sky_view_and_openness", f"""with {BARE}, {sql_horizons()} select "row", col, {_SQL_HOR_COLUMNS} from hor""")
def _horizons(spark, sf_dir):
    return cells_of(focal.horizons(bare(spark, sf_dir), RES, _DIST, _DIRS, side=SIDE), *_HOR).select("row", "col", *_hor_columns())


@query("sky_view_fast_sampling", f"""with {BARE}, {sql_horizons('nearest')} select "row", col, {_SQL_HOR_COLUMNS} from hor""")
def _horizons_fast(spark, sf_dir):
    return cells_of(
        focal.horizons(bare(spark, sf_dir), RES, _DIST, _DIRS, sampling="nearest", side=SIDE), *_HOR).select("row", "col", *_hor_columns())


@query("fast_sampling_difference", f"""with {BARE}, {sql_horizons()}, {sql_horizons('nearest', '_n')},
    d as (select floor(abs(hor.opos - hor_n.opos)*1e4 + 5e-1) as step from hor join hor_n using ("row", col))
    select count(*) as n_cells, cast(floor(avg(step)*1e2 + 5e-1) as bigint) as mean_1e6, cast(floor(quantile_cont(step, 0.95)*1e2 + 5e-1) as bigint) as p95_1e6 from d""")
def _sampling_difference(spark, sf_dir):
    from reliefspark.operators.quality import raster_difference

    ground = bare(spark, sf_dir)
    exact = cells_of(focal.horizons(ground, RES, _DIST, _DIRS, side=SIDE), "opos")
    fast = cells_of(focal.horizons(ground, RES, _DIST, _DIRS, sampling="nearest", side=SIDE), "opos")
    d = raster_difference(exact, fast, "opos", digits=4)
    return d.select("n_cells", F.floor(F.col("mean_abs") * 1e6 + 0.5).cast("bigint").alias("mean_1e6"),
                    F.floor(F.col("p95_abs") * 1e6 + 0.5).cast("bigint").alias("p95_1e6"))


# -- stretches and composites ---------------------------------------------------------------------

@query("percentile_bounds", f"""with {LRM}, s as (select floor(v*1e3 + 5e-1) as step from lrm)
    select cast(floor(quantile_cont(step, 0.05)*1e1 + 5e-1) as bigint) as p05_1e4, cast(floor(quantile_cont(step, 0.95)*1e1 + 5e-1) as bigint) as p95_1e4 from s""")
def _bounds(spark, sf_dir):
    lrm = cells_of(focal.local_relief(holed(spark, sf_dir), _LRM_SIGMA, side=SIDE), "lrm")
    b = focal.percentile_bounds(lrm, "lrm", 0.05, 0.95)
    return b.select(F.floor(F.col("p_low") * 1e4 + 0.5).cast("bigint").alias("p05_1e4"), F.floor(F.col("p_high") * 1e4 + 0.5).cast("bigint").alias("p95_1e4"))


@query("stretch_by_area", f"""with {CELLS}, low as (select cast(cast(cloud_id as int) % 2 as varchar) as area, "row", col, min(z) as z from useful where cls in (2, 9, 66) group by all),
    b as (select area, quantile_cont(floor(z*1e3 + 5e-1), 0.05)/1e3 as p_low, quantile_cont(floor(z*1e3 + 5e-1), 0.95)/1e3 as p_high from low group by area)
    select area, "row", col, {sql_code('(z - p_low)/(p_high - p_low)')} as code from low join b using (area)""")
def _by_area(spark, sf_dir):
    cloud = P.drop_noise(fx.points(spark, sf_dir)).withColumn("area", (F.col("cloud_id").cast("int") % 2).cast("string"))
    low = P.bin_min(cloud, GRID, {"z": P.GROUND_CLASSES}, area="area")
    return focal.stretch_codes(low, "z", 0.05, 0.95).select(F.col("raster_id").alias("area"), "row", "col", "code")


@query("sky_view_coded", f"""with {BARE}, {sql_horizons()}, {sql_stretch('hor', 'svf_flux', 0.02, 0.98, 4, 'st', 'pow({u}, 2e0)')}
    select "row", col, {sql_code('unit')} as code from st""")
def _svf_code(spark, sf_dir):
    svf = cells_of(focal.horizons(bare(spark, sf_dir), RES, _DIST, _DIRS, side=SIDE), "svf_flux")
    return focal.stretch_codes(svf, "svf_flux", 0.02, 0.98, 2.0, digits=4).select("row", "col", "code")


@query("negative_openness_coded", f"""with {BARE}, {sql_horizons()}, {sql_stretch('hor', 'oneg', 0.02, 0.98, 4, 'st', '1e0 - pow(1e0 - {u}, 2e0)')}
    select "row", col, {sql_code('unit')} as code from st""")
def _oneg_code(spark, sf_dir):
    oneg = cells_of(focal.horizons(bare(spark, sf_dir), RES, _DIST, _DIRS, side=SIDE), "oneg")
    return focal.stretch_codes(oneg, "oneg", 0.02, 0.98, 2.0, mirror=True, digits=4).select("row", "col", "code")


_GREY = sql_gaussian("bare", _LRM_SIGMA, "gl", "dom_all")
_BARE_LRM = f"""{_GREY}, blrm as (select bare."row", bare.col, bare.z - gl.g as v from bare join gl using ("row", col))"""


@query("rrim_composite", f"""with {GRAD}, {_BARE_LRM}, {sql_stretch('blrm', 'v', 0.05, 0.95, 3, 'st')}
    select "row", col, cast(floor(pow(greatest(0e0, least(1e0, degrees(atan(sqrt(p*p + q*q)))/45e0)), 0.7e0)*255e0) as int) as r,
      cast(floor(pow(unit, 0.8e0)*255e0) as int) as gb from grad join st using ("row", col)""")
def _rrim(spark, sf_dir):
    return cells_of(focal.rrim_blocks(bare(spark, sf_dir), RES, _LRM_SIGMA, SIDE), "r", "gb").select("row", "col", "r", "gb")


def _sql_vat(s: str, o: str, p: str, exponent: float) -> str:
    s1, o1, p1 = f"({s}/255e0)", f"({o}/255e0)", f"({p}/255e0)"
    over = f"(case when {s1} <= 5e-1 then {s1}*{o1}*2e0 else 1e0 - (1e0 - {s1})*(1e0 - {o1})*2e0 end)"
    blend = f"({s1}*5e-1 + {over}*5e-1)*(1e0 - {p1}*5e-1)"
    return f"case when {s} = 0 then 0 else cast(floor(pow(greatest(0e0, least(1e0, {blend})), {exponent}e0)*254e0 + 1e0) as int) end"


@query("vat_composite", f"""with {GRAD}, {sql_horizons()}, {sql_stretch('hor', 'svf_flux', 0.02, 0.98, 4, 'sv')}, {sql_stretch('hor', 'opos', 0.02, 0.98, 4, 'op')},
    c as (select grad."row", grad.col, {sql_code('sv.unit')} as s, {sql_code('op.unit')} as o, {sql_slope_code()} as p
      from grad join sv using ("row", col) join op using ("row", col))
    select "row", col, {_sql_vat('s', 'o', 'p', 2.0)} as code from c""")
def _vat(spark, sf_dir):
    return cells_of(focal.vat_blocks(bare(spark, sf_dir), RES, _DIST, _DIRS, SIDE), "code").select("row", "col", "code")


_E4 = ["l_orderkey", "l_linenumber"] + [
    f"cast(({a}*{m} + {b}) % {k} as bigint) as {n}" for n, a, m, b, k in (
        ("m", "l_orderkey", 7, "l_linenumber", 256), ("s", "l_partkey", 5, "l_linenumber", 256), ("o", "l_suppkey", 11, "l_linenumber", 256),
        ("g", "l_orderkey", 13, "l_partkey", 256), ("p", "l_partkey", 17, "l_suppkey", 256), ("f", "l_orderkey", 3, "l_suppkey", 256),
        ("b", "l_partkey", 19, "l_linenumber", 256))]
_E4_MIX = """(with_shade*0.1e0 + (case when with_shade <= 5e-1 then with_shade*(m/255e0)*2e0 else 1e0 - (1e0 - with_shade)*(1e0 - m/255e0)*2e0 end)*0.9e0)"""


@query("e4mstp_style_composite", f"""with c as (select {', '.join(_E4)} from lineitem),
    d as (select *, ((o/255e0 - g/255e0 + 1e0)/2e0*5e-1 + (f/255e0 + b/255e0)/2e0*5e-1)*(1e0 - p/255e0*5e-1)*(0.75e0 + s/255e0*0.25e0) as with_shade from c)
    select l_orderkey, l_linenumber, case when o = 0 then 0 else cast(floor(pow(greatest(0e0, least(1e0, {_E4_MIX})), 0.8e0)*254e0 + 1e0) as int) end as code from d""")
def _e4(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr(*_E4)
    return c.select("l_orderkey", "l_linenumber", shade.e4mstp_channel("m", "s", "o", "g", "p", "f", "b").alias("code"))


def _sql_e4(m: str) -> str:
    shaded = "((o/255e0 - g/255e0 + 1e0)/2e0*5e-1 + (f/255e0 + b/255e0)/2e0*5e-1)*(1e0 - p/255e0*5e-1)*(0.75e0 + s/255e0*0.25e0)"
    mix = f"(sh*0.1e0 + (case when sh <= 5e-1 then sh*({m}/255e0)*2e0 else 1e0 - (1e0 - sh)*(1e0 - {m}/255e0)*2e0 end)*0.9e0)".replace("sh", f"({shaded})")
    return f"case when o = 0 then 0 else cast(floor(pow(greatest(0e0, least(1e0, {mix})), 0.8e0)*254e0 + 1e0) as int) end"


def _sql_e4_layers() -> str:
    residual = ", ".join(f"{sql_gaussian('bare', m / RES, f'gs{i}', 'dom_all')}, rs{i} as (select bare.\"row\", bare.col, bare.z - gs{i}.g as v from bare join gs{i} using (\"row\", col))" for i, m in enumerate((1.5, 8.0)))
    stretches = ", ".join([sql_stretch("hor", "svf_flux", 0.02, 0.98, 4, "sv"), sql_stretch("hor", "opos", 0.02, 0.98, 4, "op"), sql_stretch("hor", "oneg", 0.02, 0.98, 4, "og"),
                           sql_stretch("rs0", "v", 0.05, 0.95, 3, "sf"), sql_stretch("rs1", "v", 0.05, 0.95, 3, "sb")])
    dev = ", ".join(f"{sql_code(f'(({_MSTP_DEV[b]}) + 2.5e0)/5e0')} as {c}" for c, b in (("mr", "broad"), ("mg", "meso"), ("mb", "local")))
    return f"""{_MSTP_CTES}, {residual}, {sql_horizons()}, {stretches},
    m as (select bare."row", bare.col, {dev} from bare {_MSTP_JOINS}),
    c as (select grad."row", grad.col, mr, mg, mb, {sql_code('sv.unit')} as s, {sql_code('op.unit')} as o, {sql_code('og.unit')} as g, {sql_slope_code()} as p, {sql_code('sf.unit')} as f, {sql_code('sb.unit')} as b
      from grad join m using ("row", col) join sv using ("row", col) join op using ("row", col) join og using ("row", col) join sf using ("row", col) join sb using ("row", col))"""


@query("e4mstp_style_rgb", f"""with {GRAD}, {_sql_e4_layers()} select "row", col, {_sql_e4('mr')} as r, {_sql_e4('mg')} as g, {_sql_e4('mb')} as b from c""")
def _e4_rgb(spark, sf_dir):
    """The composite from layers that are computed for it, in three bands."""
    return cells_of(focal.e4mstp_blocks(bare(spark, sf_dir), RES, _DIST, _DIRS, side=SIDE), "r", "g", "b").select("row", "col", "r", "g", "b")


# -- coordinates and warps ------------------------------------------------------------------------

_E2 = math.sqrt(geo.GRS80_F * (2 - geo.GRS80_F))


def sql_lambert(lon: str, lat: str) -> tuple[str, str]:
    phi = f"radians({lat})"
    iso = (f"(ln(tan(pi()/4 + {phi}/2e0)) - {_e(_E2)}/2e0*ln((1e0 + {_e(_E2)}*sin({phi}))/(1e0 - {_e(_E2)}*sin({phi}))))")
    radius = f"({_e(geo.LAMBERT93_C)}*exp(-{_e(geo.LAMBERT93_N)}*{iso}))"
    gamma = f"({_e(geo.LAMBERT93_N)}*radians({lon} - 3e0))"
    return (f"({_e(geo.LAMBERT93_XS)} + {radius}*sin({gamma}))", f"({_e(geo.LAMBERT93_YS)} - {radius}*cos({gamma}))")


def sql_from_lambert(x: str, y: str) -> tuple[str, str]:
    dx, dy = f"({x} - {_e(geo.LAMBERT93_XS)})", f"({_e(geo.LAMBERT93_YS)} - {y})"
    iso = f"(ln({_e(geo.LAMBERT93_C)}/sqrt({dx}*{dx} + {dy}*{dy}))/{_e(geo.LAMBERT93_N)})"
    e2 = geo.GRS80_F * (2 - geo.GRS80_F)
    chi = f"(2e0*atan(exp({iso})) - pi()/2)"
    terms = ((2, e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360), (4, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520),
             (6, 7 * e2**3 / 120 + 81 * e2**4 / 1120), (8, 4279 * e2**4 / 161280))
    phi = chi + "".join(f" + {_e(c)}*sin({k}e0*{chi})" for k, c in terms)
    return f"(3e0 + degrees(atan2({dx}, {dy}))/{_e(geo.LAMBERT93_N)})", f"degrees({phi})"


def sql_mercator(lon: str, lat: str) -> tuple[str, str]:
    return f"(radians({lon})*6378137e0)", f"(asinh(tan(radians({lat})))*6378137e0)"


_LX, _LY = sql_lambert("ax", "ay")
_MX, _MY = sql_mercator("ax", "ay")


def _r(expression, unit="1e1"):
    return f"cast(floor(({expression})*{unit} + 5e-1) as bigint)"


@query("coordinate_change", f"""with {fx.FEATURES}, c as (select feature_id, ax, ay, {_LX} as lx, {_LY} as ly, {_MX} as mx, {_MY} as my from feat)
    select feature_id, {_r('lx')} as lambert_x_dm, {_r('ly')} as lambert_y_dm, {_r('mx')} as mercator_x_dm, {_r('my')} as mercator_y_dm,
      {_r('ax', '1e7')} as back_lon_1e7, {_r('ay', '1e7')} as back_lat_1e7 from c""")
def _coordinates(spark, sf_dir):
    c = fx.features(spark, sf_dir).withColumn("l", geo.lambert93_from_lonlat("ax", "ay"))
    c = c.withColumn("m", F.struct(geo.mercator_x("ax").alias("x"), geo.mercator_y("ay").alias("y")))
    c = c.withColumn("b", geo.lonlat_from_lambert93("l.x", "l.y"))

    def r(column, unit=10.0):
        return F.floor(F.col(column) * unit + 0.5).cast("bigint")

    return c.select("feature_id", r("l.x").alias("lambert_x_dm"), r("l.y").alias("lambert_y_dm"), r("m.x").alias("mercator_x_dm"),
                    r("m.y").alias("mercator_y_dm"), r("b.lon", 1e7).alias("back_lon_1e7"), r("b.lat", 1e7).alias("back_lat_1e7"))


def sql_utm() -> str:
    """CTE ``utm(feature_id, x, y)``: the series to fourth order in the third flattening, written out."""
    f = geo.WGS84_F
    n = f / (2 - f)
    k = 2 * math.sqrt(n) / (1 + n)
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    east = "eta" + "".join(f" + {_e(a)}*cos({2 * j}e0*xi)*sinh({2 * j}e0*eta)" for j, a in enumerate(series, 1))
    north = "xi" + "".join(f" + {_e(a)}*sin({2 * j}e0*xi)*cosh({2 * j}e0*eta)" for j, a in enumerate(series, 1))
    return f"""zone as (select feature_id, sin(radians(ay)) as s, radians(ax - (floor((ax + 18e1)/6e0)*6e0 - 177e0)) as lam from feat),
    conformal as (select feature_id, lam, sinh(atanh(s) - {_e(k)}*atanh({_e(k)}*s)) as t from zone),
    angle as (select feature_id, atan2(t, cos(lam)) as xi, atanh(sin(lam)/sqrt(1e0 + t*t)) as eta from conformal),
    utm as (select feature_id, 5e5 + {_e(radius)}*({east}) as x, {_e(radius)}*({north}) as y from angle)"""


@query("utm_round_trip", f"""with {fx.FEATURES}, {sql_utm()} select feature_id, {_r('ax', '1e7')} as lon_1e7, {_r('ay', '1e7')} as lat_1e7,
      32600 + cast(floor((ax + 18e1)/6e0) as int) + 1 as epsg, {_r('x', '1e2')} as east_cm, {_r('y', '1e2')} as north_cm from feat join utm using (feature_id)""")
def _utm(spark, sf_dir):
    f = fx.features(spark, sf_dir).withColumn("epsg", geo.utm_epsg("ax", "ay"))
    central = (F.col("epsg") - 32600) * 6.0 - 183.0
    f = f.withColumn("t", geo.transverse_mercator_from_lonlat("ax", "ay", central))
    f = f.withColumn("b", geo.lonlat_from_transverse_mercator("t.x", "t.y", central))
    return f.select("feature_id", F.floor(F.col("b.lon") * 1e7 + 0.5).cast("bigint").alias("lon_1e7"),
                    F.floor(F.col("b.lat") * 1e7 + 0.5).cast("bigint").alias("lat_1e7"), "epsg",
                    F.floor(F.col("t.x") * 1e2 + 0.5).cast("bigint").alias("east_cm"), F.floor(F.col("t.y") * 1e2 + 0.5).cast("bigint").alias("north_cm"))


_EX, _EY = sql_lambert("px", "py")


@query("reprojected_envelope", f"""with {fx.FEATURES}, t as (select i/21e0 as t from range(22) r(i)),
    p as (select feature_id, unnest([ax + 2e0*t, ax + 2e0*t, ax, ax + 2e0]) as px, unnest([ay, ay + 1e0, ay + 1e0*t, ay + 1e0*t]) as py from feat, t),
    q as (select feature_id, {_EX} as x, {_EY} as y from p)
    select feature_id, {_r('min(x)')} as x0_dm, {_r('min(y)')} as y0_dm, {_r('max(x)')} as x1_dm, {_r('max(y)')} as y1_dm from q group by feature_id""")
def _envelope(spark, sf_dir):
    box = geo.bbox("ax", "ay", F.col("ax") + 2.0, F.col("ay") + 1.0)
    f = fx.features(spark, sf_dir).select("feature_id", box.alias("b")).select(
        "feature_id", arrays.transform_envelope(F.col("b"), arrays.lambert93).alias("e"))
    return f.select("feature_id", *[F.floor(F.col(f"e.{k}") * 10.0 + 0.5).cast("bigint").alias(f"{k}_dm") for k in ("x0", "y0", "x1", "y1")])


_PLACE_X, _PLACE_Y = 900000.0, 6250000.0
_ZOOM = 15


def warp_to_mercator(cells, zoom):
    """Cells placed in Lambert-93 moved to global Mercator pixels of a zoom."""
    pixel = 2 * geo.MERCATOR_HALF / 2**zoom / 256
    centre = geo.lonlat_from_lambert93(
        (F.col("col") + 0.5) * RES + _PLACE_X, F.lit(_PLACE_Y) - (F.col("row") + 0.5) * RES)
    hit = cells.select("raster_id", centre.alias("p")).select(
        "raster_id", geo.floor_long((F.lit(geo.MERCATOR_HALF) - geo.mercator_y("p.lat")) / pixel / 64).alias("brow"),
        geo.floor_long((geo.mercator_x("p.lon") + geo.MERCATOR_HALF) / pixel / 64).alias("bcol")).distinct()
    # the outermost cells reach into blocks that hold no cell centre
    near = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    hit = hit.withColumn("dr", near).withColumn("dc", near).select("raster_id", (F.col("brow") + F.col("dr")).alias("brow"), (F.col("bcol") + F.col("dc")).alias("bcol")).distinct()
    targets = warp.target_cells(hit, 64)
    back = geo.lambert93_from_lonlat(
        geo.mercator_lon((F.col("col") + 0.5) * pixel - geo.MERCATOR_HALF), geo.mercator_lat(F.lit(geo.MERCATOR_HALF) - (F.col("row") + 0.5) * pixel))
    placed = targets.withColumn("b", back)
    return warp.warp_bilinear(
        cells, placed, (F.lit(_PLACE_Y) - F.col("b.y")) / RES - 0.5, (F.col("b.x") - _PLACE_X) / RES - 0.5)


_WLON, _WLAT = sql_from_lambert(f"((col + 5e-1)*{RES}e0 + {_PLACE_X}e0)", f"({_PLACE_Y}e0 - (\"row\" + 5e-1)*{RES}e0)")
_WMX, _WMY = sql_mercator("lon", "lat")
_BX, _BY = sql_lambert("lon", "lat")


def sql_warp(zoom: int) -> str:
    """CTEs up to ``warped(row, col, z)``: the bare-earth model on the Mercator pixels of a zoom."""
    pixel = _e(2 * geo.MERCATOR_HALF / 2**zoom / 256)
    half = _e(geo.MERCATOR_HALF)
    back_lon = f"degrees(((col + 5e-1)*{pixel} - {half})/6378137e0)"
    back_lat = f"degrees(atan(sinh(({half} - (\"row\" + 5e-1)*{pixel})/6378137e0)))"
    return BARE + f""", c0 as (select {_WLON} as lon, {_WLAT} as lat from bare),
    own as (select distinct cast(floor(({half} - {_WMY})/{pixel}/64) as bigint) as br,
      cast(floor(({_WMX} + {half})/{pixel}/64) as bigint) as bc from c0),
    hit as (select distinct br + dr as br, bc + dc as bc from own, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc)),
    tgt as (select br*64 + r as "row", bc*64 + c as col from hit, range(64) rr(r), range(64) cc(c)),
    ll as (select "row", col, {back_lon} as lon, {back_lat} as lat from tgt),
    pos as (select "row", col, ({_PLACE_Y}e0 - {_BY})/{RES}e0 - 5e-1 as pr, ({_BX} - {_PLACE_X}e0)/{RES}e0 - 5e-1 as pc from ll),
    crn as (select "row", col, cast(floor(pr) as bigint) + dr as sr, cast(floor(pc) as bigint) + dc as sc,
      (case when dr = 1 then pr - floor(pr) else 1e0 - (pr - floor(pr)) end)*(case when dc = 1 then pc - floor(pc) else 1e0 - (pc - floor(pc)) end) as w
      from pos, range(2) a(dr), range(2) b(dc)),
    warped as (select crn."row", crn.col, sum(w*z)/sum(w) as z from crn join bare on bare."row" = sr and bare.col = sc where w > 0 group by all)"""


WARP = sql_warp(_ZOOM)


def mercator_blocks(spark, sf_dir, side=256, zoom=_ZOOM, steps=None):
    """The bare-earth model on global Mercator pixels, one block per map tile."""
    return warp.warp_blocks(bare(spark, sf_dir), "z", LambertToPixels(_PLACE_X, _PLACE_Y, RES, zoom), SIDE, side, steps=steps)


@query("warp_bilinear", f"""with {WARP} select "row", col, {sql_mm('z')} as z_mm from warped""")
def _warp(spark, sf_dir):
    return blocks_to_cells(mercator_blocks(spark, sf_dir, 64), ["z"], 64).select("row", "col", mm("z").alias("z_mm"))


@query("warp_by_cell_join", f"""with {WARP} select "row", col, {sql_mm('z')} as z_mm from warped""")
def _warp_cells(spark, sf_dir):
    return warp_to_mercator(cells_of(bare(spark, sf_dir), "z"), _ZOOM).select("row", "col", mm("z").alias("z_mm"))


@query("snapped_bounds", f"""with {fx.FEATURES}, b as (select feature_id, ax*1e5 as x0, ay*1e5 as y0, ax*1e5 + 1234e0 as x1, ay*1e5 + 777e0 as y1 from feat)
    select feature_id, floor(x0/25e0)*25e0 as x0, floor(y0/25e0)*25e0 as y0, (floor(x1/25e0) + 1)*25e0 as x1, (floor(y1/25e0) + 1)*25e0 as y1 from b""")
def _snap(spark, sf_dir):
    box = geo.bbox(F.col("ax") * 1e5, F.col("ay") * 1e5, F.col("ax") * 1e5 + 1234.0, F.col("ay") * 1e5 + 777.0)
    return fx.features(spark, sf_dir).select("feature_id", geo.bbox_snap_out(box, 25.0).alias("b")).select("feature_id", "b.*")


@query("crs_relabel", """select o_custkey as raster_id, 2056 as epsg, min(o_totalprice) as x0, count(*) as n_tiles from orders group by o_custkey""")
def _relabel(spark, sf_dir):
    grids = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("raster_id")).agg(
        F.lit(0).alias("epsg"), F.min("o_totalprice").alias("x0"), F.count(F.lit(1)).alias("n_tiles"))
    return warp.relabel_crs(grids, 2056)


_LAYERS = ["cast(floor(-y/2e0) as bigint) as r", "cast(floor(x/2e0) as bigint) as c", "cast(suppkey % 3 as bigint) as priority",
           "case when cls = 7 then null else z end as z", "suppkey"]


@query("mosaic_by_priority", f"""with {PTS}, l as (select {', '.join(_LAYERS)} from pts)
    select r as "row", c as col, min(struct_pack(p := priority, s := suppkey, z := z)).p as priority, {sql_mm('min(struct_pack(p := priority, s := suppkey, z := z)).z')} as z_mm
    from l where z is not null group by all""")
def _mosaic(spark, sf_dir):
    layers = fx.points(spark, sf_dir).selectExpr("'m' as raster_id", *_LAYERS).withColumnsRenamed({"r": "row", "c": "col"})
    return warp.mosaic(layers, order=[F.col("suppkey")]).select("row", "col", "priority", mm("z").alias("z_mm"))


# -- requests and names ---------------------------------------------------------------------------

_SPEC = ("concat(case event_id % 9 when 0 then 'svf' when 1 then 'oneg' when 2 then '315' when 3 then 'lrm' when 4 then 'slope' when 5 then 'foo' "
         "when 6 then 'vat' when 7 then 'multi' else 'opos' end, case user_id % 7 when 0 then '' when 1 then concat(':dist=', cast(10 + user_id % 30 as string)) "
         "when 2 then concat(':dist=', cast(10 + event_id % 4 as string), case when event_id % 2 = 0 then '.4' else '.1' end, ',gamma=', case when user_id % 2 = 0 then '0.9' else '0.92' end) when 3 then ':conv=rvt' when 4 then ':dist=abc' when 5 then concat(':sigma=', cast(3 + user_id % 5 as string)) "
         "else ':elevation=35' end)")
_SQL_SPEC = f"""s as (select event_id, {_SPEC} as spec from events),
    k as (select event_id, split_part(spec, ':', 1) as type, case when contains(spec, ':') then split_part(spec, ':', 2) else '' end as t from s),
    v as (select event_id, type, regexp_extract(t, 'dist=([^,]*)', 1) as dist, regexp_extract(t, 'gamma=([^,]*)', 1) as gamma, regexp_extract(t, 'conv=([^,]*)', 1) as conv,
      regexp_extract(t, 'sigma=([^,]*)', 1) as sigma, regexp_extract(t, 'elevation=([^,]*)', 1) as elevation from k),
    ok as (select *, case when type in ('svf', 'opos', 'oneg', 'vat') then 'd' when type = 'lrm' then 's' when type in ('315', 'multi') then 'e' else '' end as fam from v),
    j as (select *, case when type = 'foo' then 'unknown type'
      when (dist <> '' and fam <> 'd') or (gamma <> '' and fam <> 'd') or (conv <> '' and type <> 'svf') or (sigma <> '' and fam <> 's') or (elevation <> '' and fam <> 'e') then 'unknown parameter'
      when dist = 'abc' then 'bad value' end as problem from ok)"""


@query("shading_request_parse", f"""with {_SQL_SPEC} select event_id, type, coalesce(problem, 'none') as problem, nullif(dist, '') as dist, nullif(gamma, '') as gamma from j""")
def _parse(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("event_id", f"{_SPEC} as spec").withColumn("p", warp.parse_shading("spec"))
    return s.select("event_id", "p.type", F.coalesce("p.problem", F.lit("none")).alias("problem"),
                    F.try_element_at("p.params", F.lit("dist")).alias("dist"), F.try_element_at("p.params", F.lit("gamma")).alias("gamma"))


_SQL_NAME = """'zone_' || type || case when type = 'svf' then '_' || coalesce(nullif(conv, ''), 'flux') else '' end
      || case when dist <> '' then '_' || cast(cast(round_even(cast(dist as double), 0) as int) as string) || 'm' else '' end
      || case when sigma <> '' then '_s' || sigma || 'm' else '' end || case when elevation <> '' then '_e' || elevation else '' end
      || case when gamma <> '' then '_g0p9' else '' end || '_ombrage.tif'"""


def _valid_requests(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("event_id", f"{_SPEC} as spec").withColumn("p", warp.parse_shading("spec"))
    return s.filter("p.problem is null")


@query("product_name", f"""with {_SQL_SPEC} select event_id, {_SQL_NAME} as name from j where problem is null""")
def _product_name(spark, sf_dir):
    return _valid_requests(spark, sf_dir).select("event_id", warp.product_name(F.lit("zone"), "p.type", "p.params").alias("name"))


@query("product_name_collisions", f"""with {_SQL_SPEC}, n as (select {_SQL_NAME} as name, type || '|' || dist || '|' || gamma || '|' || conv || '|' || sigma || '|' || elevation as settings from j where problem is null)
    select name, count(distinct settings) as n_settings from n group by name having count(distinct settings) > 1""")
def _collisions(spark, sf_dir):
    return warp.name_collisions(_valid_requests(spark, sf_dir), warp.product_name(F.lit("zone"), "p.type", "p.params"), F.col("spec"))


@query("shading_presets", """with r as (select c_custkey, case when c_acctbal < 0 then 0.5e0 when c_acctbal < 3000 then 1e0 when c_acctbal < 6000 then 2.5e0 else 5e0 end as res from customer),
    n as (select *, case when res <= 0.75 then 'micro' when res <= 2.5 then 'standard' else 'landscape' end as preset from r),
    p(preset, d, s, e) as (values ('micro', 15e0, 8e0, 25e0), ('standard', 30e0, 15e0, 25e0), ('landscape', 80e0, 40e0, 30e0)),
    t(type) as (values ('svf'), ('opos'), ('lrm'), ('multi'), ('slope'))
    select c_custkey, preset, type, case when type in ('svf', 'opos') then d end as dist, case when type = 'lrm' then s end as sigma,
      case when type = 'multi' then e end as elevation, res*15e0 as default_sigma from n join p using (preset), t""")
def _presets(spark, sf_dir):
    r = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_acctbal < 0 then 0.5e0 when c_acctbal < 3000 then 1e0 when c_acctbal < 6000 then 2.5e0 else 5e0 end as res")
    return warp.preset_requests(r, "res").withColumn("default_sigma", warp.default_sigma_m("res")).drop("res")


@query("shading_type_lists", """with r as (select p_partkey, case p_partkey % 5 when 0 then 'all' when 1 then 'none' when 2 then 'vat' when 3 then 'lrm' else 'svf' end as t from part),
    a(type) as (values ('lrm'), ('svf'), ('opos'), ('oneg'), ('rrim'), ('multi'), ('315'), ('045'), ('135'), ('225'), ('slope'))
    select p_partkey, type from r join a on t = 'all' union all select p_partkey, t from r where t not in ('all', 'none')""")
def _type_lists(spark, sf_dir):
    kind = F.expr("case p_partkey % 5 when 0 then 'all' when 1 then 'none' when 2 then 'vat' when 3 then 'lrm' else 'svf' end")
    r = table(spark, sf_dir, "part").select("p_partkey", F.array(kind).alias("types"))
    return warp.split_layers(r, warp.expand_types).select("p_partkey", "type")


@query("precomputed_shading", """select o_orderkey, case when o_custkey % 3 = 0 and o_orderkey % 2 = 0 then 'provider' else 'computed' end as origin from orders""")
def _precomputed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    providers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("multi"))).alias("precomputed"))
    products = orders.select("o_orderkey", F.col("o_custkey").alias("code"))
    multi = warp.with_precomputed(products, providers, "multi")
    return multi.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("origin")).otherwise("computed").alias("origin"))
