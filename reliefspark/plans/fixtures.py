"""Elevation, catalogue and map data derived from the input tables.

Each view exists as a DataFrame and as a ``WITH`` clause text, both from the same select lists, so the
registered queries and their SQL twins read the same rows.  All rows of the tables are used and the
covered area grows with them: 3750 orders make one 200 m tile, two tiles side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.operators.points import Grid
from reliefspark.session import table

GRID = Grid(res=2.0, tile_cells=100)
SIDE = 50

_POINTS_BASE = [
    "cast(floor(l_orderkey/3.75e3) as bigint) as tile",
    "l_suppkey as suppkey",
    "cast((l_orderkey*37 + l_linenumber*11) % 2000 as bigint) as x_dm",
    "cast((l_partkey*53 + l_suppkey*17) % 2000 as bigint) as y_dm",
    "cast(l_quantity as bigint) as q",
    """cast(case (l_orderkey + l_linenumber) % 10
        when 0 then 2 when 1 then 2 when 2 then 2 when 3 then 1 when 4 then 3
        when 5 then 4 when 6 then 5 when 7 then 7 when 8 then 9 else 66 end as int) as cls""",
    "l_returnflag = 'R' and l_quantity > 49 as withheld",
]
_POINTS = [
    "cast(tile as string) as cloud_id", "suppkey",
    "((tile % 2)*2000 + x_dm + 5e-1)/1e1 as x",
    "-(floor(tile/2e0)*2000 + 1999 - y_dm + 5e-1)/1e1 as y",
    """(10000 + cast(floor(x_dm/4e1) as bigint) + cast(floor(y_dm/8e1) as bigint)
        + case when cls in (1,3,4) then q*8 when cls = 5 then 600 + q*20 when cls = 7 then -900 else q end)/1e2 as z""",
    "cls", "withheld",
]
INDEX_COLUMNS = [
    "o_orderkey as order_id", "o_custkey % 40 as key_x", "cast(floor(o_custkey/4e1) as bigint) as key_y",
    "cast(year(o_orderdate) as bigint) as vintage", "cast(month(o_orderdate) as bigint) as survey_month",
    "substring(o_orderpriority, 1, 1) as collection",
    """concat('dtm_', cast(o_custkey % 40 as string), '_', cast(cast(floor(o_custkey/4e1) as bigint) as string), '_',
        cast(year(o_orderdate) as string), '_', cast(o_orderkey as string), '.tif') as tile_name""",
    "concat('https://tiles.example/', substring(o_orderpriority, 1, 1), '/', lpad(cast(o_orderkey as string), 12, '0')) as url",
    "o_totalprice as size",
]
_FEATURES = [
    "event_id as feature_id", "user_id", "event_type as key",
    "regexp_extract(props, '\"k\": ([0-9]+)', 1) as value",
    "concat('layer_', cast(event_id % 3 as string)) as source",
    "5.5e0 + (user_id % 997)/997e0 as ax", "43e0 + (event_id % 991)/991e0 as ay",
    "5.5e0 + (user_id % 997)/997e0 + ((event_id*7) % 200 - 100)/2e4 as bx",
    "43e0 + (event_id % 991)/991e0 + ((event_id*13) % 200 - 100)/2e4 as `by`",
]
_TILES = [
    "l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as data_len",
    "cast(floor(l_orderkey/3.75e3) as bigint) as set_no", "cast(12 + l_linenumber % 3 as int) as zoom",
    "5.5e0 + (l_orderkey % 997)/997e0 as lon", "43e0 + (l_partkey % 991)/991e0 as lat",
]


def _with(name: str, columns: list[str], source: str) -> str:
    return f"{name} as (select {', '.join(columns)} from {source})"


PTS = _with("pts0", _POINTS_BASE, "lineitem") + ", " + _with("pts", _POINTS, "pts0")
INDEX = _with("idx", INDEX_COLUMNS, "orders")
FEATURES = _with("feat", [c.replace("`", '"') for c in _FEATURES], "events")
TILES = (
    _with("tl0", _TILES, "lineitem")
    + """, tl as (select distinct concat('set_', cast(set_no as string)) as set_id, zoom,
      cast(floor((lon + 18e1)/36e1*(1 << zoom)) as bigint) as x,
      cast(floor((1e0 - asinh(tan(radians(lat)))/pi())/2e0*(1 << zoom)) as bigint) as y from tl0)"""
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_POINTS_BASE).selectExpr(*_POINTS)


def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*INDEX_COLUMNS)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_FEATURES)


def _vertex(x: str, y: str):
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-vertex lines."""
    return features(spark, sf_dir).select(
        "feature_id", "key", "value", "source", F.lit("LineString").alias("kind"),
        F.array(F.array(_vertex("ax", "ay"), _vertex("bx", "by"))).alias("rings"),
        F.create_map("key", "value").alias("props"))


def ring_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open three-vertex rings; some have no area."""
    return features(spark, sf_dir).select(
        "feature_id", "key", "value", "source", F.lit("Polygon").alias("kind"),
        F.array(F.array(_vertex("ax", "ay"), _vertex("bx", "ay"), _vertex("bx", "by"))).alias("rings"),
        F.create_map("key", "value").alias("props"))


def tile_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tiles ``set_id, zoom, x, y`` (rows from the north)."""
    from reliefspark.functions import geo

    base = table(spark, sf_dir, "lineitem").selectExpr(*_TILES)
    return base.select(
        F.concat(F.lit("set_"), F.col("set_no").cast("string")).alias("set_id"), "zoom",
        geo.tile_x("lon", F.col("zoom")).alias("x"), geo.tile_y("lat", F.col("zoom")).alias("y")).distinct()


def mm(column):
    """Metres as whole millimetres."""
    return F.floor(F.col(column) * 1000.0 + 0.5).cast("bigint")


def sql_mm(expression: str) -> str:
    return f"cast(floor(({expression})*1e3 + 5e-1) as bigint)"


# -- SQL twins of the fill and of the models ------------------------------------------------------

CELLS = (
    PTS + """, addr as (select *, cast(floor(-y/2e0) as bigint) as "row", cast(floor(x/2e0) as bigint) as col from pts),
    useful as (select * from addr where cls not in (7, 18) and not withheld),
    dom as (select ty*100 + r as "row", tx*100 + c as col from (select distinct cast(floor("row"/1e2) as bigint) ty,
        cast(floor(col/1e2) as bigint) tx from useful) t, range(100) rr(r), range(100) cc(c)),
    dom_all as (select ty*100 + r as "row", tx*100 + c as col from (select distinct cast(floor("row"/1e2) as bigint) ty,
        cast(floor(col/1e2) as bigint) tx from addr) t, range(100) rr(r), range(100) cc(c))"""
)


def sql_fill(source: str, value: str, reach: int, name: str, domain: str = "dom") -> str:
    """CTEs ``name(row, col, z)``: bounded four-direction fill of ``source`` over the domain."""
    def term(pos, z, along):
        d = f"abs({along} - {pos})"
        near = f"{pos} is not null and {d} <= {reach}"
        return f"case when {near} then 1e0/{d} else 0e0 end", f"case when {near} then {z}/{d} else 0e0 end"

    sides = [term("lc", "lz", "col"), term("rc", "rz", "col"), term("uc", "uz", '"row"'), term("dc", "dz", '"row"')]
    weight = "((({}) + ({})) + ({})) + ({})".format(*[s[0] for s in sides])
    total = "((({}) + ({})) + ({})) + ({})".format(*[s[1] for s in sides])
    return f"""{name}_g as (select d."row", d.col, s.{value} as z from {domain} d left join {source} s using ("row", col)),
    {name}_w as (select "row", col, z,
        last_value(case when z is not null then col end ignore nulls) over wl as lc, last_value(z ignore nulls) over wl as lz,
        last_value(case when z is not null then col end ignore nulls) over wr as rc, last_value(z ignore nulls) over wr as rz,
        last_value(case when z is not null then "row" end ignore nulls) over wu as uc, last_value(z ignore nulls) over wu as uz,
        last_value(case when z is not null then "row" end ignore nulls) over wd as dc, last_value(z ignore nulls) over wd as dz
      from {name}_g window
        wl as (partition by "row" order by col rows between unbounded preceding and 1 preceding),
        wr as (partition by "row" order by col desc rows between unbounded preceding and 1 preceding),
        wu as (partition by col order by "row" rows between unbounded preceding and 1 preceding),
        wd as (partition by col order by "row" desc rows between unbounded preceding and 1 preceding)),
    {name} as (select "row", col, case when z is not null then z when sw > 0 then sz/sw end as z
      from (select "row", col, z, {weight} as sw, {total} as sz from {name}_w)
      where z is not null or sw > 0)"""


BARE_RAW = """bare_raw as (select "row", col, min(z) as z from addr where cls in (2, 9, 66)
    or cloud_id in (select cloud_id from addr group by cloud_id having count(*) filter (where cls in (2, 9, 66)) < 100)
    group by all)"""
BARE = CELLS + ", " + BARE_RAW + ", " + sql_fill("bare_raw", "z", 50, "bare", "dom_all")

FEATURE_RAW = (
    CELLS + """, raw as (select "row", col, min(case when cls = 2 then z end) as z_ref,
      min(case when cls in (2, 9, 66) then z end) as z_ground from useful where cls in (1, 2, 3, 4, 9, 66) group by all),
    """ + sql_fill('(select "row", col, z_ref from raw where z_ref is not null)', "z_ref", 100, "ref") + """,
    low as (select u."row", u.col, min(u.z) as z_low from useful u join ref using ("row", col)
      left join raw using ("row", col)
      where u.cls in (1, 3, 4) and u.z - ref.z >= 0.4e0 and u.z - ref.z <= 2.5e0 and raw.z_ground is null group by all),
    merged as (select "row", col, coalesce(raw.z_ground, low.z_low) as z from raw full outer join low using ("row", col)
      where coalesce(raw.z_ground, low.z_low) is not null)"""
)
FEATURE = FEATURE_RAW + ", " + sql_fill("merged", "z", 100, "dfm")


def land(lines: DataFrame, folder: str) -> str:
    """Writes ``name, line, value`` rows as text files ``<folder>/<name>`` and returns the folder.

    Files are written as deliveries have them, one file a name, through the file system of the folder.
    """
    from reliefspark.sources.las import file_system

    def write(batches):
        import pyarrow as pa

        system, base = file_system(folder)
        now, out, n = None, None, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != now:
                    if out:
                        out.close()
                    now, path, n = name, f"{base}/{name}", n + 1
                    system.create_dir(path.rpartition("/")[0])
                    out = system.open_output_stream(path)
                out.write((value + "\n").encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartition(width, "name").sortWithinPartitions("name", "line").select("name", "value")
    dealt.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return folder
