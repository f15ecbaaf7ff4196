"""Synthetic clouds with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reliefspark.operators import points as P
from reliefspark.operators.blocks import KEYS, cells_to_blocks
from reliefspark.operators.fill import fill_holes

GRID = P.Grid(res=0.5, left=0.0, top=40.0, tile_cells=80)
SIDE = 16


@pytest.fixture(scope="module")
def cloud(spark):
    """Flat ground at 100 m; a wall and a mound without ground below; three low noise points."""
    rows = []
    for i in range(80):
        for j in range(80):
            x, y = i * 0.5, j * 0.5
            wall = 18 <= x < 20 and 10 <= y < 30
            mound = 28 <= x <= 34 and 28 <= y <= 34
            if not wall and not mound:
                rows.append((x, y, 100.0, 2))
            if wall:
                rows.append((x, y, 101.5, 1 if (i + j) % 2 else 4))
            if mound:
                rows.append((x, y, 100.0 + max(0.0, 1.5 - 0.5 * max(abs(x - 31), abs(y - 31))), 1))
    rows += [(1.0, 1.0, 88.0, 7), (38.0, 2.0, 88.0, 7), (2.0, 38.0, 88.0, 7)]
    # the grid counts from the top edge, so shift points off the cell borders
    data = [("syn", x + 0.25, y + 0.25, z, c, False) for x, y, z, c in rows]
    return spark.createDataFrame(data, "cloud_id string, x double, y double, z double, cls int, withheld boolean").cache()


def heights(model):
    return {(r.row, r.col): r.z for r in model.collect()}


def at(x, y):
    return int((40.0 - (y + 0.25)) / 0.5), int((x + 0.25) / 0.5)


def test_wall_stands_in_the_feature_model_only(cloud):
    dfm = heights(P.points_to_dfm(cloud, GRID, side=SIDE))
    dtm = heights(P.points_to_dtm(P.drop_noise(cloud), GRID, side=SIDE))
    assert abs(dfm[at(19, 20)] - 101.5) < 0.2
    assert abs(dtm[at(19, 20)] - 100.0) < 0.2
    assert len(dfm) == 80 * 80 and all(np.isfinite(v) and v != 0 for v in dfm.values())
    assert min(r for r, _ in dfm) == 0 and max(c for _, c in dfm) == 79


def test_slice_holds_objects_alone(cloud):
    cut = heights(P.points_to_dfm(cloud, GRID, side=SIDE, classes_ground=()))
    assert abs(cut[at(19, 20)] - 101.5) < 0.2
    assert at(5, 5) not in cut


def test_injection_never_touches_cells_with_ground(cloud):
    both = P.feature_blocks(cloud, GRID, side=SIDE)
    from reliefspark.operators.blocks import blocks_to_cells

    cells = blocks_to_cells(both, ["z_ground", "z_low"], SIDE)
    assert cells.filter("z_ground is not null and z_low is not null").count() == 0


def test_hot_cell_gives_the_same_minimum(spark):
    """A third of all points in one cell."""
    n = 30000
    ground = spark.range(0, 400).selectExpr("'a' as cloud_id", "(id % 20) + 0.5 as x", "floor(id/20) + 0.5 as y", "100e0 as z", "2 as cls", "false as withheld").filter("not (x = 10.5 and y = 10.5)")
    hot = spark.range(n).selectExpr("'a' as cloud_id", "10.5 as x", "10.5 as y", "100.9e0 + (id % 997)/1e3 as z", "4 as cls", "false as withheld")
    grid = P.Grid(res=1.0, left=0.0, top=20.0, tile_cells=20)
    dfm = heights(P.points_to_dfm(ground.unionByName(hot), grid, side=20))
    assert dfm[(9, 10)] == pytest.approx(100.9) and len(dfm) == 400


def test_crs_guard(spark):
    heads = spark.createDataFrame(
        [("a", 2154, "metre"), ("b", 2229, "us survey foot"), ("c", None, None), ("d", 2154, "foot")], "cloud_id string, epsg int, unit string")
    assert {r.cloud_id for r in P.require_crs(heads, 2154, strict=False).collect()} == {"a", "c"}
    with pytest.raises(Exception, match="wrong crs|not metric"):
        P.require_crs(heads, 2154).collect()


def test_settings_are_checked():
    assert P.check_settings(hmin=0.31)["hmin"] == 0.3
    for bad in (dict(ground="cloth"), dict(rigidness=4), dict(threshold=9.0), dict(hmin=3.0, hmax=1.0)):
        with pytest.raises(ValueError):
            P.check_settings(**bad)


def test_variant_tags(spark):
    usual = list(P.DEFAULT_CLASSES)
    cases = [
        ("classes", 0.4, 2.5, usual, 0.5, 0.5, 1, "laz_dfm"), ("classes", 0.3, 3.0, usual, 0.5, 0.5, 1, "laz_dfm_h03-30"),
        ("classes", 0.4, 2.5, [1, 2, 3, 4, 5, 9, 66], 0.5, 0.5, 1, "laz_dfm_c1-2-3-4-5-9-66"), ("csf", 0.3, 2.5, usual, 0.5, 0.5, 1, "laz_csf"),
        ("csf", 0.4, 2.5, usual, 0.8, 0.5, 2, "laz_csf_t08_g2"), ("csf", 0.4, 2.5, usual, 0.5, 1.0, 1, "laz_csf_r10")]
    df = spark.createDataFrame(cases, "g string, a double, b double, c array<int>, t double, r double, k int, want string")
    rows = df.select(P.variant_tag("g", "a", "b", "c", "t", "r", "k").alias("tag"), "want").collect()
    assert [r.tag for r in rows] == [r.want for r in rows]


def test_bounds_are_half_open(cloud):
    inside = P.clip_bounds(cloud, (0.25, 0.25, 10.25, 10.25))
    assert inside.agg(F.max("x")).first()[0] == 9.75 and inside.agg(F.min("x")).first()[0] == 0.25


def test_smallest_gap_over_partitions(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as k", "cast(id * id % 5003 as double) as v")
    got = {r.k: r.gap for r in P.smallest_gap(rows, "k", "v").collect()}
    frame = rows.distinct().toPandas()
    want = {k: float(np.diff(np.sort(g.v.unique())).min()) for k, g in frame.groupby("k")}
    assert got == want


@pytest.mark.parametrize("name", ["feature_reinjection", "model_difference_mask", "standing_structures"])
def test_models_hand_blocks_to_python_one_by_one(spark, name):
    """No Python step gets batches of blocks, which grow with the blocks of a partition up to the size the session allows."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")


def test_fill_of_cells_and_of_keyed_blocks_is_that_of_blocks(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame([("ab"[k], int(r), int(c), float(z), None if z < 0.3 else float(r)) for k in range(2) for r, c, z in zip(*np.divmod(rng.permutation(1600)[:300], 40), rng.random(300))], columns=["raster_id", "row", "col", "z", "kept"])
    cells = spark.createDataFrame(frame)
    blocks = cells_to_blocks(cells, ["z", "kept"], 8)
    joined = blocks.join(blocks.select(*KEYS).distinct(), list(KEYS))

    def filled(source, rows):
        out = fill_holes(rows, "z", 12, 8, keep=["kept"], per_tile=5, source=source)
        return sorted(map(repr, out.collect()))

    want = filled("blocks", blocks)
    assert len(want) == 50 and filled("cells", cells) == want == filled("keyed", joined)
