"""Rows per pixel: what is sent for them, and how often their positions are worked out."""

import numpy as np
from pyspark.sql import functions as F

from reliefspark.operators import tiles as T
from reliefspark.operators import warp


def _plan(df, kind):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_pixels_are_put_together_before_the_shuffle(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 256, (300, 600))
    rows = [(3, r + 200, c - 100, int(values[r, c])) for r in range(300) for c in range(600)]
    rng.shuffle(rows)
    tiles = T.pixel_tiles(spark.createDataFrame([tuple(map(int, r)) for r in rows], "zoom int, prow long, pcol long, v int").repartition(3))
    whole = np.zeros((512, 1024), np.uint8)
    whole[200:500, 156:756] = values
    got = {(t.x, t.y): t for t in tiles.collect()}
    for x in range(-1, 3):
        for y in range(2):
            part = whole[y * 256:(y + 1) * 256, (x + 1) * 256:(x + 2) * 256]
            tile = got.pop((x, y), None)
            assert (tile is None) == (not part.any())
            if tile:
                assert np.array_equal(np.frombuffer(tile.pixels, np.uint8).reshape(256, 256), part) and tile.filled == (part > 0).sum()
    assert not got
    plan = _plan(tiles, "sparkPlan")
    assert "MapInArrow" in plan and plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow")


def test_positions_are_worked_out_once(spark):
    cells = spark.createDataFrame([("r", 0, 0, 1.0), ("r", 0, 1, 3.0)], "raster_id string, row long, col long, z double")
    targets = spark.range(4).selectExpr("'r' as raster_id", "id * 0 as row", "id as col")
    moved = warp.warp_bilinear(cells, targets, F.sin(F.col("row") * 1.0), F.tan(F.atan(F.col("col") / 2.0)))
    plan = _plan(moved, "optimizedPlan")
    assert plan.count("SIN(") <= 1 and plan.count("ATAN(") <= 1
    assert "Broadcast" not in _plan(moved, "sparkPlan")
    assert {r.col: round(r.z, 9) for r in moved.collect()} == {0: 1.0, 1: 2.0, 2: 3.0, 3: 3.0}


def test_cells_of_few_blocks_are_dealt_out(spark):
    blocks = spark.range(400).selectExpr("'r' as raster_id", "id % 100 as brow", "id * 0 as bcol").distinct()
    spread = warp.target_cells(blocks, 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and sum(r["count"] for r in spread) == 6400


def test_rows_of_map_pixels_come_from_blocks(spark):
    import __spark_entry__ as entry

    for name in ("tile_summary", "tile_packing_from_pixels"):
        assert "Join" not in _plan(entry.queries()[name](spark, "/root/testdata/sf0.001"), "sparkPlan").replace("LeftSemi", "").split("FlatMapGroupsInArrow")[0]
