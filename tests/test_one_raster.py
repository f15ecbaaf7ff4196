"""A raster of its own must not end in one task."""

import numpy as np

from helpers import to_blocks
from reliefspark.operators import focal
from reliefspark.operators.blocks import blocks_to_cells


def test_what_is_known_of_a_raster_goes_to_its_rows(spark):
    blocks = to_blocks(spark, np.random.default_rng(6).normal(100, 3, (32, 32)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = focal.stretch_codes(blocks_to_cells(blocks, ["z"], 16), "z", 0.02, 0.98)
        stretched = focal.stretched_blocks(blocks, {"z": (0.02, 0.98, 3)})
        based = focal.median_stand_in(blocks, side=16)
        for df in (coded, stretched, based):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert df.count() == (1024 if df is coded else 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
