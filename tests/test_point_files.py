"""Points are stored in one file a tile, or a few."""

from pyspark.sql import functions as F

from reliefspark.sources import grids


def test_files_of_stored_points_are_about_as_many_as_tiles(spark, tmp_path):
    cloud = spark.range(4000).select((F.col("id") % 40 * 5.0 + 0.5).alias("x"), (F.col("id") / 8.0).alias("y"), F.col("id").cast("double").alias("z"))
    grids.write_points(cloud, str(tmp_path / "p"), tile_m=100.0)
    tiles = 2 * 5
    assert len(list((tmp_path / "p").rglob("*.parquet"))) <= tiles + 4  # 4 tasks
    stored = grids.read_points(spark, str(tmp_path / "p"))
    assert stored.count() == 4000 and stored.agg(F.sum("z")).first()[0] == 3999 * 2000
