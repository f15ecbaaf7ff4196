"""Outputs.  Spark's commit protocol publishes a table only when every task finished."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.operators import quality, tiles


def write_raster(blocks: DataFrame, path: str) -> None:
    """Raster blocks by raster and block row.

    Neighbours share a file through a coarse key: a range partitioning would run the kernels before it twice.
    """
    near = [F.floor(F.col(k) / F.lit(16)) for k in ("brow", "bcol")]
    blocks.repartition("raster_id", *near).sortWithinPartitions("raster_id", "brow", "bcol").write.mode("overwrite").partitionBy("raster_id").parquet(path)


def checked_raster(blocks: DataFrame, band: str) -> DataFrame:
    """The blocks, failing on values that are neither NULL nor a plausible height."""
    bad = F.exists(band, lambda z: F.isnan(z) | (F.abs(z) > 9000.0))
    return blocks.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("implausible height in raster")).cast("boolean")).otherwise(True))


def write_tiles(tile_rows: DataFrame, meta: DataFrame, path: str) -> None:
    """Tile set: one row per tile, by zoom, and its metadata table."""
    near = [F.floor(F.col(k) / F.lit(64)) for k in ("x", "y")]
    tile_rows.repartition("zoom", *near).sortWithinPartitions("zoom", "y", "x").write.mode("overwrite").partitionBy("zoom").parquet(f"{path}/tiles")
    meta.write.mode("overwrite").parquet(f"{path}/metadata")


def write_pyramid(blocks: DataFrame, path: str, zoom_min: int, zoom_max: int, band: str = "v", side: int = tiles.TILE) -> None:
    """Pyramid levels as one table per zoom; each level reads the stored one above it.

    Nothing is recomputed through several levels and a lost executor costs one level at most.
    """
    spark = blocks.sparkSession
    blocks.write.mode("overwrite").parquet(f"{path}/zoom={zoom_max}")
    for zoom in range(zoom_max - 1, zoom_min - 1, -1):
        above = spark.read.parquet(f"{path}/zoom={zoom + 1}")
        tiles.reduce_once(above, band, side).write.mode("overwrite").parquet(f"{path}/zoom={zoom}")


def write_sqlitedb_tables(tile_rows: DataFrame, path: str) -> None:
    """The same tiles in the ``x, y, z, s, image`` layout with its ``info`` table."""
    tiles.to_sqlitedb(tile_rows).write.mode("overwrite").partitionBy("z").parquet(f"{path}/tiles")
    tiles.sqlitedb_info(tile_rows).write.mode("overwrite").parquet(f"{path}/info")


def feature_json(features: DataFrame) -> DataFrame:
    """GeoJSON text of each feature (one line), keeping the other columns."""
    vertex = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p.x, p.y)))
    first = F.element_at(vertex, 1)
    geometry = (
        F.when((F.col("kind") == "Point") & (F.size(F.flatten("rings")) > 1), F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.flatten(vertex).alias("coordinates"))))
        .when(F.col("kind") == "Point", F.to_json(F.struct(F.lit("Point").alias("type"), F.element_at(first, 1).alias("coordinates"))))
        .when((F.col("kind") == "LineString") & (F.size("rings") == 1), F.to_json(F.struct(F.lit("LineString").alias("type"), first.alias("coordinates"))))
        .when(F.col("kind") == "LineString", F.to_json(F.struct(F.lit("MultiLineString").alias("type"), vertex.alias("coordinates"))))
        .otherwise(F.to_json(F.struct(F.lit("Polygon").alias("type"), vertex.alias("coordinates")))))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("props"), F.lit(',"geometry":'), geometry, F.lit("}"))
    return features.withColumn("json", text)


def write_geojson(features: DataFrame, path: str, compress: bool = True, by_key: bool = True) -> None:
    """Features as GeoJSON lines: the whole set, and one folder per tag key."""
    lines = feature_json(features)
    option = "gzip" if compress else "none"
    lines.select(F.col("json").alias("value")).write.mode("overwrite").option("compression", option).text(f"{path}/all")
    if by_key:
        lines.select("key", F.col("json").alias("value")).write.mode("overwrite").partitionBy("key").option("compression", option).text(f"{path}/by_key")


def write_map_objects(objects: dict[str, DataFrame], path: str) -> None:
    for name, table in objects.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def coverage_features(regions: DataFrame, providers: DataFrame, outlines: DataFrame) -> DataFrame:
    """Coverage map rows as GeoJSON lines: region properties with the outline of each region."""
    rows = quality.coverage_map(regions, providers).join(outlines.select("region", "rings"), "region")
    props = F.create_map(
        F.lit("title"), F.col("title"), F.lit("providers"), F.col("codes"), F.lit("laz"), F.col("has_cloud").cast("string"))
    return feature_json(rows.withColumn("kind", F.lit("Polygon")).withColumn("props", props)).select("region", "json")


def index_sheet(cells: DataFrame) -> DataFrame:
    """Extent and number of every output cell per product (``product, chunk, x0, y0, x1, y1`` in).

    Numbers follow the chunk key, which is unique per product; they come from counting smaller keys,
    not from sorting a product in one place.
    """
    boxes = cells.groupBy("product", "chunk").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_tiles"))
    row, col = F.split("chunk", "x")[0].cast("int"), F.split("chunk", "x")[1].cast("int")
    width = boxes.groupBy("product").agg(F.max(col).alias("n_cols"))
    return boxes.join(width, "product").withColumn("number", (row - 1) * F.col("n_cols") + col).drop("n_cols")


def write_manifest(manifest: DataFrame, path: str, run: str) -> None:
    """Manifest of one run as its own partition; earlier runs stay, a repeated write of a run replaces what it left."""
    manifest.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifests with the column ``run``."""
    return spark.read.parquet(path)
