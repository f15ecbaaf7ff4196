"""Height files: text grids, point text, LAS clouds, windowed reads of stored points and blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.functions.geo import floor_long
from reliefspark.operators.points import read_window


#: rows of a side that is sent to all tasks after counting
FEW_ROWS = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and an order within it (``line_no`` grows along the file)."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("cloud_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_no"))


def _looked_up(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a side of one row per file or split, sent to all tasks if a count says that it is small."""
    return rows.join(F.broadcast(side) if side.count() <= FEW_ROWS else side, list(keys))


def numbered_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``value, path, line, token``: lines with their number and the number of values before them in the whole file.

    Files are split as Spark likes.  Each split counts on its own, a sum over the splits before it gives what it starts
    with, so a file of any size is read by many tasks.  ``separator`` parts the values of a line; blanks count as one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        now, lines, tokens = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = batch.column(0)
            parts = pc.split_pattern_regex(pc.utf8_trim_whitespace(text), r"\s+") if separator == " " else pc.split_pattern(text, separator)
            held = np.where(pc.equal(pc.utf8_trim_whitespace(text), "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            blocks, files = batch.column(2).to_numpy(), batch.column(1).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])])
            sizes = np.diff(np.r_[starts, n])
            before = np.cumsum(held) - held
            number, before = np.arange(n) - np.repeat(starts, sizes), before - np.repeat(before[starts], sizes)
            if (batch.column(1)[0].as_py(), int(blocks[0])) == now:  # goes on from the last batch
                number[:sizes[0]] += lines
                before[:sizes[0]] += tokens
            now, lines, tokens = (batch.column(1)[n - 1].as_py(), int(blocks[-1])), int(number[-1]) + 1, int(before[-1] + held[-1])
            yield pa.RecordBatch.from_arrays([text, batch.column(1), batch.column(2), pa.array(number), pa.array(before), pa.array(held.astype(np.int64))],
                                             ["value", "path", "block", "line", "token", "held"])

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    counted = text.mapInArrow(run, "value string, path string, block bigint, line bigint, token bigint, held bigint")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.groupBy("path", "block").agg((F.max("line") + 1).alias("n"), F.sum("held").alias("m"))
    splits = splits.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("tokens"))
    whole = _looked_up(counted, splits, ["path", "block"])
    return whole.select("value", "path", (F.col("line") + F.col("lines")).alias("line"), (F.col("token") + F.col("tokens")).alias("token"))


def xyz_rows(lines: DataFrame, separators: str = r"[ ,;\t]+") -> DataFrame:
    """Points ``x, y, z`` from text lines; lines that are no three numbers have ``bad`` set."""
    parts = F.split(F.trim("value"), separators)
    numbers = [F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")]
    others = [c for c in lines.columns if c != "value"]
    rows = lines.filter(F.trim("value") != "").select(*others, *numbers, (F.size(parts) < 3).alias("short"))
    bad = F.col("short") | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    return rows.select(*others, "x", "y", "z", bad.alias("bad"))


def read_xyz(spark: SparkSession, path: str, separators: str = r"[ ,;\t]+") -> DataFrame:
    return xyz_rows(read_lines(spark, path), separators)


def bad_line_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cloud_id").agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n_lines"))


def read_csv_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Cells of height tiles named ``.../zoom/x/y.txt``: 256 lines of 256 values, ``e`` means unknown; rows and columns
    are global pixels."""
    lines = numbered_lines(spark, path)
    named = lines.select(*[F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.\w+$", i).cast("bigint").alias(n) for i, n in enumerate(("zoom", "x", "y"), 1)], "line", "value")
    cells = named.select("zoom", "x", "y", "line", F.posexplode(F.split(F.trim("value"), ",")).alias("c", "v"))
    return cells.select(
        F.col("zoom").cast("int"), (F.col("y") * 256 + F.col("line")).alias("row"), (F.col("x") * 256 + F.col("c")).alias("col"), F.col("v").try_cast("double").alias("z")
    ).filter(F.col("z").isNotNull())


# The keywords of the header of an ESRI ASCII grid.
GRID_KEYWORDS = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value")


def ascii_headers(lines: DataFrame) -> DataFrame:
    """``path, n_header, nx, ny, res, left, top, nodata`` of every grid, from its first lines."""
    words = F.split(F.lower(F.trim("value")), r"\s+")
    head = lines.filter(F.col("line") < len(GRID_KEYWORDS)).select("path", words[0].alias("key"), F.get(words, F.lit(1)).try_cast("double").alias("v"))
    facts = head.filter(F.col("key").isin(*GRID_KEYWORDS)).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_header"), *[F.max(F.when(F.col("key") == k, F.col("v"))).alias(k) for k in GRID_KEYWORDS])
    res, ny = F.col("cellsize"), F.col("nrows").cast("int")
    bottom = F.coalesce("yllcorner", F.col("yllcenter") - res / 2)
    return facts.select(
        "path", "n_header", F.col("ncols").cast("int").alias("nx"), ny.alias("ny"), res.alias("res"), F.coalesce("xllcorner", F.col("xllcenter") - res / 2).alias("left"),
        (bottom + ny * res).alias("top"), F.coalesce("nodata_value", F.lit(-9999.0)).alias("nodata"))


def read_ascii_grids(spark: SparkSession, path: str, epsg: int) -> DataFrame:
    """Cells of ESRI ASCII grids: row, col, z and the grid of each file.

    A value's cell follows from how many values stand before it, so lines may break anywhere and splits may begin anywhere.
    """
    lines = numbered_lines(spark, path, " ")
    body = _looked_up(lines, ascii_headers(lines), ["path"]).filter((F.col("line") >= F.col("n_header")) & (F.trim("value") != ""))
    cells = body.select("path", "nx", "ny", "res", "left", "top", "nodata", (F.col("token") - 2 * F.col("n_header")).alias("first"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "v"))
    slot, z = F.col("first") + F.col("i"), F.col("v").try_cast("double")
    return cells.select(
        F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1).alias("raster_id"), F.floor(slot / F.col("nx")).cast("bigint").alias("row"), (slot % F.col("nx")).cast("bigint").alias("col"),
        F.when(z != F.col("nodata"), z).alias("z"), "res", "left", "top", F.lit(epsg).alias("epsg")).filter(F.col("z").isNotNull())


# -- stored points and blocks ---------------------------------------------------------------------

def write_points(points: DataFrame, path: str, tile_m: float = 1000.0) -> None:
    """Points by tile, sorted, so windows prune folders and row groups.

    Tasks take ranges of tiles and, in a crowded tile, of y: a tile is a file or a few, however many tasks there are.
    """
    keyed = points.withColumn("tile_x", floor_long(F.col("x") / tile_m)).withColumn("tile_y", floor_long(F.col("y") / tile_m))
    (
        # the source is looked at twice, for the ends of the ranges, which costs less than a file for each strip of a tile
        keyed.repartitionByRange("tile_x", "tile_y", "y").sortWithinPartitions("tile_x", "tile_y", "y", "x")
        .write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)
    )


def read_points(spark: SparkSession, paths: str | Sequence[str], box: Sequence[float] | None = None, tile_m: float = 1000.0) -> DataFrame:
    """Stored points of one or several clouds, only those of a closed box when one is given."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    points = spark.read.parquet(paths[0])
    for other in paths[1:]:
        points = points.unionByName(spark.read.parquet(other), allowMissingColumns=True)
    if box is None:
        return points
    x0, y0, x1, y1 = (float(v) for v in box)
    if {"tile_x", "tile_y"} <= set(points.columns):
        points = points.filter(
            F.col("tile_x").between(int(x0 // tile_m), int(x1 // tile_m)) & F.col("tile_y").between(int(y0 // tile_m), int(y1 // tile_m)))
    return read_window(points, box)


def block_window(blocks: DataFrame, rows: tuple[int, int], cols: tuple[int, int], side: int) -> DataFrame:
    """Blocks that hold any cell of a closed row and column range."""
    return blocks.filter(F.col("brow").between(rows[0] // side, rows[1] // side) & F.col("bcol").between(cols[0] // side, cols[1] // side))


def write_blocks(blocks: DataFrame, path: str, per: int = 4) -> None:
    """Blocks in folders of ``per`` x ``per`` neighbours, ordered, so a window prunes folders, files and row groups."""
    area = [floor_long(F.col(k) / F.lit(per)).alias(n) for k, n in (("brow", "area_row"), ("bcol", "area_col"))]
    keyed = blocks.select("*", *area)
    # a folder is dealt out by rows of blocks, so that a full one is not one task
    keyed.repartition("area_row", "area_col", "brow").sortWithinPartitions("area_row", "area_col", "brow", "bcol").write.mode("overwrite").partitionBy("area_row", "area_col").parquet(path)


def read_blocks(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], side: int, per: int = 4) -> DataFrame:
    """Stored blocks that hold any cell of a closed row and column range; other folders are not opened."""
    stored = spark.read.parquet(path)
    area = side * per
    near = F.col("area_row").between(rows[0] // area, rows[1] // area) & F.col("area_col").between(cols[0] // area, cols[1] // area)
    return block_window(stored.filter(near), rows, cols, side).drop("area_row", "area_col")


def projected_window(lon0: float, lat0: float, lon1: float, lat1: float, transform) -> DataFrame:
    """Window of a geographic box in projected metres, as a bbox column."""
    return geo.bbox_transform_envelope(geo.bbox_lit((lon0, lat0, lon1, lat1)), transform)
