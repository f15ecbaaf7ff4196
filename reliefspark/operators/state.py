"""Run state as tables: chunks of an area, manifests, freshness, clean-up plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.functions.geo import _c


def chunk_key(row, col) -> Column:
    return F.format_string("%03dx%03d", _c(row).cast("int") + 1, _c(col).cast("int") + 1)


def split_area(areas: DataFrame, n_cols: Column | int = 0, n_rows: Column | int = 0, side_m: float = 0.0,
               bbox: str = "bbox") -> DataFrame:
    """Chunks of every area by a positive side length, else by columns and rows.

    Chunks of a given side keep it (the last may reach beyond the area); a grid divides the area evenly.
    """
    box = F.col(bbox)
    if side_m > 0:
        nx = F.greatest(F.lit(1), F.ceil((box.x1 - box.x0) / float(side_m)).cast("int"))
        ny = F.greatest(F.lit(1), F.ceil((box.y1 - box.y0) / float(side_m)).cast("int"))
        dx = dy = F.lit(float(side_m))
    else:
        nx, ny = _c(n_cols).cast("int"), _c(n_rows).cast("int")
        dx, dy = (box.x1 - box.x0) / nx.cast("double"), (box.y1 - box.y0) / ny.cast("double")
    chunks = (
        areas.withColumn("chunk_row", F.explode(F.sequence(F.lit(0), ny - 1)))
        .withColumn("chunk_col", F.explode(F.sequence(F.lit(0), nx - 1)))
    )
    row, col = F.col("chunk_row").cast("double"), F.col("chunk_col").cast("double")
    return chunks.withColumn("chunk", chunk_key("chunk_row", "chunk_col")).withColumn(
        "chunk_box", geo.bbox(box.x0 + col * dx, box.y0 + row * dy, box.x0 + (col + 1.0) * dx, box.y0 + (row + 1.0) * dy))


def area_block(areas: DataFrame, block: Column, of: int, bbox: str = "bbox") -> DataFrame:
    """Block i of M (counted from 1): vertical strips that cover the area once."""
    box = F.col(bbox)
    width = (box.x1 - box.x0) / F.lit(float(of))
    return areas.withColumn("block", block).filter(F.col("block").between(1, of)).withColumn(
        bbox, geo.bbox(box.x0 + (F.col("block") - 1) * width, box.y0, box.x0 + F.col("block") * width, box.y1))


def pending_chunks(chunks: DataFrame, manifest: DataFrame, overwrite: bool = False) -> DataFrame:
    """Chunks still to do; ``overwrite`` takes them all."""
    if overwrite:
        return chunks
    return chunks.join(manifest.filter("done").select("chunk"), "chunk", "left_anti")


def chunk_outcome(chunks: DataFrame, deliverables: DataFrame) -> DataFrame:
    """Marks chunks done: a complete deliverable exists, or there was nothing to cover.

    ``chunks``: ``chunk, n_sources``; ``deliverables``: ``chunk, requested, complete``.  A deliverable
    that was not asked for does not count.
    """
    ready = deliverables.filter("requested").groupBy("chunk").agg(F.bool_and("complete").alias("complete"))
    return chunks.join(ready, "chunk", "left").select(
        "chunk", "n_sources",
        F.when(F.col("n_sources") == 0, "empty").when(F.coalesce("complete", F.lit(False)), "done").otherwise("open").alias("outcome"),
        ((F.col("n_sources") == 0) | F.coalesce("complete", F.lit(False))).alias("done"))


def next_manifest(manifest: DataFrame, outcome: DataFrame) -> DataFrame:
    """Manifest after a run: the outcome replaces earlier lines of its chunks."""
    kept = manifest.join(outcome.select("chunk"), "chunk", "left_anti").select("chunk", "done")
    return kept.unionByName(outcome.select("chunk", "done"))


def config_signature(settings: Sequence[Column], tags: Column, origin_x, origin_y, step) -> Column:
    """Digest of a configuration: settings, tags in any order, grid origin and step, not its extent."""
    parts = [F.coalesce(s.cast("string"), F.lit("-")) for s in settings]
    text = F.concat_ws("|", *parts, F.concat_ws(",", F.array_sort(tags)),
                       _c(origin_x).cast("string"), _c(origin_y).cast("string"), _c(step).cast("string"))
    return F.sha2(text, 256)


def valid_manifest(manifest: DataFrame, signatures: DataFrame) -> DataFrame:
    """Manifest lines made under the current signature of their run; a change empties the rest."""
    return manifest.join(signatures.select("run", "signature"), ["run", "signature"], "left_semi")


def stale_products(products: DataFrame, sources: DataFrame) -> DataFrame:
    """Why each source needs its product made again, NULL when the product is good.

    ``products``: ``key, n_tiles, readable, modified``; ``sources``: ``key, modified``.
    """
    p = products.select("key", "n_tiles", "readable", F.col("modified").alias("made"))
    return sources.join(p, "key", "left").withColumn(
        "reason",
        F.when(F.col("made").isNull(), "missing").when(~F.col("readable"), "unreadable")
        .when(F.col("n_tiles") == 0, "empty").when(F.col("modified") > F.col("made"), "outdated"))


def cached_fragments(requests: DataFrame, fragments: DataFrame) -> DataFrame:
    """Requests that a cached fragment of the same file covers completely."""
    return requests.join(
        fragments.select("file", F.col("bbox").alias("have")), "file"
    ).filter(geo.bbox_covers(F.col("have"), F.col("bbox"))).drop("have")


def cleanup_plan(files: DataFrame, kept_folders: Sequence[str] = ()) -> DataFrame:
    """Files of a finished chunk to delete: not in a kept folder, not needed by the next chunk.

    ``files``: ``chunk_no, file, folder``.  The look-ahead is a join on the next number, so chunks are
    not ordered in one place.
    """
    wanted_next = files.select((F.col("chunk_no") - 1).alias("chunk_no"), "file").distinct()
    plan = files.join(wanted_next, ["chunk_no", "file"], "left_anti")
    return plan.filter(~F.col("folder").isin(*kept_folders)) if kept_folders else plan


def purge_small(files: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cached tiles smaller than the validity threshold of their provider."""
    return files.join(thresholds, "code").filter(F.col("length") < F.col("min_length")).drop("min_length")


def purge_outside(files: DataFrame, zone: DataFrame, pattern: str) -> DataFrame:
    """Cached tiles a provider recognises as its own that the zone list does not name."""
    return files.filter(F.col("tile_name").rlike(pattern)).join(zone.select("tile_name"), "tile_name", "left_anti")
