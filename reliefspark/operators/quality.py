"""Coverage and quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefspark.functions.geo import _c
from reliefspark.session import staging_folder

# Error texts that mean the network failed, coordinate systems without ground metres.
TRANSPORT_ERRORS = (
    "TimeoutError|URLError|RemoteDisconnected|HTTPError|ConnectionError|ConnectionResetError|"
    "IncompleteRead|RasterioIOError|socket.timeout")
NOT_METRIC_EPSG = (3857, 4326)
# How covered regions are drawn.
FILL_OPACITY, STROKE_WIDTH = 0.35, 1.5


def coverage_map(regions: DataFrame, providers: DataFrame) -> DataFrame:
    """Title and point-cloud flag per region.

    ``regions``: ``region, label, codes`` (array, ordered); ``providers``: ``code, name``.  A region has
    point clouds when one of its codes is a cloud code or has a ``-laz`` twin.  Regions with a ``color`` also get
    ``shown_as``, what a map viewer needs: label, description, fill and stroke.
    """
    one = regions.select("region", "label", F.posexplode("codes").alias("pos", "code"))
    twins = providers.filter(F.col("code").endswith("-laz")).select(
        F.regexp_replace("code", "-laz$", "").alias("code"), F.lit(True).alias("twin")).distinct()
    joined = one.join(providers.select("code", "name"), "code").join(twins, "code", "left")
    named = joined.groupBy("region").agg(
        F.max("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("pos", "name", "code"))).alias("list"),
        F.bool_or(F.coalesce("twin", F.lit(False)) | F.col("code").endswith("-laz")).alias("has_cloud"),
    )
    codes = F.transform("list", lambda p: p["code"])
    columns = ["region", F.coalesce("label", F.concat_ws(" + ", F.transform("list", lambda p: p["name"]))).alias("title"), F.concat_ws(",", codes).alias("codes"), "has_cloud"]
    if "color" not in regions.columns:
        return named.select(*columns)
    shown_as = F.struct(
        F.coalesce("label", F.col("region").cast("string")).alias("label"), F.concat(F.lit("Provider(s) : "), F.concat_ws(", ", codes)).alias("description"),
        F.col("color").alias("fill"), F.lit(FILL_OPACITY).alias("fill_opacity"), F.col("color").alias("stroke"), F.lit(STROKE_WIDTH).alias("stroke_width"))
    return named.join(regions.select("region", "color"), "region").select(*columns, shown_as.alias("shown_as"))


def codes_without_provider(regions: DataFrame, providers: DataFrame) -> DataFrame:
    return regions.select(F.explode("codes").alias("code")).distinct().join(providers.select("code"), "code", "left_anti")


def countries_without_name(providers: DataFrame, names: DataFrame) -> DataFrame:
    return providers.filter(F.col("country") != "").select("country").distinct().join(
        names.select("country"), "country", "left_anti")


def require_empty(violations: DataFrame, what: str) -> DataFrame:
    """Fails as soon as one violation exists; yields nothing otherwise."""
    return violations.filter(F.raise_error(F.concat(F.lit(f"{what}: "), F.to_json(F.struct("*")))).cast("boolean"))


def country_count(providers: DataFrame) -> DataFrame:
    return providers.filter(F.col("country") != "").agg(F.count_distinct("country").alias("n_countries"))


def storage_by_tier(files: DataFrame) -> DataFrame:
    return files.groupBy("tier").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def tile_check(tiles: DataFrame, declared: DataFrame) -> DataFrame:
    """Verdict per tile: any valid cell, a coordinate system, pixel size within 10 % of the declared.

    ``tiles``: ``tile, code, epsg, pixel, z``; ``declared``: ``code, native_epsg, resolution_m``.  The
    pixel size counts only in the native metric system.
    """
    facts = tiles.groupBy("tile", "code").agg(
        F.max("epsg").alias("epsg"), F.max("pixel").alias("pixel"), F.count("z").alias("n_valid"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    off = F.abs(F.col("pixel") - F.col("resolution_m")) > F.col("resolution_m") * 0.1
    comparable = (F.col("epsg") == F.col("native_epsg")) & ~F.col("epsg").isin(*NOT_METRIC_EPSG)
    return facts.join(declared, "code").withColumn(
        "verdict",
        F.when(F.col("n_valid") == 0, "no valid cell").when(F.col("epsg").isNull(), "no crs")
        .when(comparable & off, "wrong resolution").otherwise("pass")).drop("native_epsg", "resolution_m")


def is_transport_error(detail) -> Column:
    detail = _c(detail)
    return detail.startswith("discover -> None") | detail.startswith("download=erreur") | detail.rlike(TRANSPORT_ERRORS)


def status_summary(results: DataFrame) -> DataFrame:
    """Count per status and how many failures are worth another try."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("status") == "FAIL") & is_transport_error("detail")).alias("n_retry"))


def exact_percentiles(counts: DataFrame, shares: dict[str, float], group: str, buckets: int = 1024) -> DataFrame:
    """Percentiles of whole numbers ``step`` that occur ``n`` times, interpolated: the group and a column per share.

    The two ranks that a share lies between are looked for in rounds.  A round counts what falls into each of ``buckets``
    equal parts of the range that is left for a rank and goes on in the part that holds it, so after a few rounds the part is
    one number.  No task ever sees more than ``buckets`` rows of a rank, however many different numbers there are.
    ``counts`` is read once a round: give a stored table.
    """
    spark = counts.sparkSession
    limits = counts.groupBy(group).agg(F.min("step").alias("low"), F.max("step").alias("high"), F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), (F.lit(float(p)) * (F.col("total") - 1)).alias("rank")) for name, p in shares.items()])).alias("w")
    ends = F.explode(F.array(F.floor("w.rank"), F.ceil("w.rank"))).alias("rank")
    found = limits.select(group, "low", "high", "total", wanted).select(group, F.col("w.share").alias("share"), F.col("w.rank").alias("exact"), "low", "high", ends)
    found = found.distinct().withColumn("before", F.lit(0).cast("bigint"))
    width = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(buckets)).cast("bigint")
    keys = [group, "share", "exact", "rank"]
    while True:
        folder = staging_folder(spark, "ranks")
        found.write.parquet(folder)
        found = spark.read.schema(found.schema).parquet(folder)
        widest = found.agg(F.max(F.col("high") - F.col("low"))).first()[0]
        if not widest:
            break
        inside = counts.join(found, group).filter(F.col("step").between(F.col("low"), F.col("high")))
        parts = inside.groupBy(*keys, "low", "high", "before", F.floor((F.col("step") - F.col("low")) / width).cast("bigint").alias("part")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("part"))
        parts = parts.withColumn("upto", F.col("before") + upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        start = F.col("low") + F.col("part") * width
        found = parts.select(*keys, start.alias("low"), F.least("high", start + width - 1).alias("high"), (F.col("upto") - F.col("n")).cast("bigint").alias("before"))
        found = found.select(group, "share", "exact", "low", "high", "rank", "before")
    values = found.groupBy(group, "share", "exact").agg(F.min("low").alias("a"), F.max("low").alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("exact") - F.floor("exact"))
    return values.groupBy(group).agg(*[F.max(F.when(F.col("share") == name, value)).alias(name) for name in shares])


def raster_difference(first: DataFrame, second: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Mean and 95th percentile of the absolute difference of two rasters on the same cells, rounded to ``digits``."""
    scale = float(10**digits)
    spark = first.sparkSession
    steps = (
        first.select("raster_id", "row", "col", F.col(value).alias("a"))
        .join(second.select("raster_id", "row", "col", F.col(value).alias("b")), ["raster_id", "row", "col"])
        .groupBy(F.floor(F.abs(F.col("a") - F.col("b")) * scale + 0.5).cast("bigint").alias("step"))
        .agg(F.count(F.lit(1)).alias("n")).filter("step is not null")
    )
    folder = staging_folder(spark, "differences")
    steps.write.parquet(folder)
    steps = spark.read.schema(steps.schema).parquet(folder).withColumn("all", F.lit(0))
    mean = steps.groupBy("all").agg(F.sum("n").alias("n_cells"), (F.sum(F.col("step") * F.col("n")) / F.sum("n") / scale).alias("mean_abs"))
    high = exact_percentiles(steps, {"p95": 0.95}, "all")
    return mean.join(high, "all", "left").select("n_cells", "mean_abs", (F.col("p95") / scale).alias("p95_abs"))
