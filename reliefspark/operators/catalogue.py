"""Tile catalogue operators: grids over an area, joins with provider indexes, vintages, priorities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.functions.geo import _c, floor_long

# Countries in display order.
COUNTRY_ORDER = (
    ("fr", "France"), ("gb", "UK"), ("de", "Germany"), ("at", "Austria"), ("nl", "Netherlands"),
    ("ch", "Switzerland"), ("no", "Norway"), ("be", "Belgium"), ("lu", "Luxembourg"), ("fi", "Finland"),
    ("dk", "Denmark"), ("se", "Sweden"), ("ie", "Ireland"), ("cz", "Czechia"), ("si", "Slovenia"),
    ("ee", "Estonia"), ("lv", "Latvia"), ("es", "Spain"), ("pt", "Portugal"), ("it", "Italy"),
    ("pl", "Poland"), ("us", "USA"), ("ca", "Canada"), ("nz", "New Zealand"), ("au", "Australia"),
    ("ph", "Philippines"), ("jp", "Japan"),
)
TILE_NAME_DANGER = r"[/\\:\x00]"


# -- grids over an area ---------------------------------------------------------------------------

def _axis_cells(low: Column, high: Column, step: Column, open_end: bool) -> Column:
    first = floor_long(low / step)
    last = floor_long(high / step)
    if open_end:
        last = F.when((F.pmod(high, step) == 0) & (last > first), last - 1).otherwise(last)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def grid_cells(requests: DataFrame, step_m: float = 1000.0, bbox: str = "bbox", closed: bool = False) -> DataFrame:
    """One row per grid cell (``key_x, key_y``) covering the box of every request row.

    A box that ends exactly on a grid line does not take the cell beyond it, unless ``closed``.
    """
    box, step = F.col(bbox), F.lit(float(step_m))
    return (
        requests
        .withColumn("key_x", F.explode(_axis_cells(box.x0, box.x1, step, not closed)))
        .withColumn("key_y", F.explode(_axis_cells(box.y0, box.y1, step, not closed)))
    )


def mercator_tiles(requests: DataFrame, zoom: int, bbox: str = "bbox") -> DataFrame:
    """Map tiles of one zoom that cover a Web Mercator box, both ends included."""
    box = F.col(bbox)
    step = 2 * geo.MERCATOR_HALF / 2**zoom
    half = F.lit(geo.MERCATOR_HALF)
    return (
        requests
        .withColumn("x", F.explode(F.sequence(floor_long((box.x0 + half) / step), floor_long((box.x1 + half) / step))))
        .withColumn("y", F.explode(F.sequence(floor_long((half - box.y1) / step), floor_long((half - box.y0) / step))))
    )


def clip_to_extent(requests: DataFrame, extent: Sequence[float], bbox: str = "bbox") -> DataFrame:
    """Requests cut to the coverage of a provider; those outside vanish."""
    clipped = geo.bbox_clip(F.col(bbox), geo.bbox_lit(extent))
    return requests.withColumn(bbox, clipped).filter((F.col(bbox).x0 < F.col(bbox).x1) & (F.col(bbox).y0 < F.col(bbox).y1))


# -- names ----------------------------------------------------------------------------------------

def tile_name(prefix, key_x, key_y, suffix: str = ".tif") -> Column:
    return F.concat(_c(prefix), F.lit("_"), _c(key_x).cast("string"), F.lit("_"), _c(key_y).cast("string"), F.lit(suffix))


def service_url(endpoint: str, params: dict[str, Column | str]) -> Column:
    """Query URL: parameters in the given order, values percent-encoded."""
    pairs = [F.concat(F.lit(f"{key}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for key, v in params.items()]
    return F.concat(F.lit(endpoint + "?"), F.concat_ws("&", *pairs))


def name_part(name, pattern: str, group: int = 1) -> Column:
    """Number found in a tile name, NULL when the name does not fit."""
    found = F.regexp_extract(_c(name), pattern, group)
    return F.when(found != "", found).cast("bigint")


def nominal_bounds(key_x, key_y, convention, step_m: float = 1000.0) -> Column:
    """Bounds named by a tile key: ``sw`` keys name the south-west corner, ``top`` keys x and the top edge."""
    x, y = _c(key_x).cast("double"), _c(key_y).cast("double")
    step = F.lit(float(step_m))
    south = F.when(_c(convention) == "top", y - 1.0).otherwise(y)
    return geo.bbox(x * step, south * step, (x + 1.0) * step, (south + 1.0) * step)


def safe_name(name) -> Column:
    """A plain file name: no folder part, no drive, no NUL, not a dot name."""
    name = _c(name)
    return name.isNotNull() & ~name.isin("", ".", "..") & ~name.rlike(TILE_NAME_DANGER)


def request_key(collection, *bbox) -> Column:
    """Cache key of one request: 12 hex digits over collection and box."""
    text = F.concat_ws("|", _c(collection), F.concat_ws(",", *[_c(v).cast("string") for v in bbox]))
    return F.substring(F.md5(text), 1, 12)


# -- joins with an index --------------------------------------------------------------------------

def existing_cells(cells: DataFrame, index: DataFrame, keys: Sequence[str] = ("key_x", "key_y")) -> DataFrame:
    return cells.join(index.select(*keys), list(keys), "left_semi")


def missing_cells(cells: DataFrame, index: DataFrame, keys: Sequence[str] = ("key_x", "key_y")) -> DataFrame:
    return cells.join(index.select(*keys), list(keys), "left_anti")


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    One aggregate over a struct: it combines before the shuffle, so no key has to be collected or
    sorted in one place.  Descending numbers are passed negated.
    """
    others = [c for c in rows.columns if c not in keys]
    ranks = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*ranks, *[F.col(c) for c in others])).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in others])


def latest_vintage(index: DataFrame, keys: Sequence[str] = ("key_x", "key_y"), vintage: str = "vintage",
                   tie: str = "url") -> DataFrame:
    """Newest row per tile; ties go to the smaller ``tie`` value.  ``vintage`` is a number."""
    return best_per_key(index, keys, [-F.col(vintage), F.col(tie)])


def latest_dated(index: DataFrame, keys: Sequence[str], stamp: str, tie: str) -> DataFrame:
    """Newest row per tile for ISO text stamps, which sort as text."""
    others = [c for c in index.columns if c not in keys]
    newest = index.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return best_per_key(index.join(newest, [*keys, stamp], "left_semi").select(*keys, *others), keys, [F.col(tie)])


def union_campaigns(campaigns: Sequence[DataFrame], keys: Sequence[str], tie: str) -> DataFrame:
    """Campaigns in the given order; the first one that delivers a tile wins."""
    ranked = [c.withColumn("campaign", F.lit(i)) for i, c in enumerate(campaigns)]
    union = ranked[0]
    for other in ranked[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    return best_per_key(union, keys, [F.col("campaign"), F.col(tie)])


def priority_cover(cells: DataFrame, index: DataFrame, ref_columns: dict[str, Column]) -> DataFrame:
    """Every cell gets the tile of the first collection that covers it; tiles listed once.

    ``index`` has ``priority, grid, ref, url``; ``ref_columns`` gives the reference of a cell in every
    grid.  Each cell meets one reference per grid, then one aggregate keeps the best priority.
    """
    refs = F.array(*[F.struct(F.lit(g).alias("grid"), c.alias("ref")) for g, c in ref_columns.items()])
    wanted = cells.select("key_x", "key_y", F.inline(refs))
    covered = wanted.join(index, ["grid", "ref"]).select("key_x", "key_y", "priority", "url")
    return best_per_key(covered, ["key_x", "key_y"], [F.col("priority"), F.col("url")])


def bbox_requests(requests: DataFrame, tiles: DataFrame, step_m: float, edges: bool = True) -> DataFrame:
    """Pairs of request and tile whose boxes meet (``request_id, tile_id``).

    Both sides are spread over a grid of ``step_m``; a pair is kept in the one grid cell that holds
    the lower-left corner of the common area, so no pair appears twice and nothing has to be removed.
    """
    def spread(df, side, name):
        box = F.col("bbox")
        return (
            df.select(F.col(side).alias(side), F.col("bbox").alias(name),
                      F.explode(F.sequence(floor_long(box.x0 / step_m), floor_long(box.x1 / step_m))).alias("gx"),
                      box.y0.alias("_y0"), box.y1.alias("_y1"))
            .withColumn("gy", F.explode(F.sequence(floor_long(F.col("_y0") / step_m), floor_long(F.col("_y1") / step_m))))
            .drop("_y0", "_y1")
        )

    left, right = spread(requests, "request_id", "a"), spread(tiles, "tile_id", "b")
    a, b = F.col("a"), F.col("b")
    meet = geo.bbox_touches(a, b) if edges else geo.bbox_overlaps(a, b)
    corner = ((F.col("gx") == floor_long(F.greatest(a.x0, b.x0) / step_m))
              & (F.col("gy") == floor_long(F.greatest(a.y0, b.y0) / step_m)))
    return left.join(right, ["gx", "gy"]).filter(meet & corner).select("request_id", "tile_id")


def index_or_grid(index: DataFrame, cells: DataFrame, read_log: DataFrame, name: Callable[[], Column]) -> DataFrame:
    """Tiles of the index, completed from the plain grid in areas where reading the index failed.

    ``read_log`` has ``area, n_errors, n_found``; an area read without error is taken at its word, so
    an empty one adds nothing.
    """
    failed = read_log.filter(F.col("n_errors") > 0).select("area")
    fallback = (
        cells.join(failed, "area", "left_semi")
        .join(index.select("area", "key_x", "key_y"), ["area", "key_x", "key_y"], "left_anti")
        .select("area", "key_x", "key_y", name().alias("tile_name"), F.lit("grid").alias("origin"))
    )
    return index.select("area", "key_x", "key_y", "tile_name", F.lit("index").alias("origin")).unionByName(fallback)


def sheet_cells(names: DataFrame, origins: DataFrame) -> DataFrame:
    """Cell keys from ``sheet-QQ-CC`` names and one measured point per sheet.

    ``origins`` holds for some named cloud of each sheet its lower-left metres; the sheet origin
    follows from it and serves every cloud of the sheet.
    """
    def parsed(df):
        return (
            df.withColumn("sheet", F.element_at(F.split("name", "-"), 1))
            .withColumn("q_row", F.substring(F.element_at(F.split("name", "-"), 2), 1, 1).cast("int"))
            .withColumn("q_col", F.substring(F.element_at(F.split("name", "-"), 2), 2, 1).cast("int"))
            .withColumn("c_row", F.substring(F.element_at(F.split("name", "-"), 3), 1, 1).cast("int"))
            .withColumn("c_col", F.substring(F.element_at(F.split("name", "-"), 3), 2, 1).cast("int"))
        )

    along = F.col("q_col") * 5 + F.col("c_col") - 1
    up = F.col("q_row") * 5 + F.col("c_row") - 1
    base = parsed(origins).groupBy("sheet").agg(F.min_by(
        F.struct((floor_long(F.col("min_x") / 1000.0) - along).alias("x"),
                 (floor_long(F.col("min_y") / 1000.0) - up).alias("y")), "name").alias("base"))
    return parsed(names).join(base, "sheet").select(
        "name", (F.col("base.x") + along).cast("bigint").alias("key_x"), (F.col("base.y") + up).cast("bigint").alias("key_y"))


# -- choices and summaries ------------------------------------------------------------------------

def dominant(rows: DataFrame, lot: str, value: str) -> DataFrame:
    """Most frequent value of every lot (ties: smallest) and the number of distinct values."""
    counts = rows.groupBy(lot, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(lot).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.count(F.lit(1)).alias("n_values"))


def product_filter(files: DataFrame, keep: Column) -> DataFrame:
    """Per group the number of files kept and dropped by a product predicate."""
    return files.groupBy("group").agg(
        F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_dropped"))


def selection_volume(selection: DataFrame, by: str, megabytes: Column, limit_mb: float) -> DataFrame:
    return selection.groupBy(by).agg(F.sum(megabytes).alias("mb"), F.count(F.lit(1)).alias("n_tiles")).withColumn(
        "too_large", F.col("mb") > F.lit(float(limit_mb)))


def rank_services(candidates: DataFrame) -> DataFrame:
    """One candidate per host: usable ones first, then the finest resolution, then the URL."""
    usable = F.when(F.col("usable"), 0).otherwise(1)
    return best_per_key(candidates, ["host"], [usable, F.col("resolution_m"), F.col("url")])


def display_name(name, resolution_m) -> Column:
    """Provider name, with the resolution appended when the name does not state one."""
    resolution = F.regexp_replace(F.format_string("%.3f", _c(resolution_m).cast("double")), r"\.?0+$", "")
    stated = F.lower(_c(name)).rlike(r"\d[\d.,]*\s?(m|cm)\b")
    return F.when(stated | _c(resolution_m).isNull(), _c(name)).otherwise(
        F.concat(_c(name), F.lit(" ("), resolution, F.lit(" m)")))


def cross_recognised(tiles: DataFrame, providers: DataFrame) -> DataFrame:
    """Tile names a provider other than their owner, in the same country, would take for its own.

    ``tiles``: ``code, country, tile_name``; ``providers``: ``code, country, pattern``.  The patterns
    of a country travel as one short array, so no pairs are formed.
    """
    patterns = providers.groupBy("country").agg(F.collect_list(F.struct("code", "pattern")).alias("patterns"))
    others = F.filter("patterns", lambda p: (p.code != F.col("code")) & F.rlike("tile_name", p.pattern))
    return (
        tiles.join(patterns, "country").withColumn("taken_by", F.transform(others, lambda p: p.code))
        .filter(F.size("taken_by") > 0)
        .select("code", "country", "tile_name", F.concat_ws(",", F.array_sort("taken_by")).alias("taken_by"))
    )


def zoom_request(alias, zoom_min, zoom_max, layers: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the layer alias resolved and the zoom range cut to what the layer offers."""
    return (
        requests.join(layers, requests[alias] == layers["alias"], "left")
        .withColumn("layer", F.coalesce("identifier", requests[alias]))
        .withColumn("z0", F.greatest(F.col(zoom_min), F.coalesce("layer_min", F.lit(0))))
        .withColumn("z1", F.least(F.col(zoom_max), F.coalesce("layer_max", F.lit(22))))
        .drop("alias", "identifier", "layer_min", "layer_max")
    )
