"""Index documents of tile providers: GeoJSON, GML, STAC, Atom, Metalink, JSON lists, listings.

Every source is a pair: ``read_*`` scans landed files, ``*_rows`` turns scanned records into catalogue
rows.  The second half works on any DataFrame of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions import geom
from reliefspark.functions.geo import _c, floor_long
from reliefspark.operators.catalogue import best_per_key

FEATURE_SCHEMA = (
    "features array<struct<id string, bbox array<double>, geometry struct<type string, coordinates string>, "
    "properties map<string,string>, attributes map<string,string>, assets map<string,struct<href string, type string>>>>")
FILE_LIST_SCHEMA = "datasets array<struct<name string, files array<struct<name string, size bigint>>>>"
ATOM_SCHEMA = "id string, title string, link array<struct<_href string, _type string, _rel string>>"

# Name patterns of published indexes.
IGN_NAME = r"LHD_[A-Z0-9]+_(\d+)_(\d+)_"
METALINK_NAME = r'name="(\d+)_(\d+)\.tif"'
LAS_LIST_NAME = r"/las/\d+/(\d+-\d+-\d+)\.las"


def read_documents(spark: SparkSession, path: str, schema: str = FEATURE_SCHEMA) -> DataFrame:
    """One row per JSON document, the file kept; a damaged document fails the scan."""
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def features_of(documents: DataFrame) -> DataFrame:
    """One row per feature of ``features`` documents."""
    others = [c for c in documents.columns if c != "features"]
    return documents.select(*others, F.inline("features"))


# -- S01, S07, S10: feature collections -----------------------------------------------------------

def geojson_index_rows(documents: DataFrame, epsg: int, pattern: str = IGN_NAME) -> DataFrame:
    """Tiles named in feature properties, of one coordinate system: ``key_x, key_y, url``."""
    f = features_of(documents)
    p = F.col("properties")
    name = F.coalesce(p["name_download"], p["name"], F.lit(""))
    # the pattern must match at the start of the name
    key = [F.regexp_extract(name, f"^{pattern}", i) for i in (1, 2)]
    return f.filter(p["url"].isNotNull() & (F.upper(p["projection"]) == f"EPSG:{epsg}")).select(
        key[0].alias("a"), key[1].alias("b"), p["url"].alias("url")).filter("a <> ''").select(
        F.col("a").cast("bigint").alias("key_x"), F.col("b").cast("bigint").alias("key_y"), "url")


def attribute_rows(documents: DataFrame, names: Sequence[str], url_fields: Sequence[str]) -> DataFrame:
    """Named attributes and the first non-empty URL among candidate fields."""
    f = features_of(documents)
    a = F.col("attributes")
    url = F.coalesce(*[F.when(F.trim(a[u]) != "", a[u]) for u in url_fields])
    return f.select(*[a[n].alias(n) for n in names], url.alias("url")).filter(F.col("url").isNotNull())


def sheet_polygon_rows(documents: DataFrame, number: str, year_fields: Sequence[str], step_m: float = 1000.0) -> DataFrame:
    """Index polygons with yearly columns: number, latest year, cell key and box.  Sheets without a year drop out."""
    f = features_of(documents)
    p = F.col("properties")
    years = [p[y].try_cast("int") for y in year_fields]
    return (
        f.select(p[number].alias("number"), F.greatest(*years).alias("year"), geom.coordinates_bbox("geometry.coordinates").alias("bbox"))
        .filter(F.col("number").isNotNull() & F.col("year").isNotNull() & F.col("bbox.x0").isNotNull())
        .select("number", "year", floor_long(F.col("bbox.x0") / step_m).alias("key_x"), floor_long(F.col("bbox.y0") / step_m).alias("key_y"), "bbox")
    )


# -- S02: repeated XML members --------------------------------------------------------------------

def read_members(spark: SparkSession, path: str, end_tag: str = "</wfs:member>") -> DataFrame:
    """One row per member: the closing tag is the record separator, so large files still split."""
    return spark.read.option("lineSep", end_tag).text(path).withColumn("file", F.col("_metadata.file_path"))


def gml_index_rows(members: DataFrame, year: Column, url_tag: str = "url_do_pobrania") -> DataFrame:
    """Download link and lower corner of every member, newest year per corner."""
    url = F.trim(F.regexp_extract("value", rf":{url_tag}>([^<]+)</", 1))
    corner = F.split(F.trim(F.regexp_extract("value", r"lowerCorner>([^<]+)</", 1)), r"\s+")

    def whole(i):
        return F.get(corner, F.lit(i)).try_cast("double").cast("bigint")

    rows = members.select(whole(0).alias("x"), whole(1).alias("y"), year.alias("year"), url.alias("url")).filter(
        "url <> '' and x is not null and y is not null")
    return best_per_key(rows, ["x", "y"], [-F.col("year"), F.col("url")])


# -- S03: STAC items ------------------------------------------------------------------------------

def stac_asset_rows(documents: DataFrame, wanted: Callable[[Column, Column], Column], pattern: str) -> DataFrame:
    """Wanted assets with the numbers named in asset or item (year, x, y), newest year per tile."""
    assets = features_of(documents).select("id", F.explode("assets").alias("asset", "a")).filter(
        wanted(F.col("asset"), F.col("a")) & F.col("a.href").isNotNull())
    source = F.when(F.col("asset").rlike(pattern), F.col("asset")).otherwise(F.col("id"))
    parts = [F.regexp_extract(source, pattern, i) for i in (1, 2, 3)]
    rows = assets.select(*[p.alias(n) for p, n in zip(parts, ("year", "key_x", "key_y"))], "asset", F.col("a.href").alias("url")).filter("year <> ''")
    rows = rows.select(*[F.col(n).cast("bigint").alias(n) for n in ("key_x", "key_y", "year")], "asset", "url")
    return best_per_key(rows, ["key_x", "key_y"], [-F.col("year"), F.col("asset")])


# -- S04: Atom feeds ------------------------------------------------------------------------------

def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path).withColumn(
        "feed", F.col("_metadata.file_path"))


def atom_links(entries: DataFrame, link_type: str) -> DataFrame:
    """First link of a type per entry."""
    link = F.filter("link", lambda x: F.coalesce(x["_type"], F.lit("")).contains(link_type))
    return entries.select("feed", "title", F.get(link, F.lit(0))["_href"].alias("href")).filter(F.col("href").isNotNull())


def atom_index_rows(service: DataFrame, datasets: DataFrame, pattern: str, file_type: str = "image/tiff",
                    feed_type: str = "atom+xml") -> DataFrame:
    """Two levels: dataset feeds named in the service feed, joined to the files the dataset feeds offer."""
    key = F.regexp_extract("title", pattern, 1)
    level1 = atom_links(service, feed_type).select(key.alias("key"), F.col("href").alias("feed")).filter("key <> ''")
    level2 = atom_links(datasets, file_type).select("feed", F.col("href").alias("url"))
    return level1.join(level2, "feed").select("key", "url")


# -- S05, S06, S08, S09: text lists ---------------------------------------------------------------

def name_keys(lines: DataFrame, pattern: str = METALINK_NAME) -> DataFrame:
    """Distinct numeric keys of every name found in text (Metalink and the like)."""
    found = F.regexp_extract_all("value", F.lit(pattern), 0)
    return lines.select(F.explode(found).alias("name")).select(
        F.regexp_extract("name", pattern, 1).cast("bigint").alias("key_x"),
        F.regexp_extract("name", pattern, 2).cast("bigint").alias("key_y")).distinct()


def file_list_rows(documents: DataFrame, pattern: str) -> DataFrame:
    """Keys from the file names of ``datasets[].files[]`` documents."""
    files = documents.select(F.explode("datasets").alias("d")).select(F.explode("d.files").alias("f"))
    return files.select(
        F.col("f.name").alias("name"), F.regexp_extract("f.name", pattern, 1).alias("a"), F.regexp_extract("f.name", pattern, 2).alias("b"),
        F.col("f.size").alias("size")).filter("a <> ''").select(
        "name", F.col("a").cast("bigint").alias("key_x"), F.col("b").cast("bigint").alias("key_y"), "size")


def listing_rows(keys: DataFrame, base_url: str) -> DataFrame:
    """Grid reference and URL of object keys: the reference leads the file name."""
    file = F.element_at(F.split("value", "/"), -1)
    return keys.select(F.element_at(F.split(file, "_"), 1).alias("ref"), F.concat(F.lit(base_url + "/"), F.col("value")).alias("url"))


def cloud_name_rows(lines: DataFrame) -> DataFrame:
    """Cloud names ``sheet-QQ-CC`` found in a link list."""
    name = F.regexp_extract("value", LAS_LIST_NAME, 1)
    return lines.select(name.alias("name"), F.element_at(F.split(name, "-"), 1).alias("sheet")).filter("name <> ''").distinct()


def read_document_lines(spark: SparkSession, path: str, schema: str = FEATURE_SCHEMA) -> DataFrame:
    """Files with one JSON document per line, the file kept; large files are read in splits."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path"))


def parsed_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents from a text column, as ``read_documents`` gives them from files."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.from_json(_c(column), schema, {"mode": "FAILFAST"}).alias("d")).select(*others, "d.*")
