"""Vector sources: GeoJSON features, map-object XML, projected layers, existing tile sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions import geo
from reliefspark.functions.geo import _c
from reliefspark.sources.indexes import FEATURE_SCHEMA, features_of, read_documents

NODE_SCHEMA = "_id bigint, _lat double, _lon double, tag array<struct<_k string, _v string>>"
LINE_SCHEMA = "type string, geometry struct<type string, coordinates string>, properties map<string,string>"
WAY_SCHEMA = "_id bigint, nd array<struct<_ref bigint>>, tag array<struct<_k string, _v string>>"


def parts_of(kind, coordinates) -> Column:
    """Geometry parts of GeoJSON coordinates text, each an array of rings of vertices.

    A polygon is one part with its rings, a line or point one part with one ring; a Multi* geometry has a part for
    each member.  An unknown or missing kind has no parts.
    """
    kind, text = _c(kind), _c(coordinates)

    def parsed(depth: int) -> Column:
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    def ring(line: Column) -> Column:
        return F.transform(line, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))

    one, many = F.array, F.transform
    return (
        F.when(kind == "Point", one(one(ring(one(parsed(1))))))
        .when(kind == "MultiPoint", many(parsed(2), lambda v: one(ring(one(v)))))
        .when(kind == "LineString", one(one(ring(parsed(2)))))
        .when(kind == "MultiLineString", many(parsed(3), lambda line: one(ring(line))))
        .when(kind == "Polygon", one(many(parsed(3), ring)))
        .when(kind == "MultiPolygon", many(parsed(4), lambda rings: many(rings, ring))))


def rings_of(kind, coordinates) -> Column:
    """All rings of a geometry, whatever part they belong to."""
    return F.flatten(parts_of(kind, coordinates))


def _part_rows(f: DataFrame, source: Column) -> DataFrame:
    kind = F.regexp_replace("geometry.type", "^Multi", "")
    return f.select(
        source.alias("source"), kind.alias("kind"), F.posexplode(parts_of("geometry.type", "geometry.coordinates")).alias("part", "rings"), F.col("properties").alias("props"))


def feature_rows(documents: DataFrame) -> DataFrame:
    """Features ``source, kind, part, rings, props`` of feature-collection documents with a ``file`` column.

    Multi* geometries give one row per part, numbered by ``part``.
    """
    return _part_rows(features_of(documents), F.element_at(F.split("file", "/"), -1))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON collections, plain or gzip, also a glob of them; damaged or missing input fails the scan.

    So does a document without ``features``: files with one feature per line are for ``read_feature_lines``.
    """
    documents = read_documents(spark, path, FEATURE_SCHEMA)
    known = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("no feature collection: "), F.col("file"))))
    return feature_rows(documents.withColumn("features", known))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with one GeoJSON feature per line, as the sink writes them; large files are read in splits."""
    lines = spark.read.schema(LINE_SCHEMA).option("mode", "FAILFAST").json(path)
    return _part_rows(lines, F.element_at(F.split("_metadata.file_path", "/"), -1))


def read_map_objects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``nodes, way_nodes, tags`` of a map extract in XML."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(WAY_SCHEMA).load(path)

    def tags(df, kind):
        return df.select(F.concat(F.lit(kind), F.col("_id").cast("string")).alias("object_id"), F.explode("tag").alias("t")).select(
            "object_id", F.col("t._k").alias("key"), F.col("t._v").alias("value"))

    return {
        "nodes": nodes.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat")),
        "way_nodes": ways.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "n")).select(
            "way_id", "pos", F.col("n._ref").alias("node_id")),
        "tags": tags(nodes, "n").unionByName(tags(ways, "w")),
    }


def to_lonlat(features: DataFrame, transform=geo.lonlat_from_lambert93) -> DataFrame:
    """Rings of a projected layer as longitude and latitude."""
    def vertex(p):
        t = transform(p.x, p.y)
        return F.struct(t["lon"].alias("x"), t["lat"].alias("y"))

    return features.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, vertex)))


def read_layer(features: DataFrame, layer: str, transform=geo.lonlat_from_lambert93) -> DataFrame:
    """One layer of a landed package, moved to longitude and latitude."""
    return to_lonlat(features.filter(F.col("layer") == layer), transform)


def read_tile_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tiles and metadata of a stored set."""
    return spark.read.parquet(f"{path}/tiles"), spark.read.parquet(f"{path}/metadata")
