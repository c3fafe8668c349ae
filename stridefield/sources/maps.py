"""Readers and writers of map extracts, sensor counts, points and zones; all read by Spark, none on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "array<struct<_k string, _v string>>"
# The tag keys that are written again
KEPT_TAGS = ("entrance", "building", "highway", "name")


def _tags(tag: Column) -> Column:
    """Tags as a map; of a repeated key the last wins."""
    tag = F.coalesce(tag, F.array().cast(_TAG))
    backwards = F.reverse(F.transform(tag, lambda t: t["_k"]))
    last = F.filter(tag, lambda t, i: F.array_position(backwards, t["_k"]) == F.size(tag) - i)
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))))


def _xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, lat, lon, tags."""
    raw = _xml(spark, path, "node", f"_id long, _lat double, _lon double, tag {_TAG}")
    return raw.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags(F.col("tag")).alias("tags"))


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, node_refs in file order, tags."""
    raw = _xml(spark, path, "way", f"_id long, nd array<struct<_ref long>>, tag {_TAG}")
    refs = F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref long>>")), lambda n: n["_ref"])
    return raw.select(F.col("_id").alias("way_id"), refs.alias("node_refs"), _tags(F.col("tag")).alias("tags"))


def split_osm(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, walkable ways, building ways, and entrance nodes on a building outline."""
    from stridefield.operators import network

    buildings = network.filter_buildings(ways)
    return nodes, network.filter_walkable(ways), buildings, network.building_entrance_nodes(nodes, buildings)


def write_osm(df: DataFrame, path: str, row_tag: str, kept: tuple[str, ...] = KEPT_TAGS) -> None:
    """Nodes or ways as map XML with the kept tags."""
    entries = F.filter(F.map_entries("tags"), lambda e: e["key"].isin(*kept))
    tag = F.transform(entries, lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag")
    if row_tag == "node":
        out = df.select(F.col("node_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tag)
    else:
        out = df.select(F.col("way_id").alias("_id"), F.transform("node_refs", lambda r: F.struct(r.alias("_ref"))).alias("nd"), tag)
    out.write.format("xml").option("rowTag", row_tag).option("rootTag", "osm").save(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Date, Time, Count as strings; title lines stay and are dropped by ``temporal.clean_counts``."""
    return spark.read.schema("Date string, Time string, Count string").csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """lat, long of a file without a header."""
    return spark.read.schema("lat double, long double").option("ignoreLeadingWhiteSpace", True).csv(path)


def _ring(flat: Column, first: str, second: str) -> Column:
    pairs = F.floor(F.size(flat) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(F.get(flat, 2 * i).alias(first), F.get(flat, 2 * i + 1).alias(second)))


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """zone (the line), ring: each line a flat list lat,lon,...; lines of fewer than three points are left out."""
    flat = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    lines = spark.read.text(path).select(F.col("value").alias("zone"), flat.alias("flat")).filter(F.size("flat") >= 6)
    return lines.select("zone", _ring(F.col("flat"), "lat", "lon").alias("ring"))


def read_zone_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings (lat, lon) of the Polygon features of GeoJSON files; positions are [lon, lat]."""
    # coordinates differ in depth by type: read as text, parse those of polygons
    raw = spark.read.schema("features array<struct<geometry struct<type string, coordinates string>>>").option("multiLine", True).json(path)
    shapes = raw.select(F.explode("features.geometry").alias("g")).filter("g.type = 'Polygon'")
    rings = shapes.select(F.from_json("g.coordinates", "array<array<array<double>>>")[0].alias("r"))
    return rings.select(F.transform("r", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))).alias("ring"))


def save_network(nodes: DataFrame, arcs: DataFrame, path: str, buckets: int = 0) -> None:
    """Both tables as Parquet below ``path``; arcs in buckets of ``src``, sorted by it, so that joins and groups by a node find its arcs in place.

    One shuffle of the arcs by src, here and never again. ``buckets`` is the number of shuffle partitions by default.
    """
    spark = arcs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes.write.parquet(f"{path}/nodes")
    name = f"saved_{uuid.uuid4().hex}"
    arcs.repartition(n, "src").write.option("path", f"{path}/arcs").bucketBy(n, "src").sortBy("src").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are at a path of their own
    spark.range(1).select(F.lit(n).alias("buckets")).write.parquet(f"{path}/layout")


def load_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and arcs; the arcs with the buckets they were saved in. One row, the layout, comes to the driver."""
    n = spark.read.parquet(f"{path}/layout").first()[0]
    name = f"network_{uuid.uuid4().hex}"
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/arcs").schema.fields)
    spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY (src) SORTED BY (src) INTO {n} BUCKETS LOCATION '{path}/arcs'")
    return spark.read.parquet(f"{path}/nodes"), spark.table(name)


def write_profile(profile: DataFrame, path: str) -> None:
    """The pivoted weekday profile as CSV with a header."""
    profile.write.option("header", True).csv(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """slot, weekday, avg_count from the pivoted CSV."""
    days = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
    wide = spark.read.schema("Time string, " + ", ".join(f"{d} double" for d in days)).option("header", True).csv(path)
    return wide.unpivot("Time", days, "weekday", "avg_count").withColumnRenamed("Time", "slot")


def write_vector(vector: DataFrame, path: str) -> None:
    """state, value as lines ``state (re+0j)``."""
    vector.select(F.format_string("%d (%s+0j)", F.col("state"), F.col("value").cast("string"))).write.text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """state, value from lines as :func:`write_vector` writes them."""
    found = lambda k: F.regexp_extract("value", r"^(\d+) \((-?[0-9.]+(?:[eE][+-]?\d+)?)", k)
    return spark.read.text(path).select(found(1).cast("int").alias("state"), found(2).cast("double").alias("value"))
