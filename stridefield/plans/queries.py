"""Registered queries of the wayfinding operators, over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import network


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS node_id",
        "-121.762e0 + ((p_partkey * 7919) % 10007) / 10007e0 * 0.017e0 AS lon",
        "38.534e0 + ((p_partkey * 104729) % 10009) / 10009e0 * 0.0125e0 AS lat",
    )


#: The node a line refers to; some refer to one that doesn't exist.
REF = "l_partkey + CASE WHEN l_partkey % 97 = 0 THEN 1000000000 ELSE 0 END"


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    # a reference follows from the part, so it needn't be shuffled
    ways = lines.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.sort_array(F.collect_list(key)).alias("_lines"))
    return ways.select("way_id", F.expr(f"transform(_lines, x -> {REF.replace('l_partkey', 'x.l_partkey')})").alias("node_refs"))


NODES_SQL = """nodes AS (SELECT p_partkey AS node_id,
  -121.762e0 + ((p_partkey * 7919) % 10007) / 10007e0 * 0.017e0 AS lon,
  38.534e0 + ((p_partkey * 104729) % 10009) / 10009e0 * 0.0125e0 AS lat FROM part)"""
SEGMENTS_SQL = f"""seg AS (SELECT * FROM (SELECT l_orderkey AS way_id, {REF} AS src,
  row_number() OVER w - 1 AS pos, lead({REF}) OVER w AS dst FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) WHERE dst IS NOT NULL)"""
EDGES_SQL = f"""WITH {NODES_SQL}, {SEGMENTS_SQL},
r AS (SELECT seg.*, 2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) / 1.4e0 AS w
  FROM seg JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id),
e AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(w, {{'a': way_id, 'b': pos}}) AS w FROM r GROUP BY ALL)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = network.way_segments(_ways(spark, sf_dir))
    return network.distinct_edges(network.baseline_weights(network.resolve_segments(segments, _nodes(spark, sf_dir))))


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to segments, ends, walking times, distinct undirected edges."""
    return _edges(spark, sf_dir).select("lo", "hi", F.round("baseline_weight", 4).alias("baseline_weight"))


def way_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.way_segments(_ways(spark, sf_dir)).select("way_id", F.col("pos").cast("long"), "src", "dst")


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and least walking time of every node over both directions of the edges."""
    arcs = network.undirected_arcs(_edges(spark, sf_dir))
    return arcs.groupBy("src").agg(F.count("*").alias("degree"), F.round(F.min("baseline_weight"), 4).alias("nearest"))


def weekday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.round(F.col("value") * 10000).cast("long").alias("count"))
    return network.weekday_profile(readings).select("weekday", "slot", F.round(F.col("avg_count") / 10000, 4).alias("avg_count"))


def travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return edges.select("lo", "hi", scalars.format_travel_time(F.round("baseline_weight", 4)).alias("said"))


QUERIES = {
    "network_edges": network_edges,
    "way_segments": way_segment_counts,
    "node_degrees": node_degrees,
    "weekday_profile": weekday_profile,
    "travel_times": travel_times,
}
ORACLES = {
    "network_edges": EDGES_SQL + "SELECT lo, hi, round(w, 4) AS baseline_weight FROM e",
    "way_segments": f"WITH {SEGMENTS_SQL} SELECT way_id, pos, src, dst FROM seg",
    "node_degrees": EDGES_SQL + """SELECT src, count(*) AS degree, round(min(w), 4) AS nearest FROM
  (SELECT lo AS src, w FROM e UNION ALL SELECT hi, w FROM e) GROUP BY src""",
    "weekday_profile": """SELECT dayname(ts) AS weekday, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M:%S') AS slot,
  round(avg(CAST(round(value * 10000) AS BIGINT)) / 10000, 4) AS avg_count FROM events GROUP BY ALL""",
    "travel_times": EDGES_SQL + """SELECT lo, hi, CASE WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || ' min ' ELSE '' END
  || CAST(s % 60 AS VARCHAR) || ' sec' AS said FROM (SELECT lo, hi, CAST(floor(round(w, 4)) AS BIGINT) AS s FROM e)""",
}
