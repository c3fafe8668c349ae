"""Registered queries of readers, tags, scalar formulas and matrices, over tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import geometry, network, pixels, routes, spatial, temporal, weights
from stridefield.operators.lineage import Scratch, cut
from stridefield.plans.queries import EDGES_SQL, NODES_SQL, REF, SEGMENTS_SQL, _edges, _nodes, _ways
from stridefield.plans.wayfinding import (
    BOUNDS, GRID_SQL, PIXELS_SQL, QUADS_SQL, R_SQL, WEIGHTS_SQL, _at, _columns, _guests, _pixels, _polygons, _profile, _quads, _read, _risk, _segments,
)
from stridefield.sources import maps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its own name with the SQL that says the same."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


# --- tags
_KIND = "CASE WHEN p = '1-URGENT' THEN 'footway' WHEN p = '2-HIGH' THEN 'path' WHEN p = '3-MEDIUM' THEN 'motorway' WHEN p = '5-LOW' THEN 'residential' ELSE 'steps' END"
_DOOR = "CASE WHEN p_size % 7 = 0 THEN CASE p_size % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'yes' ELSE 'service' END END"
TAGGED_SQL = f"""tagged AS (SELECT p_partkey AS node_id, 38.534e0 + ((p_partkey * 104729) % 10009) / 10009e0 * 0.0125e0 AS lat,
  -121.762e0 + ((p_partkey * 7919) % 10007) / 10007e0 * 0.017e0 AS lon, {_DOOR} AS door FROM part)"""
WAYS_SQL = f"""kinds AS (SELECT o_orderkey AS way_id, {_KIND} AS kind FROM (SELECT o_orderkey, min(o_orderpriority) AS p FROM orders GROUP BY o_orderkey)),
refs AS (SELECT l_orderkey AS way_id, {REF} AS node_id, row_number() OVER w - 1 AS pos FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))"""


def _tagged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    doors = _read(spark, sf_dir, "part").selectExpr("p_partkey AS node_id", f"{_DOOR} AS door")
    none = F.create_map().cast("map<string,string>")
    tags = F.when(F.col("door").isNotNull(), F.create_map(F.lit("entrance"), "door")).otherwise(none)
    return _nodes(spark, sf_dir).join(doors, "node_id").select("node_id", "lat", "lon", tags.alias("tags"))


def _tagged_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways whose order exists, with a highway tag; one in ten has a building tag too."""
    kinds = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("way_id")).agg(F.min("o_orderpriority").alias("p")).selectExpr("way_id", f"{_KIND} AS kind")
    building = F.when(F.col("way_id") % 10 == 0, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    return _ways(spark, sf_dir).join(kinds, "way_id").select("way_id", "node_refs", F.map_concat(F.create_map(F.lit("highway"), "kind"), building).alias("tags"))


@query(f"WITH {WAYS_SQL} SELECT DISTINCT way_id FROM refs JOIN kinds USING (way_id) WHERE kind <> 'motorway'")
def walkable_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.filter_walkable(_tagged_ways(spark, sf_dir)).select("way_id")


@query(f"WITH {TAGGED_SQL} SELECT node_id, CASE WHEN door = 'main' THEN 'yes' ELSE door END AS entrance FROM tagged")
def entrance_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.normalize_entrance(_tagged_nodes(spark, sf_dir)).select("node_id", F.col("tags")["entrance"].alias("entrance"))


@query("""SELECT p_partkey AS node_id, CASE WHEN p_partkey % 5 = 0 THEN 'b' || CAST(p_partkey % 50 AS VARCHAR) ELSE 'Outdoor' END AS building_id,
  p_partkey % 5 <> 0 AS use_global_coords FROM part""")
def typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.create_map(F.lit("building"), F.concat(F.lit("b"), (F.col("node_id") % 50).cast("string")))
    nodes = _nodes(spark, sf_dir).withColumn("tags", F.when(F.col("node_id") % 5 == 0, inside).otherwise(F.create_map().cast("map<string,string>")))
    return network.graph_nodes(nodes).select("node_id", "building_id", "use_global_coords")


@query(f"WITH {TAGGED_SQL}, {WAYS_SQL} SELECT node_id FROM tagged WHERE door IS NOT NULL AND node_id IN (SELECT node_id FROM refs JOIN kinds USING (way_id) WHERE way_id % 10 = 0)")
def doors_on_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.building_entrance_nodes(_tagged_nodes(spark, sf_dir), network.filter_buildings(_tagged_ways(spark, sf_dir))).select("node_id")


@query(f"""WITH {NODES_SQL}, more AS (SELECT c_custkey * 3 AS node_id, c_nationkey * 1e0 AS lon, c_custkey * 1e0 AS lat FROM customer)
  SELECT node_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM (SELECT * FROM nodes WHERE node_id NOT IN (SELECT node_id FROM more) UNION ALL SELECT * FROM more)""")
def replaced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = _read(spark, sf_dir, "customer").selectExpr("c_custkey * 3 AS node_id", "c_nationkey * 1e0 AS lon", "c_custkey * 1e0 AS lat")
    return network.override_nodes(_nodes(spark, sf_dir), more).select("node_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(f"""WITH {TAGGED_SQL}, {WAYS_SQL}, v AS (SELECT way_id, CASE WHEN way_id % 3 = 0 THEN 'b' || CAST(way_id % 50 AS VARCHAR) ELSE CAST(way_id AS VARCHAR) END AS building_id,
    pos, door FROM refs JOIN tagged USING (node_id))
  SELECT building_id, count(DISTINCT way_id) AS n_polygons, count(*) AS n_vertices, count(door) AS n_entrances FROM v GROUP BY building_id""")
def building_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines and entrances of the buildings that all ways make, those of one name together."""
    name = F.when(F.col("way_id") % 3 == 0, F.concat(F.lit("b"), (F.col("way_id") % 50).cast("string"))).otherwise(F.col("way_id").cast("string"))
    doors = _tagged_nodes(spark, sf_dir).select("node_id", F.map_contains_key("tags", "entrance").alias("is_entrance"))
    found, _ = network.building_vertices(_ways(spark, sf_dir), _nodes(spark, sf_dir))
    shapes = network.buildings(found.join(doors, "node_id").withColumn("building_id", name))
    n = F.aggregate("polygons", F.lit(0), lambda s, p: s + F.size(p["ring"]))
    return shapes.select("building_id", *[c.cast("long").alias(a) for c, a in ((F.size("polygons"), "n_polygons"), (n, "n_vertices"), (F.size("entrances"), "n_entrances"))])


@query(EDGES_SQL + """SELECT src, count(*) AS n FROM (SELECT lo AS src FROM e UNION ALL SELECT hi FROM e
  UNION ALL SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 1 FROM part) GROUP BY src""")
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the neighbour lists of the walking network with those of a chain of all nodes behind them."""
    chain = _nodes(spark, sf_dir).select(F.col("node_id").alias("lo"), (F.col("node_id") + 1).alias("hi"), F.lit(1e0).alias("baseline_weight"))
    both = network.merge_adjacency(network.adjacency(_edges(spark, sf_dir)), network.adjacency(chain))
    return both.select("src", F.size("neighbours").cast("long").alias("n"))


# --- readings
@query("SELECT event_id, dayname(ts) AS weekday, strftime(ts, '%H:%M:%S') AS slot FROM events")
def reading_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_weekday_slot(_read(spark, sf_dir, "events")).select("event_id", "weekday", "slot")


def _raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 13 == 0, "no date").otherwise(F.date_format("ts", "M/d/yyyy")).alias("Date"),
        F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "H:mm")).alias("Time"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.round(F.col("value") * 10000).cast("long").cast("string")).alias("Count"),
    )


_CLEAN_SQL = "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS said_at, CAST(round(value * 10000) AS DOUBLE) AS count FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 11 <> 0"


@query(_CLEAN_SQL)
def clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text, some with a bad date, no time or a bad number: those go."""
    return temporal.clean_counts(_raw_counts(spark, sf_dir)).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("said_at"), "count")


# --- matrices and weights
@query(f"WITH {GRID_SQL} SELECT i, count(*) AS wide, round(sum(multiplier * (j + 1)), 4) AS moment FROM grid GROUP BY i")
def risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the heat map: its width, and its sum weighed by column."""
    moment = F.aggregate(F.transform("row", lambda x, j: x * (j + 1)), F.lit(0e0), lambda s, x: s + x)
    return weights.risk_matrix(_risk(spark, sf_dir)).select("i", F.size("row").cast("long").alias("wide"), F.round(moment, 4).alias("moment"))


@query(R_SQL + "SELECT edge_id, max(polygon_id) * 1.5e0 AS flow FROM hit GROUP BY edge_id")
def last_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS polygon_id", "n_nationkey * 1.5e0 AS flow")
    members = spatial.edges_in_polygons(_segments(spark, sf_dir), _polygons(spark, sf_dir))
    return network.edge_flow_map(spatial.edge_flows(members, flows))


_WEATHER = ["struct(ts, event_id) AS ts", "8e0 + event_id % 10 AS wind_speed", "(event_id % 360) * 1e0 AS wind_direction", "(event_id % 2) / 100e0 AS precipitation"]


@query(
    R_SQL + """, w AS (SELECT 8e0 + event_id % 10 AS ws, (event_id % 360) * 1e0 AS wd, (event_id % 2) / 100e0 AS p FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
  SELECT edge_id, round(greatest(0e0, 1.25e0 * base + base * 0.5e0 * ws * cos(radians(wd - atan2(y2 - y1, x2 - x1))) * CASE WHEN p < 0.01 THEN 0.5e0 ELSE 0e0 END), 4) AS weight FROM r, w"""
)
def windy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by bike with the latest weather, its terms as written."""
    edges = _segments(spark, sf_dir).withColumn("bearing", scalars.bearing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    done = weights.edge_weights(edges, weather=_read(spark, sf_dir, "events").selectExpr(*_WEATHER), biking=1.25, mode="as_written")
    return done.select("edge_id", F.round("weight", 4).alias("weight"))


# --- scalars
@query(
    R_SQL + """SELECT edge_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 9) AS euclid, round(abs(x2 - x1) + abs(y2 - y1), 9) AS manhattan,
  round(sqrt(pow((x2 - x1) * 87700e0, 2) + pow((y2 - y1) * 111320e0, 2)), 4) AS planar, round(o, 6) AS degrees,
  floor(255 * abs(o - 90) / 90) / 255 AS red, floor(255 * (1 - abs(o - 90) / 90)) / 255 AS blue,
  round(base * 1.4e0 / CASE WHEN edge_id % 2 = 0 THEN 5e0 ELSE 1.4e0 END, 4) AS seconds, round(edge_id / 15e0 / 1.4e0, 4) AS pixel_seconds,
  CAST(greatest(0, least(trunc((x1 + 121.762e0) / 0.016e0 * 40), 39)) AS INTEGER) AS pixel, CAST(trunc(edge_id / 7e0 * 3) AS INTEGER) AS rescaled,
  CAST(round_even(edge_id * 0.25e0, 0) AS BIGINT) AS scaled
  FROM (SELECT *, CASE WHEN degrees(atan2(y2 - y1, x2 - x1)) % 180 < 0 THEN degrees(atan2(y2 - y1, x2 - x1)) % 180 + 180 ELSE degrees(atan2(y2 - y1, x2 - x1)) % 180 END AS o FROM r)"""
)
def edge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, direction and pixel formulas of every segment."""
    x1, y1, x2, y2, key = (F.col(c) for c in ("x1", "y1", "x2", "y2", "edge_id"))
    metres = scalars.haversine(y1, x1, y2, x2)
    turn = scalars.orientation(x1, y1, x2, y2)
    rgb = scalars.orientation_rgb(turn)
    return _segments(spark, sf_dir).select(
        "edge_id", F.round(scalars.euclid(x1, y1, x2, y2), 9).alias("euclid"), F.round(scalars.manhattan(x1, y1, x2, y2), 9).alias("manhattan"),
        F.round(scalars.planar_distance(y1, x1, y2, x2), 4).alias("planar"), F.round(turn, 6).alias("degrees"), rgb["red"].alias("red"), rgb["blue"].alias("blue"),
        F.round(scalars.outdoor_travel_time(metres, key % 2 == 0), 4).alias("seconds"), F.round(scalars.pixel_travel_time(key), 4).alias("pixel_seconds"),
        scalars.rel_to_pixel((x1 + 121.762) / 0.016, F.lit(40)).alias("pixel"), scalars.rescale_pixel(key, F.lit(7.0), F.lit(3)).alias("rescaled"),
        scalars.scale_entrance(key, F.lit(0.25)).alias("scaled"),
    )


def _utm_sql() -> str:
    # Semi-major axis and flattening of WGS84, scale on the meridian
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    e, radius = 2 * n**0.5 / (1 + n), k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    first = n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180
    terms = (first, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    lit = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    east = " + ".join(["eta", *[f"{lit(c)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(terms, 1)]])
    north = " + ".join(["xi", *[f"{lit(c)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(terms, 1)]])
    return f"""WITH p AS (SELECT c_custkey AS point_id, -180e0 + (c_custkey * 7919 % 36000) / 100e0 AS lon, -80e0 + (c_custkey * 4001 % 16000) / 100e0 AS lat FROM customer),
z AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone FROM p),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {lit(e)} * atanh({lit(e)} * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS away FROM z),
x AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM t)
SELECT point_id, zone, zone + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg, round(500000 + {lit(radius)} * ({east}), 3) AS easting,
  round(CASE WHEN lat < 0 THEN 1e7 ELSE 0e0 END + {lit(radius)} * ({north}), 3) AS northing FROM x"""


@query(_utm_sql())
def utm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all over the world, one a customer, in their zone."""
    points = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS point_id", "-180e0 + (c_custkey * 7919 % 36000) / 100e0 AS lon", "-80e0 + (c_custkey * 4001 % 16000) / 100e0 AS lat")
    lon, lat = F.col("lon"), F.col("lat")
    known = points.withColumn("zone", scalars.utm_zone(lon)).withColumn("p", scalars.utm_project(lon, lat, F.col("zone")))
    return known.select("point_id", "zone", scalars.utm_epsg(lon, lat).alias("epsg"), F.round("p.easting", 3).alias("easting"), F.round("p.northing", 3).alias("northing"))


# --- pixels and polygons
@query(PIXELS_SQL + """, s AS (SELECT image_id, max(row) + 1 AS r, max(col) + 1 AS c FROM px GROUP BY image_id)
  SELECT image_id, row, col, round(col / c, 9) AS rel_x, round(row / r, 9) AS rel_y FROM px JOIN s USING (image_id)""")
def relative_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.relative_places(_pixels(spark, sf_dir)).select("image_id", "row", "col", F.round("rel_x", 9).alias("rel_x"), F.round("rel_y", 9).alias("rel_y"))


@query(PIXELS_SQL + """SELECT a.image_id, a.row, a.col, b.row AS to_row, b.col AS to_col, 1e0 AS cost FROM px a JOIN px b ON a.image_id = b.image_id
  AND abs(a.row - b.row) + abs(a.col - b.col) = 1 WHERE a.value = 0 AND b.value = 0""")
def side_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs between dark pixels that share a side."""
    return pixels.grid_graph(_pixels(spark, sf_dir), 4, 0)


@query("""SELECT p_partkey // 400 AS image_id, (p_partkey % 400) // 20 AS row, p_partkey % 20 AS col, CASE WHEN (p_partkey * 31) % 256 > 100 THEN 0 ELSE 255 END AS value FROM part""")
def thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = _pixels(spark, sf_dir).withColumn("value", ((F.col("image_id") * 400 + F.col("row") * 20 + F.col("col")) * 31 % 256).cast("int"))
    return pixels.binarize(grey, 100, invert=True)


_BOXES = "s_suppkey % 7 AS image_id, s_suppkey * 7 % 20 AS x, s_suppkey * 11 % 20 AS y, 1 + s_suppkey % 3 AS w, 1 + s_suppkey % 4 AS h"


@query(PIXELS_SQL + f""", b AS (SELECT {_BOXES} FROM supplier)
  SELECT image_id, row, col, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.image_id = px.image_id AND row >= y AND row < y + h AND col >= x AND col < x + w) THEN 7 ELSE value END AS value FROM px""")
def erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.erase_boxes(_pixels(spark, sf_dir), _read(spark, sf_dir, "supplier").selectExpr(*_BOXES.split(", ")), 7)


@query(PIXELS_SQL + f""", b AS (SELECT image_id, x - 2 AS x, y - 2 AS y, CAST(trunc(4 * w * (1 + s_suppkey % 5) / 10e0) AS BIGINT) AS w, CAST(trunc(4 * h * (1 + s_suppkey % 5) / 10e0) AS BIGINT) AS h
    FROM (SELECT s_suppkey, {_BOXES} FROM supplier))
  SELECT image_id, row, col, 255 - CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.image_id = px.image_id AND row >= y AND row < y + h AND col >= x AND col < x + w) THEN 0 ELSE value END AS value FROM px""")
def without_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans without the boxes of detections, which are scaled and may reach over the image's edge, inverted."""
    boxes = _read(spark, sf_dir, "supplier").selectExpr(*_BOXES.split(", "), "(1 + s_suppkey % 5) / 10e0 AS scale")
    found = boxes.selectExpr("image_id", "x - 2 AS x", "y - 2 AS y", "4 * w AS w", "4 * h AS h", "scale")
    return pixels.remove_detections(_pixels(spark, sf_dir), found)


_CROP_SQL = PIXELS_SQL + """, b AS (SELECT image_id, greatest(min(row) - 10, 0) AS a, max(row) + 10 AS b, greatest(min(col) - 10, 0) AS c, max(col) + 10 AS d FROM px
    WHERE value = 255 AND row >= 7 AND col % 7 = 3 GROUP BY image_id)
  SELECT image_id, row - a AS row, col - c AS col, value FROM (SELECT image_id, row, col, CASE WHEN value = 255 AND row >= 7 AND col % 7 = 3 THEN 0 ELSE 255 END AS value FROM px) JOIN b USING (image_id)
  WHERE row BETWEEN a AND b.b AND col BETWEEN c AND d"""


@query(_CROP_SQL)
def cropped_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of few dark pixels, cut to them and a margin of ten."""
    plans = _pixels(spark, sf_dir).selectExpr("image_id", "row", "col", "CASE WHEN value = 255 AND row >= 7 AND col % 7 = 3 THEN 0 ELSE 255 END AS value")
    return pixels.crop_to_content(plans)


# Four ids in ten share a place with others; every place has nodes of two buildings or none.
_SHARED = "p_partkey AS node_id, CASE WHEN p_partkey % 10 < 4 THEN p_partkey % 50 ELSE p_partkey END AS k, CASE WHEN p_partkey % 3 = 0 THEN 'b' || CAST(p_partkey % 2 AS {text}) ELSE 'Outdoor' END AS building_id"
_SHARED_AT = "(k * 7919 % 10007) / 10007e0 AS x, (k * 104729 % 10009) / 10009e0 AS y"
PLACES_SQL = f"""WITH {NODES_SQL}, {SEGMENTS_SQL}, raw AS (SELECT {_SHARED.format(text='VARCHAR')} FROM part), n AS (SELECT node_id, building_id, {_SHARED_AT} FROM raw),
ids AS (SELECT node_id, x, y, min(node_id) OVER (PARTITION BY x, y, building_id) AS place_id FROM n)
"""


def _shared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _read(spark, sf_dir, "part").selectExpr(*_SHARED.format(text="string").split(", "))
    return raw.selectExpr("node_id", *_SHARED_AT.split(", "), "building_id = 'Outdoor' AS use_global_coords", "building_id")


@query(PLACES_SQL + "SELECT node_id, place_id FROM ids")
def places_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that stands for each node's place and building."""
    return network.place_ids(_shared_nodes(spark, sf_dir))


@query(PLACES_SQL + """, m AS (SELECT way_id, pos, a.place_id AS u, b.place_id AS v, (a.x, a.y, a.place_id) <= (b.x, b.y, b.place_id) AS ordered FROM seg JOIN ids a ON a.node_id = src JOIN ids b ON b.node_id = dst)
  SELECT lo, hi, arg_min(w, {'a': way_id, 'b': pos}) AS baseline_weight FROM (SELECT way_id, pos, CASE WHEN ordered THEN u ELSE v END AS lo, CASE WHEN ordered THEN v ELSE u END AS hi,
    1e0 * (way_id % 100 + pos) AS w FROM m) GROUP BY lo, hi""")
def edges_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges between places: segments whose ends have other ids at the same places are one edge."""
    weighted = network.way_segments(_ways(spark, sf_dir)).withColumn("baseline_weight", F.expr("1e0 * (way_id % 100 + pos)"))
    return network.edges_between_places(weighted, _shared_nodes(spark, sf_dir))


@query(QUADS_SQL + """, s AS (SELECT polygon_id, abs(sum(x * y2 - x2 * y)) / 2 AS area, sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS cx,
    sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS cy FROM l GROUP BY polygon_id),
  f AS (SELECT *, sqrt((100e0 + polygon_id % 50) / area) AS factor FROM s)
  SELECT polygon_id, pos, round(cx + (x - cx) * factor, 4) AS x, round(cy + (y - cy) * factor, 4) AS y FROM l JOIN f USING (polygon_id)""")
def resized_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads scaled about their centroid to an area of their own."""
    quads = _quads(spark, sf_dir)
    target = quads.select("polygon_id").distinct().select("polygon_id", (100e0 + F.col("polygon_id") % 50).alias("area"))
    return geometry.match_area(quads, target).select("polygon_id", "pos", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_RECT = "s_suppkey AS building_id, 4e0 + s_suppkey % 5 AS a, 3e0 + s_suppkey % 7 AS b, 2e0 + s_suppkey % 11 AS c"


@query(f"""WITH q AS (SELECT {_RECT} FROM supplier), d AS (SELECT *, a * b / c AS d FROM q),
  o AS (SELECT *, least(a, c) * least(b, d) AS straight, least(a, d) * least(b, c) AS across FROM d), i AS (SELECT *, straight / (2 * a * b - straight) AS si, across / (2 * a * b - across) AS ai FROM o)
  SELECT building_id, CASE WHEN round(si, 9) >= round(ai, 9) THEN -180 ELSE -90 END AS angle, false AS reflected, round(greatest(si, ai), 6) AS iou FROM i""")
def rectangle_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quarter turn of a rectangle of sides c and d onto one of sides a and b of the same area."""

    def box(w, h):
        corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        return F.array(corner(-w / 2, -h / 2), corner(w / 2, -h / 2), corner(w / 2, h / 2), corner(-w / 2, h / 2))

    rows = _read(spark, sf_dir, "supplier").selectExpr(*_RECT.split(", "))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    found = geometry.best_alignment(rows.select("building_id", box(a, b).alias("outline"), box(c, a * b / c).alias("plan")), 90)
    return found.select("building_id", "angle", "reflected", F.round("iou", 6).alias("iou"))


_ELLS = "s_nationkey * 4 + s_suppkey % 4 AS building_id, 40e0 + sum(s_suppkey) % 17 AS a, 70e0 + sum(s_suppkey) % 13 AS b, sum(s_suppkey) * 37 % 360 - 180 AS turn, sum(s_suppkey) % 2 = 0 AS mirrored"


@query(f"""SELECT building_id, CAST(turn AS INT) AS angle, mirrored AS reflected, 1e0 AS iou FROM (
  SELECT {_ELLS} FROM supplier GROUP BY s_nationkey * 4 + s_suppkey % 4)""")
def concave_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn, of all 360 plain and mirrored, that puts an L-shaped plan of 1,000 points onto its outline of 1,000 points."""
    made = _read(spark, sf_dir, "supplier").groupBy(F.expr("s_nationkey * 4 + s_suppkey % 4").alias("building_id"))
    shapes = made.agg(*[F.expr(e) for e in _ELLS.split(", ")[1:]])
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    corners = [(zero, zero), (a, zero), (a, b / 3), (a / 2, b / 3), (a / 2, b), (zero, b)]
    about = [geometry.translate(x, y, -3 * a / 8, -5 * b / 12) for x, y in corners]
    turned = []
    for x, y in about:
        m, n = geometry.reflect(x, y, "x", zero, zero)
        turned.append(geometry.rotate(F.when(F.col("mirrored"), m).otherwise(x), F.when(F.col("mirrored"), n).otherwise(y), -F.col("turn"), zero, zero))

    def ring(points: list, name: str) -> DataFrame:
        corner = F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])).alias("pos", "p")
        vertices = shapes.select(F.col("building_id").alias("polygon_id"), corner).select("polygon_id", "pos", "p.x", "p.y")
        return geometry.rings(geometry.resample_polygon(vertices).withColumnRenamed("k", "pos")).withColumnsRenamed({"polygon_id": "building_id", "ring": name})

    found = geometry.best_alignment(ring(about, "outline").join(ring(turned, "plan"), "building_id"))
    return found.select("building_id", "angle", "reflected", F.round("iou", 6).alias("iou"))


_ELL = "(o_orderkey * 31) % 997 * 1e0 AS x0, (o_orderkey * 17) % 991 * 1e0 AS y0, 8e0 + 2 * (o_orderkey % 13) AS w, 6e0 + 2 * (o_orderkey % 11) AS h, 1e0 + o_orderkey % 3 AS dx, o_orderkey % 5 - 1e0 AS dy"


@query(f"""WITH q AS (SELECT DISTINCT o_orderkey AS polygon_id, {_ELL} FROM orders),
  r AS (SELECT polygon_id, w, h, dx, dy, 0e0 AS l, w AS r, 0e0 AS b, h / 2 AS t FROM q UNION ALL SELECT polygon_id, w, h, dx, dy, 0e0, w / 2, h / 2, h FROM q),
  i AS (SELECT p.polygon_id, any_value(p.w * p.h) * 0.75e0 AS area, sum(greatest(0, least(p.r, q.r + q.dx) - greatest(p.l, q.l + q.dx)) * greatest(0, least(p.t, q.t + q.dy) - greatest(p.b, q.b + q.dy))) AS s
    FROM r p JOIN r q USING (polygon_id) GROUP BY p.polygon_id)
  SELECT polygon_id, round(s / (2 * area - s), 6) AS iou FROM i""")
def concave_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection over union of each order's L with itself moved, one of both running the other way round."""
    shapes = _read(spark, sf_dir, "orders").select("o_orderkey").distinct().selectExpr("o_orderkey AS polygon_id", *_ELL.split(", "))
    x, y, w, h, zero = F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), F.lit(0.0)
    corners = [(zero, zero), (w, zero), (w, h / 2), (w / 2, h / 2), (w / 2, h), (zero, h)]
    ring = lambda dx, dy, points: F.array(*[F.struct((x + dx + a).alias("x"), (y + dy + b).alias("y")) for a, b in points])
    pairs = shapes.select("polygon_id", ring(zero, zero, corners).alias("a"), ring(F.col("dx"), F.col("dy"), corners[::-1]).alias("b"))
    return geometry.polygon_overlaps(pairs, "a", "b", "polygon_id").select("polygon_id", F.round("iou", 6).alias("iou"))


# --- entrances
_PLACE = "s_suppkey % 4 AS entrance_pos, s_suppkey * 7 % 20 AS indoor_x, s_suppkey * 11 % 20 AS indoor_y"


@query(f"""WITH i AS (SELECT s_suppkey // 4 AS building_id, {_PLACE} FROM supplier),
  o AS (SELECT CASE WHEN s_suppkey % 12 = 0 THEN -1 ELSE s_suppkey // 4 END AS building_id, s_suppkey % 4 AS entrance_pos, s_nationkey AS n FROM supplier)
  SELECT building_id, entrance_pos, indoor_x, indoor_y, n FROM i JOIN o USING (building_id, entrance_pos)
  WHERE (SELECT count(*) FROM i k WHERE k.building_id = i.building_id) = (SELECT count(*) FROM o k WHERE k.building_id = i.building_id)""")
def paired_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors inside and outside by position; one building in three lacks an outer one and is left out."""
    doors = _read(spark, sf_dir, "supplier")
    indoor = doors.selectExpr("s_suppkey div 4 AS building_id", *_PLACE.split(", "))
    outdoor = doors.selectExpr("CASE WHEN s_suppkey % 12 = 0 THEN -1 ELSE s_suppkey div 4 END AS building_id", "s_suppkey % 4 AS entrance_pos", "s_nationkey AS n")
    return routes.pair_entrances(indoor, outdoor)


@query(f"""WITH doors AS (SELECT s_suppkey // 4 AS building_id, s_suppkey AS entrance_pos, s_suppkey * 7 % 200 AS x, s_suppkey * 11 % 200 AS y FROM supplier),
  q AS (SELECT c_custkey AS request_id, c_custkey % (SELECT count(*) // 4 FROM supplier) AS building_id, c_custkey * 13 % 200 AS px, c_custkey * 17 % 200 AS py FROM customer),
  r AS (SELECT request_id, entrance_pos, row_number() OVER (PARTITION BY request_id ORDER BY sqrt(CAST((px - x) * (px - x) + (py - y) * (py - y) AS DOUBLE)), entrance_pos) AS rank FROM q JOIN doors USING (building_id))
  SELECT request_id, arg_min(entrance_pos, rank) AS entrance_pos, min(rank) AS rank FROM r WHERE (request_id + entrance_pos) % 3 <> 0 GROUP BY request_id""")
def first_open_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest door in pixels that has a way to it."""
    doors = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey div 4 AS building_id", "s_suppkey AS entrance_pos", "s_suppkey * 7 % 200 AS indoor_x", "s_suppkey * 11 % 200 AS indoor_y")
    asked = _guests(spark, sf_dir).selectExpr("c_custkey AS request_id", "c_custkey % n AS building_id", "c_custkey * 13 % 200 AS x", "c_custkey * 17 % 200 AS y")
    ranked = routes.rank_entrances(asked, doors, indoor=True)
    cost = F.when((F.col("request_id") + F.col("entrance_pos")) % 3 != 0, F.col("distance"))
    return routes.first_feasible(ranked.withColumn("cost", cost)).select("request_id", "entrance_pos", "rank")


# --- files, written from the tables and read back
def _stored(spark: SparkSession, make) -> DataFrame:
    """What ``make`` reads back from the folder that it wrote to; the folder is removed."""
    with Scratch(spark) as scratch:
        return cut(make(scratch.folder))


@query(f"WITH {TAGGED_SQL} SELECT node_id, round(lat, 9) AS lat, round(lon, 9) AS lon, door AS entrance FROM tagged")
def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        maps.write_osm(_tagged_nodes(spark, sf_dir), f"{folder}/nodes", "node")
        return maps.read_osm_nodes(spark, f"{folder}/nodes").select("node_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.col("tags")["entrance"].alias("entrance"))

    return _stored(spark, make)


@query(f"""WITH {TAGGED_SQL}, {WAYS_SQL}, w AS (SELECT DISTINCT way_id, kind FROM refs JOIN kinds USING (way_id))
  SELECT 'node' AS part, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS ids FROM tagged UNION ALL SELECT 'way', count(*), CAST(sum(way_id) AS BIGINT) FROM w WHERE kind <> 'motorway'
  UNION ALL SELECT 'building', count(*), CAST(sum(way_id) AS BIGINT) FROM w WHERE way_id % 10 = 0
  UNION ALL SELECT 'door', count(*), CAST(sum(node_id) AS BIGINT) FROM tagged WHERE door IS NOT NULL AND node_id IN (SELECT node_id FROM refs JOIN w USING (way_id) WHERE way_id % 10 = 0)""")
def stored_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map extract written and read, then split in four: rows and the sum of ids of each part."""

    def make(folder: str) -> DataFrame:
        maps.write_osm(_tagged_nodes(spark, sf_dir), f"{folder}/nodes", "node")
        maps.write_osm(_tagged_ways(spark, sf_dir), f"{folder}/ways", "way")
        parts = maps.split_osm(maps.read_osm_nodes(spark, f"{folder}/nodes"), maps.read_osm_ways(spark, f"{folder}/ways"))
        ids = zip(("node", "way", "building", "door"), parts, ("node_id", "way_id", "way_id", "node_id"), strict=True)
        sums = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(key).alias("ids")) for name, df, key in ids]
        return sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3])

    return _stored(spark, make)


@query(f"""WITH {WAYS_SQL}, w AS (SELECT way_id, kind, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS refs FROM refs JOIN kinds USING (way_id) GROUP BY ALL)
  SELECT way_id, kind AS highway, refs FROM w""")
def stored_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        maps.write_osm(_tagged_ways(spark, sf_dir), f"{folder}/ways", "way")
        refs = F.array_join(F.transform("node_refs", lambda r: r.cast("string")), ",").alias("refs")
        return maps.read_osm_ways(spark, f"{folder}/ways").select("way_id", F.col("tags")["highway"].alias("highway"), refs)

    return _stored(spark, make)


@query(_CLEAN_SQL)
def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        _raw_counts(spark, sf_dir).write.csv(f"{folder}/counts")
        return temporal.clean_counts(maps.read_counts(spark, f"{folder}/counts")).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("said_at"), "count")

    return _stored(spark, make)


@query(f"SELECT round(lat, 9) AS lat, round(lon, 9) AS long FROM (SELECT {_at('s_suppkey', 1013, 4001)} FROM supplier)")
def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        _read(spark, sf_dir, "supplier").selectExpr(*_columns("s_suppkey", 1013, 4001)).write.csv(f"{folder}/points")
        return maps.read_points(spark, f"{folder}/points").select(F.round("lat", 9).alias("lat"), F.round("long", 9).alias("long"))

    return _stored(spark, make)


_ZONES_SQL = R_SQL + """SELECT polygon_id AS zone, pos, round(CASE WHEN pos < 2 THEN s ELSE n END, 9) AS lat, round(CASE WHEN pos IN (0, 3) THEN w ELSE e END, 9) AS lon FROM z, range(4) t(pos)"""


def _by_corner(rings: DataFrame, key) -> DataFrame:
    corners = rings.select(key.alias("zone"), F.posexplode("ring").alias("pos", "p"))
    return corners.select("zone", F.col("pos").cast("long").alias("pos"), F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


def _numbered(zones: DataFrame, read: DataFrame) -> DataFrame:
    """Zones come back without their id: it is found again by the first corner."""
    corner = F.struct(F.round(F.get("ring", F.lit(0))["lat"], 9).alias("a"), F.round(F.get("ring", F.lit(0))["lon"], 9).alias("b"))
    return read.select("ring", corner.alias("k")).join(zones.select("polygon_id", corner.alias("k")), "k")


@query(_ZONES_SQL)
def stored_zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        zones = _polygons(spark, sf_dir)
        flat = F.flatten(F.transform("ring", lambda p: F.array(p["lat"], p["lon"])))
        zones.select(F.array_join(F.transform(flat, lambda x: x.cast("string")), ", ")).write.text(f"{folder}/zones")
        return _by_corner(_numbered(zones, maps.read_zone_csv(spark, f"{folder}/zones")), F.col("polygon_id"))

    return _stored(spark, make)


@query(_ZONES_SQL)
def stored_zone_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as GeoJSON, one collection a line group, with a point feature that is left out."""

    def make(folder: str) -> DataFrame:
        zones = _polygons(spark, sf_dir)
        ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
        shape = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
        polygon, point = F.to_json(shape), F.lit('{"geometry":{"type":"Point","coordinates":[1,2]}}')
        features = zones.agg(F.array_join(F.sort_array(F.collect_list(polygon)), ",").alias("f"))  # one zone a nation
        features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), point, F.lit(","), "f", F.lit("]}"))).write.text(f"{folder}/zones")
        return _by_corner(_numbered(zones, maps.read_zone_geojson(spark, f"{folder}/zones")), F.col("polygon_id"))

    return _stored(spark, make)


@query(EDGES_SQL + "SELECT src, count(*) AS degree, round(sum(w), 4) AS total, (SELECT count(*) FROM nodes) AS n_nodes FROM (SELECT lo AS src, w FROM e UNION ALL SELECT hi, w FROM e) GROUP BY src")
def stored_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        maps.save_network(_nodes(spark, sf_dir), network.undirected_arcs(_edges(spark, sf_dir)), folder)
        nodes, arcs = maps.load_network(spark, folder)
        degrees = arcs.groupBy("src").agg(F.count("*").alias("degree"), F.round(F.sum("baseline_weight"), 4).alias("total"))
        return degrees.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))

    return _stored(spark, make)


@query("""SELECT dayname(ts) AS weekday, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M:%S') AS slot,
  round(avg(CAST(round(value * 10000) AS BIGINT)) / 10000, 4) AS avg_count FROM events GROUP BY ALL""")
def stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        maps.write_profile(temporal.pivot_profile(_profile(spark, sf_dir)), f"{folder}/profile")
        back = maps.read_profile(spark, f"{folder}/profile").filter("avg_count IS NOT NULL")
        return back.select("weekday", "slot", F.round(F.col("avg_count") / 10000, 4).alias("avg_count"))

    return _stored(spark, make)


@query("SELECT CAST(s_suppkey AS INTEGER) AS state, s_suppkey / 7e0 - 1e-7 AS value FROM supplier")
def stored_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: str) -> DataFrame:
        maps.write_vector(_read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS state", "s_suppkey / 7e0 - 1e-7 AS value"), f"{folder}/vector")
        return maps.read_vector(spark, f"{folder}/vector")

    return _stored(spark, make)
