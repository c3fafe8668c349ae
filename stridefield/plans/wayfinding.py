"""Registered queries of the place, time, graph, polygon and pixel operators, over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import geometry, graph, network, pixels, routes, spatial, temporal, weights
from stridefield.operators.lineage import Scratch
from stridefield.plans.queries import EDGES_SQL, NODES_SQL, REF, SEGMENTS_SQL, _edges, _nodes, _ways

BOUNDS = (38.534, 38.5465, -121.762, -121.745)
N = weights.CELLS
_STEP_LAT, _STEP_LON = (BOUNDS[1] - BOUNDS[0]) / N, (BOUNDS[3] - BOUNDS[2]) / N


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(key: str, a: int, b: int) -> str:
    return f"38.534e0 + (({key} * {a}) % 10009) / 10009e0 * 0.0125e0 AS lat, -121.762e0 + (({key} * {b}) % 10007) / 10007e0 * 0.017e0 AS lon"


def _columns(key: str, a: int, b: int) -> list[str]:
    lat, lon = _at(key, a, b).split(", -121")
    return [lat, "-121" + lon]


def _feet(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = scalars.RADIUS_FT) -> str:
    return f"""2 * {radius!r}e0 * asin(least(1e0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"""


# --- segments and polygons
def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network.resolve_segments(network.way_segments(_ways(spark, sf_dir)), _nodes(spark, sf_dir))
    return network.edge_midpoints(found).select(
        (F.col("way_id") * 100 + F.col("pos")).alias("edge_id"), F.col("src_lon").alias("x1"), F.col("src_lat").alias("y1"),
        F.col("dst_lon").alias("x2"), F.col("dst_lat").alias("y2"), "mid_lat", "mid_lon",
        scalars.walking_time(scalars.haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))).alias("baseline_weight"),
    )


_CENTRE = "38.5345e0 + (({k} * 37) % 25) / 25e0 * 0.0115e0 AS clat, -121.7615e0 + (({k} * 11) % 25) / 25e0 * 0.016e0 AS clon"


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS polygon_id", *[c if i == 0 else "-121" + c for i, c in enumerate(_CENTRE.format(k="n_nationkey").split(", -121"))])
    corner = lambda a, b: F.struct((F.col("clat") + a).alias("lat"), (F.col("clon") + b).alias("lon"))
    return centres.select("polygon_id", F.array(corner(-0.001, -0.0012), corner(-0.001, 0.0012), corner(0.001, 0.0012), corner(0.001, -0.0012)).alias("ring"))


R_SQL = f"""WITH {NODES_SQL}, {SEGMENTS_SQL},
r AS (SELECT way_id * 100 + pos AS edge_id, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2, (a.lat + b.lat) / 2 AS mid_lat,
  (a.lon + b.lon) / 2 AS mid_lon, {_feet("a.lat", "a.lon", "b.lat", "b.lon", scalars.RADIUS_M)} / 1.4e0 AS base
  FROM seg JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id),
z AS (SELECT polygon_id, clat - 0.001e0 AS s, clat + 0.001e0 AS n, clon - 0.0012e0 AS w, clon + 0.0012e0 AS e
  FROM (SELECT n_nationkey AS polygon_id, {_CENTRE.format(k="n_nationkey")} FROM nation)),
k AS (SELECT polygon_id, edge_id, (x2 - x1) * (s - y1) - (y2 - y1) * (w - x1) AS a, (x2 - x1) * (s - y1) - (y2 - y1) * (e - x1) AS b,
  (x2 - x1) * (n - y1) - (y2 - y1) * (w - x1) AS c, (x2 - x1) * (n - y1) - (y2 - y1) * (e - x1) AS d FROM r, z
  WHERE least(x1, x2) <= e AND greatest(x1, x2) >= w AND least(y1, y2) <= n AND greatest(y1, y2) >= s),
hit AS (SELECT polygon_id, edge_id FROM k WHERE least(a, b, c, d) <= 0 AND greatest(a, b, c, d) >= 0)
"""


def edges_inside_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.edges_in_polygons(_segments(spark, sf_dir), _polygons(spark, sf_dir), "contains")


def edges_touching_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.edges_in_polygons(_segments(spark, sf_dir), _polygons(spark, sf_dir))


def open_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left after the zones of all nations are closed."""
    return spatial.apply_closures(_segments(spark, sf_dir), _polygons(spark, sf_dir)).select("edge_id")


def _risk(spark: SparkSession, sf_dir: str, **default: float) -> DataFrame:
    crimes = _read(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(*_columns("event_id", 7907, 1009))
    phones = _read(spark, sf_dir, "supplier").selectExpr(*_columns("s_suppkey", 1013, 4001))
    return weights.risk_grid(spark, crimes, phones, BOUNDS, **default)


def risk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select("i", "j", F.round("multiplier", 6).alias("multiplier"))


def heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid for a heat map, where cells without crimes and phones are 0."""
    return _risk(spark, sf_dir, default=0.0).select("i", "j", F.round("multiplier", 6).alias("multiplier"))


def _lo(i: str, low: float, step: float) -> str:
    return f"({low!r}e0 + {i} * {step!r}e0)"


_C_LAT, _C_LON = f"(({_lo('i', BOUNDS[0], _STEP_LAT)} + {_lo('i', BOUNDS[0], _STEP_LAT)} + {_STEP_LAT!r}e0) / 2)", f"(({_lo('j', BOUNDS[2], _STEP_LON)} + {_lo('j', BOUNDS[2], _STEP_LON)} + {_STEP_LON!r}e0) / 2)"
GRID_SQL = f"""cells AS (SELECT i, j, {_C_LAT} AS clat, {_C_LON} AS clon FROM range({N}) a(i), range({N}) b(j)),
crimes AS (SELECT i, j, sum(CASE WHEN d <= 100 THEN 3 WHEN d <= 500 THEN 2 ELSE 1 END) AS crime FROM (
  SELECT i, j, {_feet("clat", "clon", "lat", "lon")} AS d FROM cells, (SELECT {_at("event_id", 7907, 1009)} FROM events WHERE event_type = 'error')) WHERE d <= 1000 GROUP BY ALL),
phones AS (SELECT i, j, min(CASE WHEN d <= 50 THEN 0.25e0 WHEN d <= 100 THEN 0.5e0 ELSE 0.67e0 END) AS phone FROM (
  SELECT i, j, {_feet("clat", "clon", "lat", "lon")} AS d FROM cells, (SELECT {_at("s_suppkey", 1013, 4001)} FROM supplier)) WHERE d <= 200 GROUP BY ALL),
grid AS (SELECT i, j, CASE WHEN v = 0 THEN 1e0 ELSE v END AS multiplier FROM (
  SELECT i, j, CAST(CASE WHEN phone IS NULL THEN coalesce(crime, 0) WHEN coalesce(crime, 0) = 0 THEN phone ELSE crime * phone END AS DOUBLE) AS v
  FROM cells LEFT JOIN crimes USING (i, j) LEFT JOIN phones USING (i, j)))
"""


def current_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all segments in safe mode with traffic of the polygons and the latest weather."""
    edges = _segments(spark, sf_dir).withColumn("bearing", scalars.bearing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    flows = spatial.edge_flows(spatial.edges_in_polygons(edges, _polygons(spark, sf_dir)), _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS polygon_id", "n_nationkey * 1.5e0 AS flow"))
    risk = spatial.edge_risk(edges.select("edge_id", "mid_lat", "mid_lon"), _risk(spark, sf_dir), BOUNDS, N)
    weather = _read(spark, sf_dir, "events").selectExpr("struct(ts, event_id) AS ts", "8e0 + event_id % 10 AS wind_speed", "(event_id % 360) * 1e0 AS wind_direction", "(event_id % 25) / 10e0 AS precipitation")
    done = weights.edge_weights(edges, flows, risk, weather, safe=True)
    return done.select("edge_id", F.round("weight", 4).alias("weight"))


def _cell_sql(v: str, low: float, step: float) -> str:
    return f"(SELECT min(i) FROM range({N}) t(i) WHERE {v} >= {_lo('i', low, step)} AND {v} <= {_lo('i', low, step)} + {step!r}e0)"


WEIGHTS_SQL = R_SQL + f""", {GRID_SQL},
f AS (SELECT edge_id, sum(polygon_id * 1.5e0) AS flow FROM hit GROUP BY edge_id),
m AS (SELECT r.*, {_cell_sql("mid_lat", BOUNDS[0], _STEP_LAT)} AS i, {_cell_sql("mid_lon", BOUNDS[2], _STEP_LON)} AS j FROM r),
w AS (SELECT 8e0 + event_id % 10 AS ws, (event_id % 360) * 1e0 AS wd, (event_id % 25) / 10e0 AS p FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT edge_id, round(greatest(0e0, base + 0.01e0 * base * coalesce(flow, 0e0) + base * coalesce(multiplier, 1e0)
  + base * (CASE WHEN ws < 5 THEN 0e0 ELSE 0.5e0 * ws * cos(radians(wd) - atan2(y2 - y1, x2 - x1)) END)
    * (CASE WHEN p < 0.01 THEN 0e0 WHEN p <= 0.1 THEN 0.1e0 WHEN p <= 0.3 THEN 0.2e0 WHEN p <= 2 THEN 0.3e0 ELSE 0.5e0 END)), 4) AS weight
FROM m LEFT JOIN f USING (edge_id) LEFT JOIN grid g ON g.i = m.i AND g.j = m.j, w"""


def _near(spark: SparkSession, sf_dir: str, radius: float | None) -> DataFrame:
    points = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS point_id", *_columns("c_custkey", 3001, 5003)).select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    nodes = _nodes(spark, sf_dir).select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("node_id").alias("ord"))
    return spatial.nearest_nodes(points, nodes, early_exit_radius=radius).select("point_id", "node_id", F.round("degrees", 9).alias("degrees"))


def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, None)


def nearest_node_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node within 0.0005 degrees, else the nearest."""
    return _near(spark, sf_dir, 0.0005)


def nearest_node_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node within 0.01 degrees, which is most of the map, else the nearest."""
    return _near(spark, sf_dir, 0.01)


NEAR_SQL = f"""WITH {NODES_SQL}, p AS (SELECT c_custkey AS point_id, {_at("c_custkey", 3001, 5003)} FROM customer),
d AS (SELECT point_id, node_id, sqrt((p.lon - n.lon) * (p.lon - n.lon) + (p.lat - n.lat) * (p.lat - n.lat)) AS d FROM p, nodes n)
"""


# --- time
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.weekday_profile(_read(spark, sf_dir, "events").select("ts", F.round(F.col("value") * 10000).cast("long").alias("count")))


PROFILE_SQL = """p AS (SELECT dayname(ts) AS weekday, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M:%S') AS slot,
  avg(CAST(round(value * 10000) AS BIGINT)) AS c FROM events GROUP BY ALL)"""


def profile_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = temporal.pivot_profile(_profile(spark, sf_dir))
    return wide.select("slot", *[F.round(F.col(d) / 10000, 4).alias(d) for d in temporal.DAYS])


def flow_at_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), "ts")
    return temporal.flow_at(_profile(spark, sf_dir), asked).select("query_id", F.round(F.col("avg_count") / 10000, 4).alias("avg_count"))


def weather_at_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the latest reading, made of the sign-ups of a minute, if at most a quarter of an hour old."""
    events = _read(spark, sf_dir, "events")
    readings = events.filter("event_type = 'signup'").groupBy(F.date_trunc("minute", "ts").alias("ts")).agg(F.max("value").alias("wind"))
    asked = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), "ts")
    return temporal.weather_asof(asked, readings, 900).select("request_id", "wind")


# --- graph
def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    arms = F.array(
        F.when((F.col("i") % 50 < 49) & (((F.col("i") * 7919) % 1009) % 10 >= 4), F.col("i") + 1),
        F.when(((F.col("i") * 104729) % 1013) % 10 >= 4, F.col("i") + 50),
    )
    return part.select(F.col("i").alias("src"), F.explode(arms).alias("dst")).filter("dst IS NOT NULL").join(part.withColumnRenamed("i", "dst"), "dst", "left_semi").select("src", "dst")


LATTICE_SQL = """arms AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 50 < 49 AND ((p_partkey * 7919) % 1009) % 10 >= 4
  UNION ALL SELECT p_partkey, p_partkey + 50 FROM part WHERE ((p_partkey * 104729) % 1013) % 10 >= 4),
one AS (SELECT src, dst FROM arms WHERE dst IN (SELECT p_partkey FROM part)), arcs AS (SELECT * FROM one UNION SELECT dst, src FROM one),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM arcs UNION (
  SELECT DISTINCT ON (p.node) p.node, c.component FROM recurring.cc p JOIN arcs e ON e.src = p.node JOIN cc c ON c.node = e.dst
  WHERE c.component < p.component ORDER BY p.node, c.component))
"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_lattice(spark, sf_dir)).select("node", "component")


def largest_component_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.keep_largest_component(_lattice(spark, sf_dir)).select("src", "dst")


def least_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost in whole seconds from the node of each customer's nation to a node of its own, over the walking network."""
    arcs = network.undirected_arcs(_edges(spark, sf_dir)).select("src", "dst", F.round("baseline_weight").alias("weight"))
    n = _read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    asked = _read(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).selectExpr("c_custkey AS request_id", "c_nationkey AS source", "c_custkey * 31 % n AS target")
    return graph.shortest_paths(arcs, asked).select("request_id", "cost")


COSTS_SQL = EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, arcs AS (SELECT lo AS src, hi AS dst, round(w) AS w FROM e UNION ALL SELECT hi, lo, round(w) FROM e),
n AS (SELECT count(*) AS n FROM part), q AS (SELECT c_custkey AS request_id, c_nationkey AS source, c_custkey * 31 % n AS target FROM customer, n),
d(source, node, cost) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0e0 FROM q UNION (
  SELECT DISTINCT ON (x.source, e.dst) x.source, e.dst, x.cost + e.w AS c FROM d x JOIN arcs e ON e.src = x.node
  LEFT JOIN recurring.d o ON o.source = x.source AND o.node = e.dst WHERE o.cost IS NULL OR x.cost + e.w < o.cost ORDER BY x.source, e.dst, c))
SELECT request_id, cost FROM q LEFT JOIN d ON d.source = q.source AND d.node = q.target"""


def least_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and nodes of the way from a node of each customer's own to another, both anywhere in the walking network."""
    arcs = network.undirected_arcs(_edges(spark, sf_dir)).withColumnRenamed("baseline_weight", "weight")
    n = _read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    asked = _read(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).selectExpr("c_custkey AS request_id", "c_custkey * 7919 % n AS source", "c_custkey * 31 % n AS target")
    found = graph.shortest_paths(arcs, asked)
    return found.select("request_id", F.round("cost", 4).alias("cost"), F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


PATHS_SQL = EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, arcs AS (SELECT lo AS src, hi AS dst, w FROM e UNION ALL SELECT hi, lo, w FROM e),
n AS (SELECT count(*) AS n FROM part), q AS (SELECT c_custkey AS request_id, c_custkey * 7919 % n AS source, c_custkey * 31 % n AS target FROM customer, n),
d(source, node, cost, prev) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0e0, NULL::BIGINT FROM q UNION (
  SELECT DISTINCT ON (x.source, e.dst) x.source, e.dst, x.cost + e.w AS c, x.node FROM d x JOIN arcs e ON e.src = x.node
  LEFT JOIN recurring.d o ON o.source = x.source AND o.node = e.dst WHERE o.cost IS NULL OR x.cost + e.w < o.cost ORDER BY x.source, e.dst, c)),
back(request_id, source, node, path) AS (SELECT request_id, q.source, target, CAST(target AS VARCHAR) FROM q JOIN d ON d.source = q.source AND d.node = q.target
  UNION ALL SELECT request_id, b.source, d.prev, d.prev || ',' || path FROM back b JOIN d ON d.source = b.source AND d.node = b.node WHERE d.prev IS NOT NULL)
SELECT q.request_id, round(d.cost, 4) AS cost, b.path FROM q LEFT JOIN d ON d.source = q.source AND d.node = q.target
  LEFT JOIN back b ON b.request_id = q.request_id AND b.node = b.source"""


_STATE = "(p_partkey * 7919 % 1009 + 1) / 1009e0"


def flows_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of every segment by a vector over the nodes that is scaled to 250 at node 8."""
    vector = _read(spark, sf_dir, "part").selectExpr("p_partkey AS state", f"{_STATE} AS value")
    pairs = network.way_segments(_ways(spark, sf_dir)).selectExpr("way_id * 100 + pos AS polygon_id", "src AS a", "dst AS b")
    return graph.segment_flows(vector, 250.0, 8, pairs).select("polygon_id", "a", "b", F.round("flow", 6).alias("flow"))


FLOWS_SQL = f"""WITH {SEGMENTS_SQL}, v AS (SELECT p_partkey AS state, {_STATE} AS value FROM part), k AS (SELECT value AS k FROM v WHERE state = 8)
SELECT way_id * 100 + pos AS polygon_id, src AS a, dst AS b, round((x.value / k * 250e0 + y.value / k * 250e0) / 2, 6) AS flow
FROM seg JOIN v x ON x.state = src JOIN v y ON y.state = dst, k"""


def hops_from_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hop_distance(network.undirected_arcs(_edges(spark, sf_dir)), 1).select("node", "hops")


def steady_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady state over the walking network with node 1 as sink."""
    with Scratch(spark) as scratch:
        arcs = scratch.keep(network.undirected_arcs(_edges(spark, sf_dir)).select("src", "dst"))
        states = arcs.select(F.col("src").alias("state"))
        return graph.steady_state(graph.transition_matrix(arcs, 1, [2, 3, 5]), tolerance=1e-9, states=states).select("state", F.round("value", 6).alias("value"))


def network_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, doors = _nodes(spark, sf_dir), _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("building_id"))
    return network.network_summary(nodes, network.undirected_arcs(_edges(spark, sf_dir)), doors)


def network_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = network.extent(_nodes(spark, sf_dir))
    return box.select(*[F.round(c, 9).alias(c) for c in box.columns])


def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = network.adjacency(_edges(spark, sf_dir))
    return lists.select("src", F.array_join(F.transform("neighbours", lambda n: n["dst"].cast("string")), ",").alias("neighbours"))


# --- buildings
def _buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways; one in ten is a building, one in three has a name."""
    none = F.create_map().cast("map<string,string>")
    building = F.when(F.col("way_id") % 10 == 0, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(none)
    name = F.when(F.col("way_id") % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("b"), (F.col("way_id") % 50).cast("string")))).otherwise(none)
    return _ways(spark, sf_dir).withColumn("tags", F.map_concat(building, name))


def buildings_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.node_buildings(network.filter_buildings(_buildings(spark, sf_dir)))


def building_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices found and missing refs of each building."""
    found, missing = network.building_vertices(_buildings(spark, sf_dir), _nodes(spark, sf_dir))
    both = found.select("way_id", F.lit(1).alias("f")).unionByName(missing.select("way_id", F.lit(0).alias("f")))
    return both.groupBy("way_id").agg(F.sum("f").alias("n_found"), F.sum(1 - F.col("f")).alias("n_missing"))


def _doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four doors a building, whatever the scale."""
    return _read(spark, sf_dir, "supplier").selectExpr("s_suppkey div 4 AS building_id", "s_suppkey AS entrance_pos", *_columns("s_suppkey", 1013, 4001))


def _guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the number of buildings, n."""
    n = _read(spark, sf_dir, "supplier").agg(F.expr("count(*) div 4 AS n"))
    return _read(spark, sf_dir, "customer").crossJoin(F.broadcast(n))


def entrance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _guests(spark, sf_dir).selectExpr("c_custkey AS request_id", "c_custkey % n AS building_id", *_columns("c_custkey", 3001, 5003))
    ranked = routes.rank_entrances(asked.withColumnsRenamed({"lat": "y", "lon": "x"}), _doors(spark, sf_dir))
    return ranked.select("request_id", "entrance_pos", F.round("distance", 4).alias("distance"), "rank")


def cheapest_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest pair of doors between a customer's building and the next one."""
    asked = _guests(spark, sf_dir).selectExpr("c_custkey AS request_id", "c_custkey % n AS building1", "(c_custkey + 1) % n AS building2")
    pairs = routes.entrance_pairs(asked, _doors(spark, sf_dir)).selectExpr("*", "0e0 + (request_id * 7 + pos1) % 100 AS start_pixels", "0e0 + (request_id * 3 + pos2) % 100 AS end_pixels")
    ranked = routes.rank_entrance_pairs(pairs).withColumn("cost", F.round("total", 4))
    return routes.cheapest_route(ranked.select("request_id", "pos1", "pos2", "cost", "rank")).select("request_id", "cost")


def way_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = network.building_vertices(_ways(spark, sf_dir), _nodes(spark, sf_dir))
    points = found.select(F.col("way_id").alias("route_id"), "pos", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return routes.path_length(points).select("route_id", F.round("length", 4).alias("length"))


# --- polygons
_QUAD = "(o_orderkey * 31) % 997 * 1e0 AS x0, (o_orderkey * 17) % 991 * 1e0 AS y0, 5e0 + o_orderkey % 13 AS w, 7e0 + o_orderkey % 11 AS h"


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS polygon_id", *_QUAD.split(", ")).distinct()
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    ring = F.array(corner(x, y), corner(x + w, y + 1), corner(x + w + 2, y + h), corner(x - 1, y + h + 3))
    return base.select("polygon_id", F.posexplode(ring).alias("pos", "p")).select("polygon_id", "pos", "p.x", "p.y")


QUADS_SQL = f"""WITH q AS (SELECT DISTINCT o_orderkey AS polygon_id, {_QUAD} FROM orders),
v AS (SELECT polygon_id, 0 AS pos, x0 AS x, y0 AS y FROM q UNION ALL SELECT polygon_id, 1, x0 + w, y0 + 1 FROM q
  UNION ALL SELECT polygon_id, 2, x0 + w + 2, y0 + h FROM q UNION ALL SELECT polygon_id, 3, x0 - 1, y0 + h + 3 FROM q),
l AS (SELECT a.*, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS leg
  FROM v a JOIN v b ON a.polygon_id = b.polygon_id AND b.pos = (a.pos + 1) % 4)
"""


def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = _quads(spark, sf_dir)
    both = geometry.polygon_area(quads).join(geometry.polygon_centroid(quads), "polygon_id")
    return both.select("polygon_id", *[F.round(c, 4).alias(c) for c in ("area", "cx", "cy")])


def polygon_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = geometry.resample_polygon(_quads(spark, sf_dir), 7)
    return done.select("polygon_id", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def rectangle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection over union of each order's rectangle with itself moved by 3 and 2."""
    base = _read(spark, sf_dir, "orders").select("o_orderkey").distinct().selectExpr("o_orderkey AS polygon_id", *_QUAD.split(", "))

    def box(dx: float, dy: float):
        corner = lambda a, b: F.struct((F.col("x0") + dx + a).alias("x"), (F.col("y0") + dy + b).alias("y"))
        w, h = F.col("w"), F.col("h")
        return F.array(corner(F.lit(0.0), F.lit(0.0)), corner(w, F.lit(0.0)), corner(w, h), corner(F.lit(0.0), h))

    pairs = base.select("polygon_id", box(0.0, 0.0).alias("a"), box(3.0, 2.0).alias("b"))
    return geometry.polygon_overlaps(pairs, "a", "b", "polygon_id").select("polygon_id", F.round("iou", 6).alias("iou"))


# --- pixels
def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey div 400 AS image_id", "(p_partkey % 400) div 20 AS row", "p_partkey % 20 AS col", "CASE WHEN ((p_partkey * 7919) % 1009) % 10 >= 4 THEN 255 ELSE 0 END AS value"
    )


PIXELS_SQL = """WITH RECURSIVE px AS (SELECT p_partkey // 400 AS image_id, (p_partkey % 400) // 20 AS row, p_partkey % 20 AS col,
  CASE WHEN ((p_partkey * 7919) % 1009) % 10 >= 4 THEN 255 ELSE 0 END AS value FROM part)
"""


def grid_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = pixels.grid_graph(_pixels(spark, sf_dir), 8)
    return arcs.withColumn("cost", F.round("cost", 6))


def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.downsample_max(_pixels(spark, sf_dir), 3)


def dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dilate(_pixels(spark, sf_dir))


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.crop_to_content(_pixels(spark, sf_dir), 0)


def without_specks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.remove_small_components(_pixels(spark, sf_dir))


_DET = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS image_id", "l_partkey % 200 AS x", "l_orderkey % 200 AS y", "(1 + l_linenumber % 10) / 10e0 AS scale",
        "CAST(round(l_discount * 100) AS BIGINT) AS score", f"{_DET} AS det_id", "8L AS w", "8L AS h",
    )


def best_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.best_scale(_detections(spark, sf_dir)).select("image_id", "scale", F.round("mean_score", 6).alias("mean_score"))


def kept_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.nms(_detections(spark, sf_dir)).select("image_id", "det_id", "x", "y", "score")


QUERIES = {
    f.__name__: f
    for f in (
        edges_inside_polygons, edges_touching_polygons, open_edges, risk_grid, heat_grid, current_weights, nearest_node, nearest_node_early, nearest_node_wide, profile_by_weekday,
        flow_at_request, weather_at_request, components, largest_component_arcs, least_costs, least_paths, flows_of_segments, hops_from_node, steady_flow, network_totals, network_extent,
        adjacency_lists, buildings_of_nodes, building_vertices, entrance_ranks, cheapest_doors, way_lengths, polygon_measures, polygon_points,
        rectangle_overlap, grid_arcs, downsampled, dilated, cropped, without_specks, best_scales, kept_detections,
    )
}

_DAY_COLUMNS = ", ".join(f"round(max(c) FILTER (weekday = '{d}') / 10000, 4) AS {d}" for d in temporal.DAYS)
_DOORS_SQL = f"""doors AS (SELECT s_suppkey // 4 AS building_id, s_suppkey AS entrance_pos, {_at('s_suppkey', 1013, 4001)} FROM supplier),
  g AS (SELECT *, (SELECT count(*) // 4 FROM supplier) AS n FROM customer)"""
_B_SQL = f"WITH {NODES_SQL}, b AS (SELECT l_orderkey AS way_id, {REF} AS node_id FROM lineitem) "

ORACLES = {
    "edges_inside_polygons": R_SQL + "SELECT polygon_id, edge_id FROM r, z WHERE least(x1, x2) > w AND greatest(x1, x2) < e AND least(y1, y2) > s AND greatest(y1, y2) < n",
    "edges_touching_polygons": R_SQL + "SELECT polygon_id, edge_id FROM hit",
    "open_edges": R_SQL + "SELECT edge_id FROM r WHERE edge_id NOT IN (SELECT edge_id FROM hit)",
    "risk_grid": f"WITH {GRID_SQL} SELECT i, j, round(multiplier, 6) AS multiplier FROM grid",
    "heat_grid": f"WITH {GRID_SQL} SELECT i, j, round(coalesce(v, 0), 6) AS multiplier FROM (SELECT i, j, CASE WHEN multiplier = 1 AND crime IS NULL AND phone IS NULL THEN 0e0 ELSE multiplier END AS v FROM grid LEFT JOIN crimes USING (i, j) LEFT JOIN phones USING (i, j))",
    "current_weights": WEIGHTS_SQL,
    "nearest_node": NEAR_SQL + "SELECT point_id, arg_min(node_id, {'a': d, 'b': node_id}) AS node_id, round(min(d), 9) AS degrees FROM d GROUP BY point_id",
    "nearest_node_early": NEAR_SQL + """, k AS (SELECT point_id, coalesce(min(node_id) FILTER (d <= 0.0005e0), arg_min(node_id, {'a': d, 'b': node_id})) AS node_id FROM d GROUP BY point_id)
  SELECT point_id, node_id, round(d, 9) AS degrees FROM k JOIN d USING (point_id, node_id)""",
    "nearest_node_wide": NEAR_SQL + """, k AS (SELECT point_id, coalesce(min(node_id) FILTER (d <= 0.01e0), arg_min(node_id, {'a': d, 'b': node_id})) AS node_id FROM d GROUP BY point_id)
  SELECT point_id, node_id, round(d, 9) AS degrees FROM k JOIN d USING (point_id, node_id)""",
    "profile_by_weekday": f"WITH {PROFILE_SQL} SELECT slot, {_DAY_COLUMNS} FROM p GROUP BY slot",
    "flow_at_request": f"""WITH {PROFILE_SQL}, s AS (SELECT *, CAST(slot[1:2] AS BIGINT) * 3600 + CAST(slot[4:5] AS BIGINT) * 60 + CAST(slot[7:8] AS BIGINT) AS sec FROM p),
  q AS (SELECT event_id AS query_id, dayname(ts) AS weekday,
    CAST(round_even((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600e0, 0) AS BIGINT) % 24 * 3600 AS asked FROM events)
  SELECT query_id, round(arg_min(c, {{'a': abs(sec - asked), 'b': sec}}) / 10000, 4) AS avg_count FROM q JOIN s USING (weekday) GROUP BY query_id""",
    "weather_at_request": """WITH w AS (SELECT date_trunc('minute', ts) AS ts, max(value) AS wind FROM events WHERE event_type = 'signup' GROUP BY ALL)
  SELECT e.event_id AS request_id, CASE WHEN e.ts - w.ts <= INTERVAL 15 MINUTE THEN wind END AS wind FROM events e ASOF LEFT JOIN w ON e.ts >= w.ts WHERE event_type = 'purchase'""",
    "components": f"WITH RECURSIVE {LATTICE_SQL} SELECT node, component FROM cc",
    "largest_component_arcs": f"""WITH RECURSIVE {LATTICE_SQL}, top AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
  SELECT src, dst FROM one WHERE src IN (SELECT node FROM cc JOIN top USING (component))""",
    "least_costs": COSTS_SQL,
    "least_paths": PATHS_SQL,
    "flows_of_segments": FLOWS_SQL,
    "hops_from_node": EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, arcs AS (SELECT lo AS src, hi AS dst FROM e UNION SELECT hi, lo FROM e),
  h(node, hops) USING KEY (node) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM arcs WHERE src = 1 UNION (
    SELECT DISTINCT ON (a.dst) a.dst, h.hops + 1 FROM h JOIN arcs a ON a.src = h.node LEFT JOIN recurring.h o ON o.node = a.dst WHERE o.node IS NULL))
  SELECT node, hops FROM h""",
    "network_totals": EDGES_SQL + """SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM e) AS n_edges,
  (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n_buildings""",
    "network_extent": f"""WITH {NODES_SQL}, b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM nodes)
  SELECT round(a - (b - a) * 0.05e0, 9) AS min_lat, round(b + (b - a) * 0.05e0, 9) AS max_lat,
    round(c - (d - c) * 0.05e0, 9) AS min_lon, round(d + (d - c) * 0.05e0, 9) AS max_lon FROM b""",
    "adjacency_lists": EDGES_SQL + """SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM
  (SELECT lo AS src, hi AS dst FROM e UNION ALL SELECT hi, lo FROM e) GROUP BY src""",
    "buildings_of_nodes": _B_SQL + "SELECT DISTINCT node_id, CASE WHEN way_id % 3 = 0 THEN 'b' || CAST(way_id % 50 AS VARCHAR) ELSE CAST(way_id AS VARCHAR) END AS building_id FROM b WHERE way_id % 10 = 0",
    "building_vertices": _B_SQL + """SELECT way_id, count(n.node_id) AS n_found, count(*) - count(n.node_id) AS n_missing
  FROM b LEFT JOIN nodes n USING (node_id) GROUP BY way_id""",
    "entrance_ranks": f"""WITH {_DOORS_SQL}, q AS (SELECT c_custkey AS request_id, c_custkey % n AS building_id, {_at("c_custkey", 3001, 5003)} FROM g),
  d AS (SELECT request_id, entrance_pos, {_feet("q.lat", "q.lon", "e.lat", "e.lon", scalars.RADIUS_M)} AS d FROM q JOIN doors e USING (building_id))
  SELECT request_id, entrance_pos, round(d, 4) AS distance, row_number() OVER (PARTITION BY request_id ORDER BY d, entrance_pos) AS rank FROM d""",
    "cheapest_doors": f"""WITH {_DOORS_SQL}
  SELECT c_custkey AS request_id, round(min((((c_custkey * 7 + a.entrance_pos) % 100) + ((c_custkey * 3 + b.entrance_pos) % 100)) / 15e0 / 1.4e0
    + {_feet("a.lat", "a.lon", "b.lat", "b.lon", scalars.RADIUS_M)} / 1.4e0), 4) AS cost
  FROM g JOIN doors a ON a.building_id = c_custkey % n JOIN doors b ON b.building_id = (c_custkey + 1) % n GROUP BY c_custkey""",
    "way_lengths": f"""WITH {NODES_SQL}, o AS (SELECT l_orderkey AS way_id, {REF} AS node_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem),
  p AS (SELECT way_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM o JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos))
  SELECT way_id AS route_id, round(sum(coalesce({_feet("plat", "plon", "lat", "lon", scalars.RADIUS_M)} * CASE WHEN plat IS NULL THEN 0 ELSE 1 END, 0e0)), 4) AS length FROM p GROUP BY way_id""",
    "polygon_measures": QUADS_SQL + """, s AS (SELECT polygon_id, sum(x * y2 - x2 * y) AS s, sum((x + x2) * (x * y2 - x2 * y)) AS sx, sum((y + y2) * (x * y2 - x2 * y)) AS sy FROM l GROUP BY polygon_id)
  SELECT polygon_id, round(abs(s) / 2, 4) AS area, round(sx / (3 * s), 4) AS cx, round(sy / (3 * s), 4) AS cy FROM s""",
    "polygon_points": QUADS_SQL + """, c AS (SELECT *, sum(leg) OVER (PARTITION BY polygon_id ORDER BY pos) AS fin, sum(leg) OVER (PARTITION BY polygon_id) AS total FROM l),
  t AS (SELECT polygon_id, k, k * total / 7 AS mark, min(pos) AS pos FROM c, range(7) r(k) WHERE k * total / 7 < fin GROUP BY ALL)
  SELECT polygon_id, k, round(x + (x2 - x) * (mark - (fin - leg)) / leg, 4) AS x, round(y + (y2 - y) * (mark - (fin - leg)) / leg, 4) AS y FROM t JOIN c USING (polygon_id, pos)""",
    "rectangle_overlap": QUADS_SQL + "SELECT polygon_id, round((w - 3) * (h - 2) / (2 * w * h - (w - 3) * (h - 2)), 6) AS iou FROM q",
    "grid_arcs": PIXELS_SQL + """SELECT a.image_id, a.row, a.col, b.row AS to_row, b.col AS to_col, CASE WHEN a.row <> b.row AND a.col <> b.col THEN round(sqrt(2e0), 6) ELSE 1e0 END AS cost
  FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) WHERE a.value = 255 AND b.value = 255""",
    "downsampled": PIXELS_SQL + "SELECT image_id, row // 3 AS row, col // 3 AS col, max(value) AS value FROM px GROUP BY 1, 2, 3 HAVING count(*) = 9",
    "dilated": PIXELS_SQL + "SELECT a.image_id, a.row, a.col, max(b.value) AS value FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3",
    "cropped": PIXELS_SQL + """, b AS (SELECT image_id, min(row) AS a, max(row) AS b, min(col) AS c, max(col) AS d FROM px WHERE value <= 240 GROUP BY image_id)
  SELECT image_id, row - a AS row, col - c AS col, value FROM px JOIN b USING (image_id) WHERE row BETWEEN a AND b.b AND col BETWEEN c AND d""",
    "without_specks": PIXELS_SQL + """, n AS (SELECT *, image_id * 400 + row * 20 + col AS id FROM px WHERE value = 255),
  arcs AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
  cc(node, component) USING KEY (node) AS (SELECT id, id FROM n UNION (
    SELECT DISTINCT ON (p.node) p.node, c.component FROM recurring.cc p JOIN arcs e ON e.src = p.node JOIN cc c ON c.node = e.dst WHERE c.component < p.component ORDER BY p.node, c.component)),
  s AS (SELECT node FROM cc WHERE component IN (SELECT component FROM cc GROUP BY component HAVING count(*) <= 3))
  SELECT image_id, row, col, CASE WHEN image_id * 400 + row * 20 + col IN (SELECT node FROM s) THEN 255 - value ELSE value END AS value FROM px""",
    "best_scales": """WITH m AS (SELECT l_suppkey AS image_id, (1 + l_linenumber % 10) / 10e0 AS scale, avg(CAST(round(l_discount * 100) AS BIGINT)) AS a FROM lineitem GROUP BY ALL)
  SELECT image_id, arg_max(scale, {'a': a, 'b': -scale}) AS scale, round(max(a), 6) AS mean_score FROM m WHERE a > 0 GROUP BY image_id""",
    "steady_flow": EDGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT lo AS src, hi AS dst FROM e UNION SELECT hi, lo FROM e),
  h(node, hops) USING KEY (node) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM a WHERE src = 1 UNION (
    SELECT DISTINCT ON (a.dst) a.dst, h.hops + 1 FROM h JOIN a ON a.src = h.node LEFT JOIN recurring.h o ON o.node = a.dst WHERE o.node IS NULL)),
  k AS (SELECT src, dst, bool_and(src = dst) OVER s AS alone, bool_or(dst = 1) OVER s AS sinks, sum(CASE WHEN dst <> 1 THEN 1 ELSE 0 END) OVER s AS n,
    coalesce(hops, 0) * CASE WHEN dst IN (2, 3, 5) THEN 1.5e0 ELSE 1e0 END AS pull FROM a LEFT JOIN h ON h.node = a.dst WINDOW s AS (PARTITION BY src)),
  m AS (SELECT src, dst, CASE WHEN alone THEN 1e0 WHEN sinks AND dst = 1 THEN 0.5e0 WHEN sinks THEN 0.5e0 / n ELSE pull / sum(pull) OVER (PARTITION BY src) END AS share FROM k),
  st AS (SELECT src AS state FROM a UNION SELECT dst FROM a), c AS (SELECT count(*) AS n FROM st),
  p(it, state, v) AS (SELECT 0, state, 1e0 / n FROM st, c UNION ALL (
    SELECT it, state, raw / sum(raw) OVER () FROM (
      SELECT (SELECT max(it) + 1 FROM p) AS it, st.state, 0.9e0 * coalesce(sum(x.w), 0e0) + 0.1e0 / any_value(n) AS raw
      FROM st CROSS JOIN c LEFT JOIN (SELECT m.dst, m.share * p.v AS w FROM p JOIN m ON m.src = p.state) x ON x.dst = st.state GROUP BY st.state) WHERE it <= 200)),
  z AS (SELECT state, v FROM p WHERE it = 200)
  SELECT state, round(v / sqrt(sum(v * v) OVER ()), 6) AS value FROM z""",
    "kept_detections": f"""WITH RECURSIVE t AS (SELECT l_suppkey AS image_id, l_partkey % 200 AS x, l_orderkey % 200 AS y, CAST(round(l_discount * 100) AS BIGINT) AS score, {_DET} AS det_id FROM lineitem),
  over AS (SELECT a.image_id, a.det_id, b.det_id AS strong FROM t a JOIN t b ON a.image_id = b.image_id AND (b.score > a.score OR b.score = a.score AND b.det_id < a.det_id)
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100),
  ids AS (SELECT DISTINCT image_id, det_id FROM t),
  f(it, image_id, det_id, said) AS (SELECT 0, image_id, det_id, 'open' FROM ids UNION ALL (
    SELECT any_value(f.it) + 1, f.image_id, f.det_id, CASE WHEN any_value(f.said) <> 'open' THEN any_value(f.said) WHEN bool_or(g.said = 'kept') THEN 'gone'
      WHEN bool_and(g.said IS NULL OR g.said = 'gone') THEN 'kept' ELSE 'open' END
    FROM f LEFT JOIN over o ON o.image_id = f.image_id AND o.det_id = f.det_id LEFT JOIN f g ON g.image_id = o.image_id AND g.det_id = o.strong
    WHERE f.it < 40 GROUP BY f.image_id, f.det_id))
  SELECT image_id, det_id, x, y, score FROM t JOIN f USING (image_id, det_id) WHERE it = 40 AND said = 'kept'""",
}
