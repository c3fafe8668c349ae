"""Hand cases and brute-force versions of what SQL does not check."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import geometry, graph, network, pixels, spatial, temporal, weights
from stridefield.sources import maps


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_map_readers_round_trip(spark, tmp_path):
    (tmp_path / "m.osm").write_text(
        '<osm><node id="1" lat="38.5" lon="-121.7"><tag k="entrance" v="main"/><tag k="entrance" v="side"/></node><node id="2" lat="38.6" lon="-121.8"/>'
        '<way id="7"><nd ref="2"/><nd ref="1"/><tag k="highway" v="footway"/></way></osm>'
    )
    nodes, ways = maps.read_osm_nodes(spark, str(tmp_path / "m.osm")), maps.read_osm_ways(spark, str(tmp_path / "m.osm"))
    assert rows(nodes.select("node_id", "lat", "lon", F.col("tags")["entrance"])) == [(1, 38.5, -121.7, "side"), (2, 38.6, -121.8, None)]
    assert rows(ways.select("way_id", "node_refs")) == [(7, [2, 1])]
    maps.write_osm(ways, str(tmp_path / "out"), "way")
    assert rows(maps.read_osm_ways(spark, str(tmp_path / "out")).select("way_id", "node_refs", F.col("tags")["highway"])) == [(7, [2, 1], "footway")]


def test_zones_counts_points_vectors(spark, tmp_path):
    (tmp_path / "z.csv").write_text("1,2,3,4,5,6\n1,2\n")
    assert [tuple(map(tuple, r.ring)) for r in maps.read_zone_csv(spark, str(tmp_path / "z.csv")).collect()] == [((1.0, 2.0), (3.0, 4.0), (5.0, 6.0))]
    (tmp_path / "z.json").write_text(
        '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]}},'
        '{"geometry":{"type":"Polygon","coordinates":[[[10,1],[11,1],[11,2]],[[0,0],[0,1],[1,1]]]}}]}'
    )
    assert [tuple(map(tuple, r.ring)) for r in maps.read_zone_geojson(spark, str(tmp_path / "z.json")).collect()] == [((1.0, 10.0), (1.0, 11.0), (2.0, 11.0))]
    (tmp_path / "c.csv").write_text("title\nsecond\n1/2/2024,8:15,4\n1/2/2024,x,5\n1/2/2024,9:00,many\n")
    found = temporal.with_weekday_slot(temporal.clean_counts(maps.read_counts(spark, str(tmp_path / "c.csv"))))
    assert rows(found.select("weekday", "slot", "count")) == [("Tuesday", "08:15:00", 4.0)]
    vector = spark.createDataFrame([(0, 0.25), (1, -1e-9)], "state int, value double")
    maps.write_vector(vector, str(tmp_path / "v"))
    assert rows(maps.read_vector(spark, str(tmp_path / "v"))) == [(0, 0.25), (1, -1e-9)]


def test_paths_match_dijkstra(spark):
    rng = random.Random(5)
    arcs = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 9))) for _ in range(70)]
    asked = [(k, rng.randrange(30), rng.randrange(30)) for k in range(12)]
    found = graph.shortest_paths(spark.createDataFrame(arcs, "src long, dst long, weight double"), spark.createDataFrame(asked, "request_id long, source long, target long"))
    cost = {}
    for _, s, _ in asked:
        best, heap = {}, [(0.0, s)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in best:
                best[n] = c
                for a, b, w in arcs:
                    if a == n:
                        heapq.heappush(heap, (c + w, b))
        cost[s] = best
    for r in found.collect():
        assert r.cost == cost[r.source].get(r.target)
        if r.cost is None:
            assert r.path is None
        else:
            assert r.path[0] == r.source and r.path[-1] == r.target
            assert sum(min(w for a, b, w in arcs if (a, b) == leg) for leg in zip(r.path, r.path[1:], strict=False)) == r.cost
    assert found.count() == len(asked)


def test_concave_polygon_and_border(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (2.0, 2.0)]  # (lat, lon)
    polygons = spark.createDataFrame([(1, ring), (2, [])], "polygon_id int, ring array<struct<lat:double,lon:double>>")
    edges = spark.createDataFrame(
        [(1, 1.0, 0.5, 3.0, 0.5), (2, 0.5, 2.0, 1.0, 2.0), (3, 2.5, 1.0, 3.0, 1.0), (4, 4.0, -1.0, 4.0, 5.0), (5, 9.0, 9.0, 9.5, 9.5), (6, -1.0, 3.0, 6.0, 3.0)],
        "edge_id long, x1 double, y1 double, x2 double, y2 double",
    )
    assert rows(spatial.edges_in_polygons(edges, polygons, "contains")) == [(1, 1), (1, 3)]
    assert rows(spatial.edges_in_polygons(edges, polygons)) == [(1, 1), (1, 3), (1, 4), (1, 6)]
    assert spatial.apply_closures(edges, polygons).count() == 2


def test_overlap_of_concave_rings(spark):
    ring = lambda points: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    ell = ring([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])
    square = ring([(1, 1), (3, 1), (3, 3), (1, 3)])
    turned = ring([(1, 1), (1, 3), (3, 3), (3, 1)])
    got = spark.range(1).select(*[geometry.polygon_iou(a, b).alias(n) for n, a, b in (("a", ell, square), ("b", turned, ell), ("c", ell, ell), ("d", ell, ring([(9, 9), (10, 9), (10, 10)])))]).first()
    assert tuple(got) == pytest.approx((3 / 13, 3 / 13, 1.0, 0.0))


def test_alignment_finds_the_turn(spark):
    shape = [(-3.0, -1.0), (3.0, -1.0), (3.0, 0.5), (-1.0, 2.0)]
    c, s = math.cos(math.radians(-40)), math.sin(math.radians(-40))
    plan = [(x * c - y * s, x * s + y * c) for x, y in shape]
    pairs = spark.createDataFrame([("b", shape, plan)], "building_id string, outline array<struct<x:double,y:double>>, plan array<struct<x:double,y:double>>")
    found = geometry.best_alignment(pairs, 20).first()
    assert (found.angle, found.reflected) == (40, False) and found.iou == pytest.approx(1.0)


def jagged(rng, n):
    """A concave star-shaped ring."""
    return np.array([(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [1 + rng.random()]])


def test_sweep_equals_all_pairs_of_sides():
    """Concave rings up to 1,000 points, both directions, shared corners, upright sides, far apart."""
    def under(p, q):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = *p, *q
        left, right = max(min(ax, bx), min(cx, dx)), min(max(ax, bx), max(cx, dx))
        if right <= left:
            return 0.0
        f = lambda x: ay + (by - ay) * (x - ax) / (bx - ax) + 9
        g = lambda x: cy + (dy - cy) * (x - cx) / (dx - cx) + 9
        cross = [x for x in [left + (right - left) * (f(left) - g(left)) / ((f(left) - g(left)) - (f(right) - g(right)))] if left < x < right] if (f(left) - g(left)) * (f(right) - g(right)) < 0 else []
        ends = [left, *cross, right]
        area = sum((b - a) * (min(f(a), g(a)) + min(f(b), g(b))) / 2 for a, b in zip(ends, ends[1:], strict=False))
        return math.copysign(1, bx - ax) * math.copysign(1, dx - cx) * area

    def pairwise(a, b):
        sides = lambda r: list(zip(r.tolist(), np.roll(r, -1, 0).tolist(), strict=True))
        return abs(sum(under(p, q) for p in sides(a) for q in sides(b)))

    rng = random.Random(8)
    grid = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], float)
    pairs = [(jagged(rng, n), jagged(rng, m)[::way] + at) for n, m, way, at in ((7, 9, 1, 0.3), (30, 50, -1, 0.0), (12, 12, 1, 9.0), (300, 200, -1, 0.5))]
    pairs += [(grid, grid), (grid, grid[::-1] + 1), (grid, grid + (0, 2)), (grid, np.array([(0.0, 4.0), (4, 4), (4, 9)]))]
    for a, b in pairs:
        got = geometry.shared_area(geometry._sides_by_x(a), geometry._sides_by_x(b))
        assert got == pytest.approx(pairwise(a, b), abs=1e-9)
    big = jagged(rng, 1000)
    assert geometry.shared_area(geometry._sides_by_x(big), geometry._sides_by_x(big)) == pytest.approx(geometry.ring_area(big), rel=1e-12)


def test_short_polygons_are_errors(spark):
    two = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0)], "polygon_id int, pos int, x double, y double")
    with pytest.raises(Exception, match="three vertices"):
        geometry.resample_polygon(two, 4).collect()
    with pytest.raises(Exception, match="without area"):
        geometry.polygon_centroid(two).collect()


def test_suppression_matches_greedy(spark):
    rng = random.Random(3)
    boxes = [(k % 3, k, rng.randrange(60), rng.randrange(60), rng.randrange(5), 4, 4) for k in range(150)]
    found = pixels.nms(spark.createDataFrame(boxes, "image_id int, det_id long, x int, y int, score int, w int, h int"))
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[4], b[1])):
        if all(k[0] != b[0] or math.hypot(k[2] - b[2], k[3] - b[3]) > 10 for k in kept):
            kept.append(b)
    assert sorted(r.det_id for r in found.collect()) == sorted(b[1] for b in kept)


def test_pixels_by_hand(spark):
    image = spark.createDataFrame([("a", r, c, 255 if (r, c) in {(0, 0), (1, 1)} else 0) for r in range(3) for c in range(3)], "image_id string, row int, col int, value int")
    assert pixels.grid_graph(image, 4).count() == 0 and pixels.grid_graph(image, 8).count() == 2
    assert pixels.remove_small_components(image).filter("value = 255").count() == 0
    assert pixels.erase_boxes(image, spark.createDataFrame([("a", 1, 0, 2, 1)], "image_id string, x int, y int, w int, h int")).filter("value = 255").count() == 4
    with pytest.raises(Exception, match="neither 0 nor 255"):
        pixels.walkable(image.withColumn("value", F.lit(7))).collect()


def test_steady_state_and_flows(spark):
    arcs = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3)], "src long, dst long")
    matrix = graph.transition_matrix(arcs, 0, [1])
    assert {r.src: round(r.s, 9) for r in matrix.groupBy("src").agg(F.sum("share").alias("s")).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    vector = graph.steady_state(matrix)
    assert sum(r.value**2 for r in vector.collect()) == pytest.approx(1.0)
    pairs = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "polygon_id int, a long, b long")
    assert rows(graph.segment_flows(vector, 10.0, 0, pairs).select("polygon_id", "flow"))[0] == (1, pytest.approx(10.0))


def test_weights_from_baseline(spark):
    edges = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, math.pi)], "edge_id long, baseline_weight double, bearing double")
    flows = spark.createDataFrame([(1, 50.0), (1, 50.0)], "edge_id long, flow double")
    weather = spark.createDataFrame([(1, 20.0, 0.0, 1.0)], "ts long, wind_speed double, wind_direction double, precipitation double")
    assert rows(weights.edge_weights(edges, flows).select("edge_id", "weight")) == [(1, 20.0), (2, 10.0)]
    assert rows(weights.edge_weights(edges, weather=weather).select("edge_id", F.round("weight", 6))) == [(1, 40.0), (2, 0.0)]


def test_missing_coordinates_give_null(spark):
    assert spark.range(1).select(scalars.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_utm(spark):
    at = spark.range(1).select(scalars.utm_zone(F.lit(-121.75)).alias("z"), scalars.utm_epsg(F.lit(-121.75), F.lit(38.54)).alias("e"), scalars.utm_project(F.lit(-123.0), F.lit(0.0), F.lit(10)).alias("p")).first()
    assert (at.z, at.e) == (10, 32610) and tuple(at.p) == pytest.approx((500000.0, 0.0), abs=1e-6)
    # the meridian arc from the equator to 45 degrees is 4,984,944.378 m on this ellipsoid
    arc = spark.range(1).select(scalars.utm_project(F.lit(-123.0), F.lit(45.0), F.lit(10)).alias("p")).first().p.northing
    assert arc / 0.9996 == pytest.approx(4984944.378, abs=0.01)


# The states that each state leads to (the last is the sink), and the published steady vector
FLOW_ARCS = [
    [4, 37], [2, 37], [1, 5], [6, 37], [0, 5, 21], [2, 4, 6, 14], [3, 5, 7, 10], [6, 8, 11], [7, 8, 12], [8, 37], [6, 11, 15], [7, 10, 12, 16],
    [8, 11, 13, 19], [12, 37], [5, 15, 24], [10, 14, 16, 17], [11, 15, 18], [15, 18, 26], [16, 17, 19, 27], [12, 18, 20, 28], [19, 37], [22, 37],
    [4, 21, 23], [22, 24, 30], [14, 23, 25], [24, 26, 31], [17, 25, 27, 32], [18, 26, 28], [19, 27, 29], [28, 37], [23, 31, 35], [24, 30, 32],
    [25, 31, 33, 36], [34, 37], [30, 33, 35], [32, 34, 36], [36, 37], [37],
]
FLOW_VALUES = """1.509932437447518080e-02
1.467028032397122046e-02
3.573342821105624650e-02
1.552674111541088066e-02
4.532906663438272116e-02
1.466747388456740298e-01
9.683193063783811227e-02
9.600019801153572563e-02
5.760438705291810041e-02
8.822992071252843890e-03
8.070499219881059616e-02
9.854513019178129385e-02
5.506213957605743392e-02
1.432920602885858624e-02
2.164497849310203503e-01
2.018701326905072979e-01
1.006435829959344136e-01
1.015054258741207444e-01
9.813618447245439635e-02
6.423590230127261547e-02
1.604953108014603447e-02
1.980060867477495545e-02
3.134189533533218025e-02
8.316384609152016605e-02
1.835042421428063619e-01
8.490298371024070090e-02
1.017770409849806101e-01
8.686407342345188465e-02
4.589146591408459208e-02
1.368208846215591967e-02
5.614384188810805226e-02
5.918826441039780339e-02
4.277371543662315811e-02
1.776166080424351409e-02
2.751083830913699999e-02
2.970860798881828566e-02
3.451378999247323165e-02
8.543829238874589560e-01"""


def test_published_steady_vector(spark):
    arcs = spark.createDataFrame([(i, j) for i, ends in enumerate(FLOW_ARCS) for j in ends], "src long, dst long")
    matrix = graph.transition_matrix(arcs, 37, [5, 6, 7, 14, 15, 19, 24, 26, 27], directed=True)
    found = {r.state: r.value for r in graph.steady_state(matrix).collect()}
    assert all(abs(found[i] - float(v)) < 1e-9 for i, v in enumerate(FLOW_VALUES.split()))


def test_components_of_a_long_path(spark):
    """A path of 5,000 nodes in the order of its ids and one in a mixed order: few rounds, and size estimates stay small."""
    n = 5000
    rows = [(i, i + 1) for i in range(n - 1)] + [(n + i * 7919 % n, n + (i + 1) * 7919 % n) for i in range(n - 1)]
    arcs = spark.createDataFrame(rows, "src long, dst long")
    found = graph.connected_components(arcs)
    assert sorted((r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()) == [(0, n), (n, n)]
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**11


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "point_id long, x double, y double")
    assert spatial.nearest_nodes(none, spark.createDataFrame([], "node_id long, x double, y double, ord long")).count() == 0
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert network.extent(spark.createDataFrame([(1, 2.0, 3.0)], "node_id long, lat double, lon double")).first().max_lat == 2.001


def test_small_rings_are_measured_together(spark):
    """Batches of rings of several sizes, upright sides and both directions: many rows at a time give the sweep's areas, and no row is measured alone."""
    rng = np.random.default_rng(2)
    corners = lambda n: np.sort(rng.random(n)) * 2 * np.pi
    rings = lambda n: [(3 + 2 * rng.random(n)[:, None]) * np.stack((np.cos(t := corners(n)), np.sin(t)), 1) + rng.integers(-2, 3, 2) for _ in range(20)]
    box = np.array([(0.0, -1.0), (4.0, -1.0), (4.0, 2.0), (0.0, 2.0)])
    for n, m in ((3, 5), (6, 6), (4, 9)):
        p, q = np.stack(rings(n)), np.stack(rings(m))[:, ::-1]
        want = [geometry._ratio(geometry.shared_area(geometry._sides_by_x(a), geometry._sides_by_x(b)), geometry.ring_area(a) + geometry.ring_area(b)) for a, b in zip(p, q)]
        assert geometry._stacked_overlaps(p, q) == pytest.approx(want, abs=1e-9)
    assert geometry._stacked_overlaps(box[None], (box + (2, 1))[None])[0] == pytest.approx(4 / 20)
