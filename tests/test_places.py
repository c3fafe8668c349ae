"""Joins by place and time, groups of pixels and places of nodes against plain versions."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stridefield.operators import network, pixels, spatial, temporal

POINTS, NODES = "point_id long, x double, y double", "node_id long, x double, y double, ord long"


def nearest(points, nodes, radius):
    out = {}
    for p, x, y in points:
        if x is None or y is None:
            continue
        away = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), o, n) for n, a, b, o in nodes]
        inside = [(o, n, d) for d, o, n in away if radius is not None and d <= radius]
        out[p] = min(inside)[1] if inside else min(away)[2]
    return out


@pytest.mark.parametrize("radius", [None, 0.3, 5.0])
def test_nearest_with_a_hot_cell(spark, radius):
    """Half of the nodes in a millionth of the map, many at one place, equal distances, points far outside, null coordinates."""
    r = random.Random(1)
    nodes = [(i, r.random() * 10, r.random() * 10) for i in range(300)] + [(i, 5 + r.random() / 1e4, 5 + r.random() / 1e4) for i in range(300, 600)]
    nodes += [(i, 2.5, 2.5) for i in range(600, 700)] + [(i, float(i % 5), float(i // 5 % 5)) for i in range(700, 725)]
    nodes = [(*n, (n[0] * 37) % 1000) for n in nodes]
    points = [(i, r.random() * 12 - 1, r.random() * 12 - 1) for i in range(150)] + [(i, 5 + r.random() / 1e4, 5 + r.random() / 1e4) for i in range(150, 200)]
    points += [(200 + i, i % 5 + 0.5, i // 5 + 0.5) for i in range(20)] + [(300, 1e4, -1e4), (301, None, 1.0), (302, 2.5, 2.5), (303, 1.0, None)]
    got = spatial.nearest_nodes(spark.createDataFrame(points, POINTS), spark.createDataFrame([*nodes, (999, None, 1.0, 0)], NODES), radius).collect()
    assert {g.point_id: g.node_id for g in got} == nearest(points, nodes, radius) and len(got) == len(points) - 2
    at = {n: (x, y) for n, x, y, _ in nodes}
    for g in got:
        x, y = next((x, y) for p, x, y in points if p == g.point_id)
        assert g.degrees == pytest.approx(math.dist((x, y), at[g.node_id]))


def test_nearest_over_many_tiles(spark, monkeypatch):
    """Tiles of few nodes, hot ones dealt to several tasks: answers beyond a point's own tile, ties between tiles, and a node is searched in a bounded tile only."""
    monkeypatch.setattr(spatial, "TILE_NODES", 8)
    monkeypatch.setattr(spatial, "TILE_POINTS", 20)
    r = random.Random(3)
    nodes = [(i, r.random() * 10, r.random() * 10) for i in range(150)] + [(i, float(i % 5), float(i // 5 % 5)) for i in range(150, 175)] + [(i, 2.5, 2.5) for i in range(175, 250)]
    nodes = [(*n, (n[0] * 37) % 1000) for n in nodes]
    points = [(i, r.random() * 12 - 1, r.random() * 12 - 1) for i in range(150)] + [(200 + i, i % 5 + 0.5, i // 5 + 0.5) for i in range(20)] + [(300 + i, 2.0, 2.0 + i / 1e6) for i in range(70)]
    frames = spark.createDataFrame(points, POINTS), spark.createDataFrame(nodes, NODES)
    for radius in (None, 0.8, 6.0):
        got = spatial.nearest_nodes(*frames, radius).collect()
        assert {g.point_id: g.node_id for g in got} == nearest(points, nodes, radius) and len(got) == len(points)


def test_nearest_of_one_node_and_of_none(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], POINTS)
    one = spark.createDataFrame([(5, 3.0, 4.0, 1)], NODES)
    assert {(g.point_id, g.node_id, g.degrees) for g in spatial.nearest_nodes(points, one, 5.0).collect()} == {(1, 5, 5.0), (2, 5, math.dist((9, 9), (3, 4)))}
    assert spatial.nearest_nodes(points, one.limit(0)).count() == 0 and spatial.nearest_nodes(points.limit(0), one).count() == 0


def test_dense_cells_are_divided(spark):
    """No leaf has more nodes than it may, unless they share a place."""
    from stridefield.operators.lineage import Scratch

    nodes = spark.range(4000).selectExpr("id AS node_id", "CASE WHEN id % 2 = 0 THEN id * 1e-9 ELSE id % 63 END AS x", "CASE WHEN id % 2 = 0 THEN id * 1e-9 ELSE id div 63 END AS y", "id AS ord")
    with Scratch(spark) as scratch:
        cells = spatial._Cells(nodes, scratch)
        sizes = cells.homes.groupBy("level", "cx", "cy").count()
        assert sizes.agg(F.max("count")).first()[0] <= spatial.CELL_NODES and sizes.agg(F.sum("count")).first()[0] == 4000


@pytest.mark.parametrize("mode", ["contains", "intersects"])
def test_one_wide_polygon_among_small_ones(spark, mode):
    r = random.Random(6)
    box = lambda x, y, w, h: [(y, x), (y, x + w), (y + h, x + w), (y + h, x)]  # noqa: E731  (lat, lon)
    polygons = [(i, box(r.uniform(-3, 3), r.uniform(-3, 3), 10 ** r.uniform(-3, -0.5), 10 ** r.uniform(-3, -0.5))) for i in range(60)]
    polygons += [(100, box(-170.0, -80.0, 340.0, 160.0)), (101, box(0.0, 0.0, 1.0, 1.0)), (102, [(0.0, 0.0), (1.0, 1.0)]), (103, box(-8.0, -8.0, 8.0, 8.0))]
    edges = [(i, x, y, x + r.gauss(0, 1) * s, y + r.gauss(0, 1) * s) for i in range(150) for x, y, s in [(r.uniform(-4, 4), r.uniform(-4, 4), 10 ** r.uniform(-3, 1))]]
    edges += [(200, 0.5, 0.5, 0.5, 0.5), (201, -300.0, 0.0, 300.0, 0.0), (202, 1.0, 0.0, 1.0, 1.0)]

    def hit(ring, x1, y1, x2, y2):
        """All rings here are upright boxes."""
        (s, w), _, (n, e), _ = ring
        if mode == "contains":
            return w < min(x1, x2) and max(x1, x2) < e and s < min(y1, y2) and max(y1, y2) < n
        low, high = 0.0, 1.0
        for p, d, a, b in ((x1, x2 - x1, w, e), (y1, y2 - y1, s, n)):
            if d == 0:
                if not a <= p <= b:
                    return False
            else:
                t, u = sorted(((a - p) / d, (b - p) / d))
                low, high = max(low, t), min(high, u)
        return low <= high

    want = {(p, e[0]) for p, ring in polygons if len(ring) > 2 for e in edges if hit(ring, *e[1:])}
    left = spark.createDataFrame(edges, "edge_id long, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame(polygons, "polygon_id int, ring array<struct<lat:double,lon:double>>")
    got = [tuple(x) for x in spatial.edges_in_polygons(left, right, mode).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert spatial.edges_in_polygons(left.limit(0), right, mode).count() == spatial.edges_in_polygons(left, right.limit(0), mode).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_small_groups_of_pixels(spark, k):
    r = random.Random(k)
    white = {(i, j): 255 if r.random() < 0.28 else 0 for i in range(24) for j in range(24)}
    seen, small = set(), set()
    for start in (p for p, v in white.items() if v):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            a, b = todo.pop()
            for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if white.get(p) and p not in group:
                    group.add(p)
                    todo.append(p)
        seen |= group
        small |= group if len(group) <= k else set()
    df = spark.createDataFrame([("i", a, b, v) for (a, b), v in white.items()], "image_id string, row int, col int, value int")
    got = {(x.row, x.col): x.value for x in pixels.remove_small_components(df, k).collect()}
    assert got == {p: 0 if p in small else v for p, v in white.items()} and small


def test_readings_are_carried_over_parts(spark):
    """A minute with most of the requests, long gaps, readings before all requests and after them, null times."""
    r, start = random.Random(2), datetime(2024, 1, 1)
    readings = [(start + timedelta(seconds=r.randrange(90_000)), float(i)) for i in range(60)] + [(None, 1.0), (start + timedelta(seconds=50_000), 0.5), (start + timedelta(seconds=50_000), 0.7)]
    asked = [(i, start + timedelta(seconds=r.randrange(-500, 100_000))) for i in range(300)] + [(1000 + i, start + timedelta(seconds=50_000, milliseconds=r.randrange(60_000))) for i in range(700)] + [(5000, None)]

    def want(t):
        if t is None:
            return None
        old = [(s, w) for s, w in readings if s is not None and s <= t]
        return max(old)[1] if old and t - max(old)[0] <= timedelta(hours=1) else None

    requests, known = spark.createDataFrame(asked, "request_id long, ts timestamp").repartition(5), spark.createDataFrame(readings, "ts timestamp, wind double")
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = temporal.weather_asof(requests, known).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {x.request_id: x.wind for x in got} == {i: want(t) for i, t in asked} and len(got) == len(asked)
    assert {x.wind for x in temporal.weather_asof(requests, known.limit(0)).collect()} == {None}
    assert temporal.weather_asof(requests.limit(0), known).count() == 0


def test_places_of_nodes(spark):
    nodes = [(5, 1.0, 1.0, True, "Outdoor"), (3, 1.0, 1.0, True, "Outdoor"), (4, 1.0, 1.0, False, "b"), (9, 0.0, 7.0, True, "Outdoor"), (8, 0.0, 7.0, True, "Outdoor")]
    df = spark.createDataFrame(nodes, "node_id long, x double, y double, use_global_coords boolean, building_id string")
    assert {(r.node_id, r.place_id) for r in network.place_ids(df).collect()} == {(5, 3), (3, 3), (4, 4), (9, 8), (8, 8)}
    assert {r.node_id for r in network.places(df).collect()} == {3, 4, 8}
    segments = spark.createDataFrame([(1, 0, 5, 9, 2.0), (1, 1, 8, 3, 1.0), (2, 0, 3, 5, 4.0), (2, 1, 4, 9, 5.0)], "way_id long, pos int, src long, dst long, baseline_weight double")
    # the place at x = 0 comes first, whatever its id; of both segments between 3 and 8 the first one counts
    assert {tuple(r) for r in network.edges_between_places(segments, df).collect()} == {(8, 3, 2.0), (3, 3, 4.0), (8, 4, 5.0)}


def test_detections_are_cut_to_the_image_and_all_is_inverted(spark):
    plan = spark.createDataFrame([("i", r, c, 255 if c else 0) for r in range(3) for c in range(3)], "image_id string, row int, col int, value int")
    boxes = spark.createDataFrame([("i", -1, -1, 5, 5, 0.5), ("i", 2, 2, 9, 9, 1.0), ("i", 1, 1, 1, 1, 0.9)], "image_id string, x int, y int, w int, h int, scale double")
    got = {(r.row, r.col): r.value for r in pixels.remove_detections(plan, boxes).collect()}
    dark = {(0, 0), (2, 2)}
    assert got == {(r, c): 255 - (0 if (r, c) in dark or not c else 255) for r in range(3) for c in range(3)}


def test_few_polygons_meet_edges_without_a_shuffle(spark, monkeypatch):
    """Polygons that go to all workers give what the join by cells gives, and no plan of theirs has a shuffle or a lambda."""
    r = random.Random(4)
    edges = [(i, *[r.randrange(0, 12) / 2 for _ in range(4)]) for i in range(200)]
    rings = [(k, [(r.randrange(12) / 2, r.randrange(12) / 2) for _ in range(r.randrange(2, 6))]) for k in range(12)]
    left = spark.createDataFrame(edges, "edge_id long, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame(rings, "polygon_id long, ring array<struct<lat:double,lon:double>>")
    for mode in ("contains", "intersects"):
        few = spatial.edges_in_polygons(left, right, mode)
        assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(spatial, "FEW_POLYGONS", 0)
            joined = spatial.edges_in_polygons(left, right, mode)
            assert sorted(map(tuple, few.collect())) == sorted(map(tuple, joined.collect()))
    touched = {x.edge_id for x in few.collect()}
    assert {x.edge_id for x in spatial.apply_closures(left, right).collect()} == {e[0] for e in edges} - touched


def test_first_of_a_pair_is_found_without_a_sort(spark):
    """Segments are told apart by hash, by way and then by position, also below 0; other kinds of ids still work."""
    rows = [(5, 1, 1, 2, 50.0), (5, 0, 2, 1, 40.0), (-7, 3, 1, 2, 30.0), (-7, 2, 2, 1, 20.0), (9, 0, 3, 3, 10.0)]
    weighted = spark.createDataFrame(rows, "way_id long, pos int, src long, dst long, baseline_weight double")
    nodes = spark.createDataFrame([(k, float(k), 0.0, True, "Outdoor") for k in (1, 2, 3)], "node_id long, x double, y double, use_global_coords boolean, building_id string")
    want = {(1, 2, 20.0), (3, 3, 10.0)}
    for found in (network.distinct_edges(weighted), network.edges_between_places(weighted, nodes)):
        assert {tuple(r) for r in found.collect()} == want
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    named = weighted.withColumn("way_id", F.concat(F.lit("w"), F.col("way_id") + 10))
    assert {tuple(r) for r in network.distinct_edges(named).collect()} == {(1, 2, 40.0), (3, 3, 10.0)}
