"""Indoor, grid and case routes on small fixtures."""

import math

import pytest

from stridefield.operators import grid_routes, routes

ROOM = ["#####", "#...#", "#.#.#", "#.#.#", "#####", "..#.."]


def pixels(spark, image="1"):
    rows = [(image, r, c, 255 if x == "." else 0) for r, line in enumerate(ROOM) for c, x in enumerate(line)]
    return spark.createDataFrame(rows, "image_id string, row int, col int, value int")


def test_indoor_and_grid(spark):
    asked = spark.createDataFrame([(1, "1", 3, 1, 3, 3), (2, "1", 0, 0, 1, 1), (3, "1", 3, 1, 5, 0), (4, "1", 1, 1, 1, 1), (5, "9", 1, 1, 1, 1)], "request_id long, image_id string, row1 int, col1 int, row2 int, col2 int")
    got = {r.request_id: r for r in grid_routes.indoor_routes(pixels(spark), asked).collect()}
    assert abs(got[1].cost - (2 + 2 * math.sqrt(2))) < 1e-9 and abs(got[1].seconds - got[1].cost / 15 / 1.4) < 1e-9
    assert [tuple(p) for p in got[1].path] == [(3, 1), (2, 1), (1, 2), (2, 3), (3, 3)]
    assert got[2].error == "start or end on a wall" and got[3].error == "no path" and got[5].error == "start or end on a wall"
    assert got[4].cost == 0 and [tuple(p) for p in got[4].path] == [(1, 1)]
    assert {r.request_id: r.steps for r in grid_routes.grid_bfs(pixels(spark), asked).collect()} == {1: 4, 2: None, 3: None, 4: 0, 5: None}
    four = {r.request_id: r for r in grid_routes.grid_bfs(pixels(spark), asked, 4, 2).collect()}
    assert four[1].steps == 6 and [tuple(p) for p in four[1].path][:2] == [(6, 2), (4, 2)]
    assert grid_routes.indoor_routes(pixels(spark), asked.limit(0)).count() == 0


@pytest.mark.parametrize("policy", ["first_feasible", "cheapest"])
def test_cases(spark, policy):
    nodes = spark.createDataFrame([(k, 0.001 * k, 0.0, k) for k in range(5)], "node_id long, x double, y double, ord long")
    arcs = [(k, k + 1, 1.0) for k in range(3)] + [(k + 1, k, 1.0) for k in range(3)]
    arcs = spark.createDataFrame(arcs, "src long, dst long, weight double")
    plans = pixels(spark, "A").unionByName(pixels(spark, "B"))
    # the first door of A is next to the start but cut off from it; B's doors lead to nodes 3 and 4 (4 has no arcs)
    doors = [("A", 0, 0, 5, 0.0, 0.0), ("A", 1, 3, 3, 0.001, 0.0), ("B", 0, 1, 1, 0.004, 0.0), ("B", 1, 3, 1, 0.003, 0.0)]
    doors = spark.createDataFrame(doors, "building_id string, entrance_pos int, indoor_x int, indoor_y int, lon double, lat double")
    asked = [
        (1, "A", 1.0, 3.0, "A", 3.0, 3.0, False), (2, "Outdoor", 0.0, 0.0, "Outdoor", 0.003, 0.0, True), (3, "A", 1.0, 3.0, "Outdoor", 0.0, 0.0, False),
        (4, "Outdoor", 0.0, 0.0, "B", 1.0, 3.0, False), (5, "A", 1.0, 3.0, "B", 1.0, 3.0, False), (6, "Outdoor", 0.004, 0.0, "Outdoor", 0.0, 0.0, False), (7, "C", 1.0, 1.0, "Outdoor", 0.0, 0.0, False),
    ]
    asked = spark.createDataFrame(asked, "request_id long, building1 string, x1 double, y1 double, building2 string, x2 double, y2 double, bike boolean")
    got = {r.request_id: r for r in routes.routes(nodes, arcs, plans, doors, asked, policy).collect()}
    leg = 6371000 * math.radians(0.001)
    room = lambda n, d: (n + d * math.sqrt(2)) / 15 / 1.4
    want = {
        1: ("indoor", room(2, 2)), 2: ("outdoor", 3 * leg / 5), 3: ("indoor_to_outdoor", room(2, 2) + leg / 1.4), 4: ("outdoor_to_indoor", 3 * leg / 1.4 + room(2, 1)),
        5: ("indoor_to_indoor", room(2, 2) + 2 * leg / 1.4 + room(2, 1)),
    }
    for k, (kind, seconds) in want.items():
        assert got[k].kind == kind and abs(got[k].seconds - seconds) < 1e-6, (k, got[k])
    assert got[3].pos1 == 1 and got[4].pos2 == 1 and got[2].nodes == [0, 1, 2, 3]
    assert got[6].error == got[7].error == "no route" and got[6].seconds is None


def test_entrance_membership(spark):
    doors = spark.createDataFrame([("A", 0, 2, 3, 0.5, 1.5)], "building_id string, entrance_pos int, indoor_x int, indoor_y int, lon double, lat double")
    points = spark.createDataFrame([("A", 2.0, 3.0), ("A", 0.5, 1.5), ("B", 2.0, 3.0), ("A", 3.0, 2.0)], "building_id string, x double, y double")
    assert [r.is_entrance for r in routes.is_entrance(points, doors).orderBy("building_id", "x").collect()] == [True, True, False, False]
