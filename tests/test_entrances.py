"""Entrances on floor plans: a plan made from an outline by a known turn, sides and normals, white pixels."""

import math

import pytest
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import entrances

RING = [(-121.752, 38.538), (-121.7512, 38.538), (-121.7512, 38.5384), (-121.7516, 38.5384), (-121.7516, 38.5387), (-121.752, 38.5387)]
DOORS = [(-121.7515, 38.538), (-121.7512, 38.5383)]


@pytest.mark.parametrize("mirrored", [False, True])
def test_projection_at_full_resolution(spark, mirrored):
    """1,000 points, every degree: doors land within half a pixel, and the whole registration on the pixel next to where the plan says."""
    outlines = spark.createDataFrame([("b", k, *p) for k, p in enumerate(RING)], "building_id string, pos int, lon double, lat double")
    doors = spark.createDataFrame([("b", k, *p) for k, p in enumerate(DOORS)], "building_id string, entrance_pos int, lon double, lat double")
    utm = scalars.utm_project(F.col("lon"), F.col("lat"), F.lit(10))
    flat = lambda df: [tuple(r.p) for r in df.select(utm.alias("p")).collect()]
    c, s = math.cos(math.radians(73)), math.sin(math.radians(73))
    low = flat(outlines)[0]

    def plan(p):
        x, y = (p[0] - low[0]) * 4, (p[1] - low[1]) * 4
        x, y = x * c - y * s, x * s + y * c
        return (x + 200, 450 - y) if mirrored else (x + 200, y + 150)

    plans = spark.createDataFrame([("b", k, *plan(p)) for k, p in enumerate(flat(outlines))], "building_id string, pos int, x double, y double")
    points, rings = entrances.project_entrances(outlines, plans, doors)
    for got, want in zip(points.orderBy("entrance_pos").collect(), map(plan, flat(doors)), strict=True):
        assert math.hypot(got.x - want[0], got.y - want[1]) < 0.5
    assert rings.count() == 1000
    if mirrored:
        return
    pixels = spark.range(600 * 600).select(F.lit("b").alias("image_id"), (F.col("id") / 600).cast("int").alias("row"), (F.col("id") % 600).cast("int").alias("col"), F.lit(255).alias("value"))
    scales = spark.createDataFrame([("b", 2.0)], "building_id string, factor double")
    registered = entrances.register_entrances(outlines, plans, doors, pixels, scales, distance=20.0).orderBy("entrance_pos").collect()
    # the first door is on the lowest side, whose inward normal is north; the second one on the eastern side, whose is west
    inward = [(0, 1), (-1, 0)]
    for got, (x, y), (nx, ny) in zip(registered, flat(doors), inward, strict=True):
        want = plan((x + nx * 5, y + ny * 5))
        assert abs(got.x / 2 - want[0]) <= 1.2 and abs(got.y / 2 - want[1]) <= 1.2


def test_inward_and_white(spark):
    square = spark.createDataFrame([("a", k, *p) for k, p in enumerate([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)])], "building_id string, pos int, x double, y double")
    points = spark.createDataFrame([("a", 0, 30.0, -5.0), ("a", 1, 97.0, 60.0), ("a", 2, 0.0, 0.0)], "building_id string, entrance_pos int, x double, y double")
    moved = entrances.move_inward(points, square, 20.0)
    got = {r.entrance_pos: (r.x, r.y, r.nx, r.ny) for r in moved.collect()}
    assert got == {0: (30.0, 20.0, 0.0, 1.0), 1: (80.0, 60.0, -1.0, 0.0), 2: (0.0, -20.0, 0.0, -1.0)}
    # a step from the corner runs along the next side, which is not inside, so the way is out
    # row 100 - y - 1: white at (30, 25) for the first, at (83, 60) behind the second, none for the third
    white = {(74, 30), (39, 83), (0, 0)}
    pixels = spark.createDataFrame([("a", r, c, 255 if (r, c) in white else 0) for r in range(100) for c in range(100)], "image_id string, row int, col int, value int")
    snapped = entrances.snap_to_white(moved, pixels)
    assert {r.entrance_pos: (r.x, r.y) for r in snapped.collect()} == {0: (30, 25), 1: (83, 60), 2: (0, -20)}
    scales = spark.createDataFrame([("a", 0.5), ("none", 2.0)], "building_id string, factor double")
    scaled = {(r.building_id, r.entrance_pos): (r.x, r.y, r.error) for r in entrances.scaled_entrances(snapped, scales).collect()}
    assert scaled == {("a", 0): (15, 12, None), ("a", 1): (42, 30, None), ("a", 2): (0, -10, None), ("none", None): (None, None, "no entrances")}


def test_registration_leaves_out_failures(spark):
    outlines = spark.createDataFrame([(b, k, *p) for b in "bc" for k, p in enumerate(RING)], "building_id string, pos int, lon double, lat double")
    doors = spark.createDataFrame([("b", 0, *DOORS[0]), ("c", 0, *DOORS[0])], "building_id string, entrance_pos int, lon double, lat double")
    plan = spark.createDataFrame([("b", k, x * 300.0, y * 300.0) for k, (x, y) in enumerate([(0.1, 0.1), (0.9, 0.1), (0.9, 0.5), (0.5, 0.5), (0.5, 0.9), (0.1, 0.9)])], "building_id string, pos int, x double, y double")
    pixels = spark.range(300 * 300).select(F.lit("b").alias("image_id"), (F.col("id") / 300).cast("int").alias("row"), (F.col("id") % 300).cast("int").alias("col"), F.lit(255).alias("value"))
    scales = spark.createDataFrame([("b", 0.5), ("c", 1.0)], "building_id string, factor double")
    got = entrances.register_entrances(outlines, plan, doors, pixels, scales, 24, 45, 10.0).collect()
    assert [(r.building_id, r.entrance_pos) for r in got] == [("b", 0)] and 0 <= got[0].x <= 150 and 0 <= got[0].y <= 150
