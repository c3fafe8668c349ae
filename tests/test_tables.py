"""Stored networks and suppression at the sides of tiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stridefield.operators import pixels
from stridefield.sources import maps


def test_stored_arcs_need_no_shuffle(spark, tmp_path):
    arcs = spark.range(1000).selectExpr("id % 37 AS src", "id AS dst", "1e0 * id AS weight")
    nodes = spark.range(37).withColumnRenamed("id", "node_id")
    maps.save_network(nodes, arcs, f"file://{tmp_path}/net", 6)
    kept_nodes, kept = maps.load_network(spark, f"file://{tmp_path}/net")
    assert kept_nodes.count() == 37 and sorted(map(tuple, kept.collect())) == sorted(map(tuple, arcs.collect()))
    # weights by arc and arcs by node: both read the arcs where they are
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grouped = kept.groupBy("src").agg(F.sum("weight"))._jdf.queryExecution().executedPlan().toString()
        joined = kept.join(kept_nodes.withColumnRenamed("node_id", "src"), "src")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in grouped and joined.count("Exchange hashpartitioning") == 1
    again = maps.load_network(spark, f"file://{tmp_path}/net")[1]
    assert again.count() == 1000


@pytest.mark.parametrize("spread", [30, 400])
def test_suppression_over_tiles(spark, spread):
    """Chains across the sides of many tiles, ties, equal places, half centres, a hot place."""
    r = random.Random(spread)
    boxes = [(i % 2, i, r.randrange(-spread, spread), r.randrange(-spread, spread), r.randrange(6), 5, 4) for i in range(900)]
    boxes += [(0, 1000 + i, 3 * i - 300, 7, i, 4, 4) for i in range(200)]  # each weaker than the next one along the row
    boxes += [(1, 2000 + i, 50, 50, 3, 4, 4) for i in range(300)]
    want = set()
    for image in (0, 1):
        kept = []
        for _, k, x, y, *_ in sorted((b for b in boxes if b[0] == image), key=lambda b: (-b[4], b[1])):
            if all((x - u) ** 2 + (y - v) ** 2 > 16 for u, v in kept):
                kept.append((x, y))
                want.add(k)
    df = spark.createDataFrame(boxes, "image_id int, det_id long, x int, y int, score int, w int, h int").repartition(5)
    got = pixels.nms(df, 4).collect()
    assert {g.det_id for g in got} == want and len(got) == len(want)
    assert pixels.nms(df.limit(0), 4).count() == 0


def _plain_nms(rows, distance):
    kept = []
    for image, det, x, y, _ in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(i != image or math.hypot(x - u, y - v) > distance for i, _, u, v in kept):
            kept.append((image, det, x, y))
    return sorted((i, d) for i, d, *_ in kept)


@pytest.mark.parametrize(("large", "together", "pairs"), [(None, 25, None), (None, 40, 60), (50, 25, 100)])
def test_suppression_of_whole_images(spark, monkeypatch, large, together, pairs):
    """Images that lie over many tiles are decided at once, with few rows together; those of too many pairs or rows by the stream; all as the plain greedy choice."""
    for name, value in (("TILE_DISTANCES", 2), ("WHOLE_IMAGE", large), ("TOGETHER_ROWS", together), ("TOGETHER_PAIRS", pairs)):
        if value is not None:
            monkeypatch.setattr(pixels, name, value, raising=False)
    if large is pairs is None:

        def stops(batches):
            raise AssertionError("a small image is streamed by tiles")

        monkeypatch.setattr(pixels, "_decided", lambda distance: stops)
    r = random.Random(8)
    rows = [(r.choice((1, 1, 2, 3, 9)), k, r.randrange(-30, 60), r.randrange(40), r.randrange(6)) for k in range(260)] + [(4, 900, 0, 0, 1), (4, 901, 3, 4, 1), (4, 902, 5, 5, 0)]
    boxes = spark.createDataFrame([(*row, 0, 0) for row in rows], "image_id int, det_id long, x int, y int, score int, w int, h int")
    got = pixels.nms(boxes, 5).collect()
    assert sorted((b.image_id, b.det_id) for b in got) == _plain_nms(rows, 5)
