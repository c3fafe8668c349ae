"""Polygons as vertex rows (polygon_id, pos, x, y) for sums along the ring, or as ring arrays of (x, y) for pairs of polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _legs(vertices: DataFrame) -> DataFrame:
    """Every vertex with the next one (x2, y2); the last goes back to the first. One shuffle on polygon_id."""
    order = Window.partitionBy("polygon_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return vertices.withColumn("x2", ahead("x")).withColumn("y2", ahead("y"))


def perimeter_distance(vertices: DataFrame) -> DataFrame:
    """Vertices with ``along``, the way from the first vertex, and ``leg``, the length to the next one."""
    order = Window.partitionBy("polygon_id").orderBy("pos")
    leg = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    ends = _legs(vertices).withColumn("leg", leg).withColumn("_end", F.sum("leg").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ends.withColumn("along", F.coalesce(F.lag("_end").over(order), F.lit(0.0)))


def resample_polygon(vertices: DataFrame, n: int = 1000) -> DataFrame:
    """polygon_id, k, x, y: n points equally spaced along the closed ring; fewer than three vertices are an error.

    A leg makes the points that fall on it, so no range join is needed.
    """
    ring = Window.partitionBy("polygon_id")
    legs = perimeter_distance(vertices).withColumn("_n", F.count("*").over(ring)).withColumn("_all", F.sum("leg").over(ring))
    checked = legs.withColumn("_n", F.when(F.col("_n") >= 3, F.col("_n")).otherwise(F.raise_error(F.lit("a polygon needs three vertices"))))
    step = F.col("_all") / n
    first, last = F.ceil(F.col("along") / step), F.least(F.ceil(F.col("_end") / step), F.lit(n)) - 1
    points = checked.filter("_n >= 3 AND leg > 0").withColumn("_step", step).withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last))))
    part = (F.col("k") * F.col("_step") - F.col("along")) / F.col("leg")
    at = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * part).alias(a)
    return points.select("polygon_id", "k", at("x", "x2"), at("y", "y2"))


def polygon_area(vertices: DataFrame) -> DataFrame:
    """polygon_id, area of each ring. One shuffle on polygon_id."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    return _legs(vertices).groupBy("polygon_id").agg((F.abs(F.sum(cross)) / 2).alias("area"))


def polygon_centroid(vertices: DataFrame) -> DataFrame:
    """polygon_id, cx, cy; no area is an error. Sums are taken from the first vertex, which keeps digits."""
    whole = Window.partitionBy("polygon_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    legs = _legs(vertices).withColumn("_ox", F.first("x").over(whole)).withColumn("_oy", F.first("y").over(whole))
    x, y, x2, y2 = (F.col(c) - F.col(o) for c, o in (("x", "_ox"), ("y", "_oy"), ("x2", "_ox"), ("y2", "_oy")))
    cross = x * y2 - x2 * y
    sums = legs.groupBy("polygon_id").agg(
        F.sum(cross).alias("s"), F.sum((x + x2) * cross).alias("sx"), F.sum((y + y2) * cross).alias("sy"), F.first("_ox").alias("ox"), F.first("_oy").alias("oy")
    )
    safe = F.when(F.col("s") != 0, F.col("s")).otherwise(F.raise_error(F.lit("a polygon without area has no centroid")).cast("double"))
    return sums.select("polygon_id", (F.col("ox") + F.col("sx") / (3 * safe)).alias("cx"), (F.col("oy") + F.col("sy") / (3 * safe)).alias("cy"))


def match_area(vertices: DataFrame, target: DataFrame) -> DataFrame:
    """Vertices scaled about their centroid to the area of the same polygon in ``target`` (polygon_id, area); adds ``factor``."""
    known = polygon_area(vertices).join(target.select("polygon_id", F.col("area").alias("_want")), "polygon_id")
    factor = known.select("polygon_id", F.sqrt(F.col("_want") / F.col("area")).alias("factor"))
    placed = vertices.join(polygon_centroid(vertices).join(factor, "polygon_id"), "polygon_id")
    x, y = scale_about(F.col("x"), F.col("y"), F.col("factor"), F.col("cx"), F.col("cy"))
    return placed.select("polygon_id", "pos", x.alias("x"), y.alias("y"), "factor")


def rotate(x: Column, y: Column, degrees: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """The point turned by ``degrees`` about (cx, cy). A column expression: no key, no shuffle."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def reflect(x: Column, y: Column, axis: str, cx: Column, cy: Column) -> tuple[Column, Column]:
    """The point mirrored in the line through (cx, cy) along ``axis`` x or y. No shuffle."""
    return (x, 2 * cy - y) if axis == "x" else (2 * cx - x, y)


def scale_about(x: Column, y: Column, factor: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """The point at ``factor`` times its way from (cx, cy). No shuffle."""
    return cx + (x - cx) * factor, cy + (y - cy) * factor


def translate(x: Column, y: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """The point moved by (dx, dy). No shuffle."""
    return x + dx, y + dy


def rings(vertices: DataFrame) -> DataFrame:
    """polygon_id, ring of (x, y) by pos."""
    kept = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))
    return vertices.groupBy("polygon_id").agg(F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def _sides(ring: Column) -> Column:
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def _signed(ring: Column) -> Column:
    total = lambda s, leg: s + leg["a"]["x"] * leg["b"]["y"] - leg["b"]["x"] * leg["a"]["y"]
    return F.aggregate(_sides(ring), F.lit(0.0), total) / 2


def _under_both(p: Column, q: Column, base: Column) -> Column:
    """Signed area below sides p and q and above ``base`` over the x-range that they share."""
    left = F.greatest(F.least(p["a"]["x"], p["b"]["x"]), F.least(q["a"]["x"], q["b"]["x"]))
    right = F.least(F.greatest(p["a"]["x"], p["b"]["x"]), F.greatest(q["a"]["x"], q["b"]["x"]))
    height = lambda s, x: s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"]) / (s["b"]["x"] - s["a"]["x"])
    p0, p1, q0, q1 = height(p, left), height(p, right), height(q, left), height(q, right)
    d0, d1, wide = p0 - q0, p1 - q1, right - left
    apart = F.when(d0 * d1 >= 0, wide * F.abs(d0 + d1) / 2).otherwise(wide * (d0 * d0 + d1 * d1) / (2 * (F.abs(d0) + F.abs(d1))))
    area = wide * ((p0 + p1 + q0 + q1) / 4 - base) - apart / 2
    sign = F.signum(p["b"]["x"] - p["a"]["x"]) * F.signum(q["b"]["x"] - q["a"]["x"])
    return F.when(right > left, sign * area).otherwise(0.0)


def polygon_iou(ring_a: Column, ring_b: Column) -> Column:
    """Intersection over union of two simple rings: exact sums over pairs of their sides, inside one row."""
    base = F.least(F.array_min(F.transform(ring_a, lambda p: p["y"])), F.array_min(F.transform(ring_b, lambda p: p["y"])))
    per = lambda p: F.aggregate(_sides(ring_b), F.lit(0.0), lambda s, q: s + _under_both(p, q, base))
    shared = F.abs(F.aggregate(_sides(ring_a), F.lit(0.0), lambda s, p: s + per(p)))
    union = F.abs(_signed(ring_a)) + F.abs(_signed(ring_b)) - shared
    return F.when(union > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / union))).otherwise(0.0)


def _meeting(start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sorted places ``at`` lie in each range from ``start`` to before ``end``: range and place, pair by pair."""
    low, high = np.searchsorted(at, start), np.searchsorted(at, end)
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(start)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _sides_by_x(ring: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left x, right x, left y, right y, direction (1 rightward) of the sides of a ring (n, 2) that aren't upright, by their left x."""
    a, b = ring, np.roll(ring, -1, 0)
    way = np.sign(b[:, 0] - a[:, 0])
    left, right = np.where(way[:, None] > 0, a, b), np.where(way[:, None] > 0, b, a)
    kept = np.flatnonzero(way)
    kept = kept[np.argsort(left[kept, 0], kind="stable")]
    return left[kept, 0], right[kept, 0], left[kept, 1], right[kept, 1], way[kept]


def shared_area(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...]) -> float:
    """The area that two simple rings share, both by :func:`_sides_by_x`: a sweep over x.

    Of two sides whose x-ranges overlap one starts inside the other's, so sides sorted by their start give all pairs that meet
    by two searches. Each adds the signed area under both of them over the range that they share.
    """
    inner, outer = _meeting(p[0], p[1], q[0])
    back, front = _meeting(np.nextafter(q[0], np.inf), q[1], p[0])
    i, j = np.concatenate((inner, front)), np.concatenate((outer, back))
    px0, px1, py0, py1, pw = (c[i] for c in p)
    qx0, qx1, qy0, qy1, qw = (c[j] for c in q)
    left, right = np.maximum(px0, qx0), np.minimum(px1, qx1)
    lean, slope = (py1 - py0) / (px1 - px0), (qy1 - qy0) / (qx1 - qx0)
    p0, p1 = py0 + lean * (left - px0), py0 + lean * (right - px0)
    q0, q1 = qy0 + slope * (left - qx0), qy0 + slope * (right - qx0)
    base = min(p[2].min(initial=0), p[3].min(initial=0), q[2].min(initial=0), q[3].min(initial=0))
    d0, d1, wide = p0 - q0, p1 - q1, right - left
    size = np.abs(d0) + np.abs(d1)
    apart = np.where(d0 * d1 >= 0, np.abs(d0 + d1) / 2, (d0 * d0 + d1 * d1) / (2 * np.where(size > 0, size, 1)))
    return abs(float((pw * qw * wide * ((p0 + p1 + q0 + q1) / 4 - base - apart / 2)).sum()))


def ring_area(ring: np.ndarray) -> float:
    """Area of a simple ring (n, 2)."""
    x, y = (ring - ring[0]).T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def _ratio(shared: float, areas: float) -> float:
    return min(1.0, max(0.0, shared / (areas - shared))) if areas > shared else 0.0


def _ring_arrays(column: pa.Array) -> list[np.ndarray]:
    """Rings of (x, y) structs as arrays (n, 2)."""
    points = np.stack([column.flatten().field(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(points, ends[:-1])


#: Pairs of sides of two rings up to which all rows of a batch with as many sides are measured at once.
ALL_PAIRS = 1024


def _stacked_overlaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """iou of rows of rings (rows, n, 2) and (rows, m, 2): the sums of :func:`shared_area` over all pairs of sides."""
    def sides(ring: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = ring, np.roll(ring, -1, 1)
        way = np.sign(b[..., 0] - a[..., 0])
        left, right = np.where(way[..., None] > 0, a, b), np.where(way[..., None] > 0, b, a)
        wide = np.where(way == 0, 1.0, right[..., 0] - left[..., 0])
        return left[..., 0], right[..., 0], left[..., 1], (right[..., 1] - left[..., 1]) / wide, way

    px0, px1, py0, lean, pw = (c[:, :, None] for c in sides(p))
    qx0, qx1, qy0, slope, qw = (c[:, None, :] for c in sides(q))
    left = np.maximum(px0, qx0)
    wide = np.maximum(0.0, np.minimum(px1, qx1) - left)
    p0, q0 = py0 + lean * (left - px0), qy0 + slope * (left - qx0)
    d0 = p0 - q0
    d1 = d0 + (lean - slope) * wide
    base = np.minimum(0.0, np.minimum(p[..., 1].min(1), q[..., 1].min(1)))[:, None, None]
    size = np.abs(d0) + np.abs(d1)
    apart = np.where(d0 * d1 >= 0, size / 2, (d0 * d0 + d1 * d1) / (2 * np.where(size > 0, size, 1)))
    shared = np.abs((pw * qw * wide * (p0 + q0 + (lean + slope) * wide / 2 - 2 * base - apart) / 2).sum((1, 2)))

    def area(ring: np.ndarray) -> np.ndarray:
        x, y = (ring - ring[:, :1])[..., 0], (ring - ring[:, :1])[..., 1]
        return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2

    areas = area(p) + area(q)
    return np.where(areas > shared, np.clip(shared / np.where(areas > shared, areas - shared, 1.0), 0.0, 1.0), 0.0)


def _batch_overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """iou of the rings of each row; rows of as many sides each are measured together."""
    n, m = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (a, b))
    flat = [np.stack([c.flatten().field(v).to_numpy(zero_copy_only=False) for v in "xy"], 1) for c in (a, b)]
    starts, out = [np.cumsum(k) - k for k in (n, m)], np.zeros(len(n))
    for i, j in set(zip(n.tolist(), m.tolist(), strict=True)):
        rows = np.flatnonzero((n == i) & (m == j))
        if i * j > ALL_PAIRS:
            for r in rows.tolist():
                p, q = flat[0][starts[0][r] : starts[0][r] + i], flat[1][starts[1][r] : starts[1][r] + j]
                out[r] = _ratio(shared_area(_sides_by_x(p), _sides_by_x(q)), ring_area(p) + ring_area(q))
        elif i and j:
            for some in np.array_split(rows, len(rows) * i * j // 100_000 + 1):
                p, q = (f[s[some][:, None] + np.arange(k)] for f, s, k in zip(flat, starts, (i, j), strict=True))
                out[some] = _stacked_overlaps(p, q)
    return out


def polygon_overlaps(pairs: DataFrame, a: str, b: str, *key: str) -> DataFrame:
    """The ``key`` columns and iou of the rings ``a`` and ``b`` (arrays of x, y) of each row. No shuffle; rings are in memory one pair at a time.

    The same sums as :func:`polygon_iou`: of small rings many rows at a time, of others over pairs of sides that meet in x only (:func:`shared_area`).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            iou = _batch_overlaps(batch.column("_a"), batch.column("_b"))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(iou, pa.float64())], [*key, "iou"])

    shape = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key)
    return pairs.select(*key, F.col(a).alias("_a"), F.col(b).alias("_b")).mapInArrow(run, f"{shape}, iou double")


#: Degrees of a block of turns, which is one row of work.
BLOCK_DEGREES = 24


def best_alignment(pairs: DataFrame, step: int = 1) -> DataFrame:
    """building_id, angle, reflected, iou: the best of the turns by ``step`` degrees from -180, each plain and then mirrored in y; the first wins ties.

    pairs: building_id, outline and plan rings, both about their centroid at 0; ``plan`` is turned. A row of work is a building and a
    block of angles, dealt over all tasks; a candidate takes a sort of the plan's sides and the pairs of sides that meet (:func:`shared_area`).
    Overlaps that agree to 12 digits are ties. One row a block is shuffled back.
    """
    blocks = F.explode(F.sequence(F.lit(-180), F.lit(179), F.lit(step * max(1, BLOCK_DEGREES // step))))
    parts = 4 * max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = pairs.select("building_id", "outline", "plan").withColumn("first", blocks).repartition(parts, "building_id", "first")
    name = pairs.schema["building_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for outline, plan, first in zip(_ring_arrays(batch.column("outline")), _ring_arrays(batch.column("plan")), batch.column("first").to_pylist(), strict=True):
                fixed, areas, best = _sides_by_x(outline), ring_area(outline) + ring_area(plan), (-1.0, 0, False, 0.0)
                for angle in range(first, min(180, first + step * max(1, BLOCK_DEGREES // step)), step):
                    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
                    turned = plan @ np.array([[c, s], [-s, c]])
                    for reflected in (False, True):
                        iou = _ratio(shared_area(fixed, _sides_by_x(turned * (1, -1) if reflected else turned)), areas)
                        if round(iou, 12) > best[0]:
                            best = round(iou, 12), angle, reflected, iou
                found.append(best[1:])
            angle, reflected, iou = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("building_id"), pa.array(angle, pa.int32()), pa.array(reflected), pa.array(iou, pa.float64())], ["building_id", "angle", "reflected", "iou"])

    tried = work.mapInArrow(run, f"building_id {name}, angle int, reflected boolean, iou double")
    order = F.struct(F.round("iou", 12), -F.col("angle"), ~F.col("reflected"))
    best = tried.groupBy("building_id").agg(F.max_by(F.struct("angle", "reflected", "iou"), order).alias("b"))
    return best.select("building_id", "b.angle", "b.reflected", "b.iou")
