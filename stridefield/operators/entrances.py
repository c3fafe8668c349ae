"""Entrances on floor plans: from degrees into plan pixels, inward from the outline, onto a white pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import geometry


def placed_points(points: DataFrame, placing: DataFrame) -> DataFrame:
    """points (building_id, x, y, ...) scaled about (gx, gy), moved to (cx, cy), turned by ``angle`` about it and mirrored in y if ``reflected``.

    placing: building_id, factor, gx, gy, cx, cy, angle, reflected; one row a building.
    """
    rest = [c for c in points.columns if c not in ("x", "y")]
    cx, cy, gx, gy = (F.col(c) for c in ("cx", "cy", "gx", "gy"))
    x, y = geometry.scale_about(F.col("x"), F.col("y"), F.col("factor"), gx, gy)
    x, y = geometry.rotate(*geometry.translate(x, y, cx - gx, cy - gy), F.col("angle"), cx, cy)
    mirrored = geometry.reflect(x, y, "x", cx, cy)
    known = points.join(placing.select("building_id", "factor", "gx", "gy", "cx", "cy", "angle", "reflected"), "building_id")
    return known.select(*rest, *[F.when(F.col("reflected"), m).otherwise(v).alias(n) for n, m, v in zip("xy", mirrored, (x, y), strict=True)])


def _projected(points: DataFrame, zones: DataFrame) -> DataFrame:
    rest = [c for c in points.columns if c not in ("lon", "lat")]
    place = scalars.utm_project(F.col("lon"), F.col("lat"), F.col("_zone"))
    return points.join(zones, "building_id").select(*rest, place.alias("_p")).select(*rest, F.col("_p.easting").alias("x"), F.col("_p.northing").alias("y"))


def project_entrances(outlines: DataFrame, plans: DataFrame, entrances: DataFrame, n: int = 1000, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """Entrances in plan pixels (building_id, entrance_pos, x, y), and the outline beside them (building_id, pos, x, y).

    outlines: building_id, pos, lon, lat (one ring a building); plans: building_id, pos, x, y; entrances: building_id, entrance_pos,
    lon, lat. Both rings are resampled to n points; the outline is projected in the zone of its first vertex, scaled to the plan's
    area, moved to its centroid and turned as the best of the candidates every ``step`` degrees. Buildings without a plan, without
    an outline or whose best overlap is 0 are left out.
    """
    zones = outlines.groupBy("building_id").agg(F.min_by(scalars.utm_zone(F.col("lon")), "pos").alias("_zone"))
    named = lambda df, **c: df.withColumnsRenamed(c)
    ring = named(geometry.resample_polygon(named(outlines, building_id="polygon_id", lon="x", lat="y"), n), polygon_id="building_id", k="pos", x="lon", y="lat")
    outline = _projected(ring, zones)
    plan = named(geometry.resample_polygon(named(plans, building_id="polygon_id"), n), polygon_id="building_id", k="pos")
    by_polygon = lambda df: df.withColumnRenamed("building_id", "polygon_id")
    measures = lambda df, a, c: geometry.polygon_area(by_polygon(df)).join(geometry.polygon_centroid(by_polygon(df)), "polygon_id").select(
        F.col("polygon_id").alias("building_id"), F.col("area").alias(a), F.col("cx").alias(f"{c}x"), F.col("cy").alias(f"{c}y")
    )
    known = measures(outline, "_area", "g").join(measures(plan, "_want", "c"), "building_id").withColumn("factor", F.sqrt(F.col("_want") / F.col("_area")))
    about = lambda df, c, factor: by_polygon(
        df.join(known, "building_id").select("building_id", "pos", *[((F.col(v) - F.col(f"{c}{v}")) * factor).alias(v) for v in "xy"])
    )
    rings = geometry.rings(about(plan, "c", F.lit(1.0))).withColumnsRenamed({"polygon_id": "building_id", "ring": "outline"})
    pairs = rings.join(geometry.rings(about(outline, "g", F.col("factor"))).withColumnsRenamed({"polygon_id": "building_id", "ring": "plan"}), "building_id")
    placing = known.join(geometry.best_alignment(pairs, step).filter("iou > 0"), "building_id")
    return placed_points(_projected(entrances, zones), placing), placed_points(outline, placing)


def _sides(outlines: DataFrame) -> DataFrame:
    """building_id, pos and the ends (ax, ay, bx, by) of every side; the last goes back to the first."""
    order = Window.partitionBy("building_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return outlines.select("building_id", F.col("pos").alias("_side"), F.col("x").alias("ax"), F.col("y").alias("ay"), ahead("x").alias("bx"), ahead("y").alias("by"))


def move_inward(points: DataFrame, outlines: DataFrame, distance: float = 50.0) -> DataFrame:
    """points (building_id, entrance_pos, x, y) put on their outline's nearest side and then ``distance`` inward; adds the normal nx, ny.

    outlines: building_id, pos, x, y. Of sides equally near the first counts. Inward is where a step of 0.1 from the
    side is strictly inside (even-odd rule, not on a side), else the other way. A point whose side has no length stays, with a normal of 0.
    """
    key = ["building_id", "entrance_pos"]
    sides = _sides(outlines)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / long))).otherwise(0.0)
    met = points.select(*key, "x", "y").join(sides, "building_id").withColumn("_qx", F.col("ax") + t * dx).withColumn("_qy", F.col("ay") + t * dy)
    away = F.round(F.hypot(F.col("x") - F.col("_qx"), F.col("y") - F.col("_qy")), 9)
    length = F.sqrt(long)
    unit = F.struct("_qx", "_qy", F.when(long > 0, -dy / length).otherwise(0.0).alias("nx"), F.when(long > 0, dx / length).otherwise(0.0).alias("ny"), "x", "y")
    near = met.groupBy(*key).agg(F.min_by(unit, F.struct(away, "_side")).alias("n")).select(*key, "n.*")
    tested = near.withColumn("_tx", F.col("_qx") + 0.1 * F.col("nx")).withColumn("_ty", F.col("_qy") + 0.1 * F.col("ny"))
    crosses = ((F.col("ay") > F.col("_ty")) != (F.col("by") > F.col("_ty"))) & (F.col("_tx") < dx * (F.col("_ty") - F.col("ay")) / dy + F.col("ax"))
    between = lambda v, a, b: F.col(v).between(F.least(a, b), F.greatest(a, b))
    on = (dx * (F.col("_ty") - F.col("ay")) == dy * (F.col("_tx") - F.col("ax"))) & between("_tx", "ax", "bx") & between("_ty", "ay", "by")
    ring = near.columns
    inside = tested.join(sides, "building_id").groupBy(*ring).agg(((F.sum(F.when(crosses, 1).otherwise(0)) % 2 == 1) & ~F.max(on)).alias("_in"))
    sign = F.when(F.col("_in"), 1.0).otherwise(-1.0)
    stays = (F.col("nx") == 0) & (F.col("ny") == 0)
    moved = lambda v: F.when(stays, F.col(v)).otherwise(F.col(f"_q{v}") + sign * F.col(f"n{v}") * distance).alias(v)
    return inside.select(*key, moved("x"), moved("y"), (sign * F.col("nx")).alias("nx"), (sign * F.col("ny")).alias("ny"))


def snap_to_white(points: DataFrame, pixels: DataFrame, steps: int = 49, white: int = 255) -> DataFrame:
    """building_id, entrance_pos, x, y (whole pixels): the first white pixel at the point, 1 to ``steps`` further along its normal, then 1 to
    ``steps`` back; a point that finds none is only rounded (half to even).

    points: building_id, entrance_pos, x, y, nx, ny with y upward; pixels: image_id, row, col, value with rows downward, all of an image.
    """
    key = ["building_id", "entrance_pos"]
    tries = F.sequence(F.lit(0), F.lit(2 * steps))
    k = F.col("_k")
    away = F.when(k <= steps, k).otherwise(steps - k)
    at: dict[str, Column] = {c: F.rint(F.col(c) + F.col(f"n{c}") * away).cast("long") for c in "xy"}
    height = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("_height")).withColumnRenamed("image_id", "building_id")
    tried = points.withColumn("_k", F.explode(tries)).select(*key, "_k", at["x"].alias("col"), at["y"].alias("_y")).join(height, "building_id")
    tried = tried.withColumn("row", F.col("_height") - F.col("_y") - 1)
    open_ = pixels.filter(F.col("value") >= 0.9 * white).select(F.col("image_id").alias("building_id"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    found = tried.join(open_, ["building_id", "row", "col"]).groupBy(*key).agg(F.min_by(F.struct("col", "_y"), "_k").alias("f"))
    rounded = lambda c: F.rint(c).cast("long")
    return points.join(found, key, "left").select(*key, F.coalesce("f.col", rounded("x")).alias("x"), F.coalesce("f._y", rounded("y")).alias("y"))


def scaled_entrances(entrances: DataFrame, scales: DataFrame) -> DataFrame:
    """building_id, entrance_pos, x, y times the building's factor, and ``error`` for a building of ``scales`` without entrances.

    entrances: building_id, entrance_pos, x, y; scales: building_id, factor. Buildings without a factor are left out.
    """
    known = scales.join(entrances, "building_id", "left")
    put = lambda c: scalars.scale_entrance(F.col(c), F.col("factor")).alias(c)
    return known.select("building_id", "entrance_pos", put("x"), put("y"), F.when(F.col("entrance_pos").isNull(), "no entrances").alias("error"))


def register_entrances(outlines: DataFrame, plans: DataFrame, entrances: DataFrame, pixels: DataFrame, scales: DataFrame, n: int = 1000, step: int = 1, distance: float = 50.0) -> DataFrame:
    """building_id, entrance_pos, x, y: entrances of every building with a factor, from degrees to scaled plan pixels.

    Projected, moved inward by ``distance``, put on a white pixel, scaled. Buildings that fail (no plan, outline, pixels or entrances) are left out.
    """
    points, rings = project_entrances(outlines, plans, entrances, n, step)
    snapped = snap_to_white(move_inward(points, rings, distance), pixels)
    return scaled_entrances(snapped, scales).filter("error IS NULL").drop("error")
