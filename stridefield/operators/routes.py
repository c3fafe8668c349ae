"""Entrances, candidate legs and whole routes of route requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefield.functions.scalars import euclid, haversine, outdoor_travel_time
from stridefield.operators import graph, grid_routes, spatial
from stridefield.operators.lineage import Scratch, cut


def pair_entrances(indoor: DataFrame, outdoor: DataFrame) -> DataFrame:
    """Entrances of a building paired by position; buildings of unequal counts are left out.

    indoor: building_id, entrance_pos, indoor_x, indoor_y; outdoor: building_id, entrance_pos, lon, lat. One shuffle on building_id.
    """
    n = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy("building_id")))
    return n(indoor).join(n(outdoor), ["building_id", "entrance_pos", "_n"]).drop("_n")


def entrance_pairs(requests: DataFrame, entrances: DataFrame) -> DataFrame:
    """request_id, pos1, pos2, metres: every entrance of building1 with every one of building2, as the request has to choose among them."""
    side = lambda k: entrances.select(F.col("building_id").alias(f"building{k}"), F.col("entrance_pos").alias(f"pos{k}"), F.col("lat").alias(f"_lat{k}"), F.col("lon").alias(f"_lon{k}"))
    metres = haversine(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))
    return requests.join(side(1), "building1").join(side(2), "building2").select("request_id", "building1", "building2", "pos1", "pos2", metres.alias("metres"))


def path_length(path_points: DataFrame, metric: str = "haversine") -> DataFrame:
    """route_id, length: summed legs between points (route_id, pos, x, y); a path of one point is 0."""
    order = Window.partitionBy("route_id").orderBy("pos")
    px, py = F.lag("x").over(order), F.lag("y").over(order)
    leg = haversine(py, px, F.col("y"), F.col("x")) if metric == "haversine" else euclid(px, py, F.col("x"), F.col("y"))
    return path_points.select("route_id", F.coalesce(leg, F.lit(0.0)).alias("_leg")).groupBy("route_id").agg(F.sum("_leg").alias("length"))


def rank_entrances(requests: DataFrame, entrances: DataFrame, indoor: bool = False) -> DataFrame:
    """request_id, entrance_pos, distance, rank; requests: request_id, building_id, x, y. Indoor in pixels, else metres."""
    joined = requests.join(entrances, "building_id")
    x, y = F.col("x"), F.col("y")
    away = euclid(x, y, F.col("indoor_x"), F.col("indoor_y")) if indoor else haversine(y, x, F.col("lat"), F.col("lon"))
    order = Window.partitionBy("request_id").orderBy("distance", "entrance_pos")
    return joined.select("request_id", "entrance_pos", away.alias("distance")).withColumn("rank", F.row_number().over(order).cast("long"))


def first_feasible(candidates: DataFrame) -> DataFrame:
    """Of each request the reachable candidate (cost not null) of least rank; requests with none are left out. Combines map-side."""
    kept = candidates.filter("cost IS NOT NULL")
    return kept.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "request_id"]), "rank").alias("b")).select("request_id", "b.*")


def cheapest_route(candidates: DataFrame) -> DataFrame:
    """Of each request the reachable candidate of least cost, the least rank on ties. Combines map-side."""
    kept = candidates.filter("cost IS NOT NULL")
    rest = F.struct(*[c for c in kept.columns if c != "request_id"])
    return kept.groupBy("request_id").agg(F.min_by(rest, F.struct("cost", "rank")).alias("b")).select("request_id", "b.*")


def pair_cost(start_pixels: Column, metres: Column, end_pixels: Column, cost: str = "seconds") -> Column:
    """``as_written`` adds pixels and kilometres; ``seconds`` turns all into walking time."""
    if cost == "as_written":
        return start_pixels + metres / 1000.0 + end_pixels
    return (start_pixels + end_pixels) / 15.0 / 1.4 + metres / 1.4


def rank_entrance_pairs(pairs: DataFrame, cost: str = "seconds") -> DataFrame:
    """pairs (request_id, pos1, pos2, start_pixels, metres, end_pixels) with total and rank."""
    order = Window.partitionBy("request_id").orderBy("total", "pos1", "pos2")
    total = pair_cost(F.col("start_pixels"), F.col("metres"), F.col("end_pixels"), cost)
    return pairs.withColumn("total", total).withColumn("rank", F.row_number().over(order).cast("long"))


def is_entrance(points: DataFrame, entrances: DataFrame) -> DataFrame:
    """points (building_id, x, y) with ``is_entrance``: whether the building has an indoor or outdoor entrance at exactly that place."""
    key = ["building_id", "x", "y"]
    indoor = entrances.select("building_id", F.col("indoor_x").cast("double").alias("x"), F.col("indoor_y").cast("double").alias("y"))
    known = indoor.unionByName(entrances.select("building_id", F.col("lon").alias("x"), F.col("lat").alias("y"))).distinct().withColumn("_is", F.lit(True))
    return points.join(known, key, "left").withColumn("is_entrance", F.coalesce("_is", F.lit(False))).drop("_is")


def route_candidates(requests: DataFrame, entrances: DataFrame) -> DataFrame:
    """request_id, kind, bike, rank, pos1, pos2 and the ends of the legs a (indoor), o (outdoor), b (indoor); a leg that isn't needed is null.

    Within one building or outdoors there is one candidate. Otherwise there is one for each entrance, by its distance from the
    start, or for each pair of entrances, by :func:`pair_cost` as written. The doors of a building are a bounded number.
    """
    out = F.lit("Outdoor")
    kind = (
        F.when((F.col("building1") == out) & (F.col("building2") == out), "outdoor")
        .when(F.col("building1") == F.col("building2"), "indoor")
        .when(F.col("building2") == out, "indoor_to_outdoor")
        .when(F.col("building1") == out, "outdoor_to_indoor")
        .otherwise("indoor_to_indoor")
    )
    known = requests.withColumn("kind", kind)
    door = lambda k: entrances.select(
        F.col("building_id").alias(f"building{k}"), F.col("entrance_pos").cast("long").alias(f"pos{k}"), F.col("indoor_x").alias(f"_ix{k}"), F.col("indoor_y").alias(f"_iy{k}"),
        F.col("lon").alias(f"_lon{k}"), F.col("lat").alias(f"_lat{k}"),
    )
    leg = lambda *ends: F.struct(*[c.cast(t).alias(n) for c, t, n in ends])
    inside = lambda b, x1, y1, x2, y2: leg((F.col(b), "string", "building"), *[(F.col(c), "int", n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    outside = lambda x1, y1, x2, y2: leg(*[(F.col(c), "double", n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    none_in, none_out = F.lit(None).cast("struct<building:string,x1:int,y1:int,x2:int,y2:int>"), F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    pos = F.lit(None).cast("long")

    def rows(df: DataFrame, rank, pos1, pos2, a, o, b) -> DataFrame:
        return df.select("request_id", "kind", "bike", rank.cast("long").alias("rank"), pos1.alias("pos1"), pos2.alias("pos2"), a.alias("a"), o.alias("o"), b.alias("b"))

    def ranked(df: DataFrame, away: Column, *ties: str) -> DataFrame:
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(away, *ties)))

    one = F.lit(1)
    ways = [
        rows(known.filter("kind = 'indoor'"), one, pos, pos, inside("building1", "x1", "y1", "x2", "y2"), none_out, none_in),
        rows(known.filter("kind = 'outdoor'"), one, pos, pos, none_in, outside("x1", "y1", "x2", "y2"), none_in),
    ]
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    going = ranked(known.filter("kind = 'indoor_to_outdoor'").join(door(1), "building1"), euclid(x1, y1, F.col("_ix1"), F.col("_iy1")), "pos1")
    ways.append(rows(going, F.col("_rank"), F.col("pos1"), pos, inside("building1", "x1", "y1", "_ix1", "_iy1"), outside("_lon1", "_lat1", "x2", "y2"), none_in))
    coming = ranked(known.filter("kind = 'outdoor_to_indoor'").join(door(2), "building2"), haversine(y1, x1, F.col("_lat2"), F.col("_lon2")), "pos2")
    ways.append(rows(coming, F.col("_rank"), pos, F.col("pos2"), none_in, outside("x1", "y1", "_lon2", "_lat2"), inside("building2", "_ix2", "_iy2", "x2", "y2")))
    both = known.filter("kind = 'indoor_to_indoor'").join(door(1), "building1").join(door(2), "building2")
    metres = haversine(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))
    total = pair_cost(euclid(x1, y1, F.col("_ix1"), F.col("_iy1")), metres, euclid(F.col("_ix2"), F.col("_iy2"), x2, y2), "as_written")
    both = ranked(both, total, "pos1", "pos2")
    ways.append(
        rows(both, F.col("_rank"), F.col("pos1"), F.col("pos2"), inside("building1", "x1", "y1", "_ix1", "_iy1"), outside("_lon1", "_lat1", "_lon2", "_lat2"),
             inside("building2", "_ix2", "_iy2", "x2", "y2"))
    )
    whole = ways[0]
    for more in ways[1:]:
        whole = whole.unionByName(more)
    return whole


def _outdoor_legs(legs: DataFrame, nodes: DataFrame, arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """o (the leg), metres, nodes of the least-cost way between the nodes nearest to its ends; legs without a way are left out."""
    ends = lambda k: legs.select(F.col(f"o.x{k}").alias("x"), F.col(f"o.y{k}").alias("y"))
    points = scratch.keep(ends(1).unionByName(ends(2)).distinct().withColumn("point_id", F.monotonically_increasing_id()))
    placed = scratch.keep(points.join(spatial.nearest_nodes(points, nodes), "point_id").select("x", "y", "node_id"))
    at = lambda k: placed.select(F.col("x").alias(f"_x{k}"), F.col("y").alias(f"_y{k}"), F.col("node_id").alias(["source", "target"][k - 1]))
    met = legs.select("o", *[F.col(f"o.{c}{k}").alias(f"_{c}{k}") for k in (1, 2) for c in "xy"]).join(at(1), ["_x1", "_y1"]).join(at(2), ["_x2", "_y2"]).select("o", "source", "target")
    met = scratch.keep(met)
    asked = scratch.keep(met.select("source", "target").distinct().withColumn("request_id", F.monotonically_increasing_id()))
    paths = scratch.keep(graph.shortest_paths(arcs, asked).filter("path IS NOT NULL"))
    steps = paths.select(F.col("request_id").alias("route_id"), F.posexplode("path").alias("pos", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id")
    metres = path_length(steps).select(F.col("route_id").alias("request_id"), F.col("length").alias("metres"))
    return met.join(paths.join(metres, "request_id").select("source", "target", "metres", F.col("path").alias("nodes")), ["source", "target"]).select("o", "metres", "nodes")


def routes(nodes: DataFrame, arcs: DataFrame, pixels: DataFrame, entrances: DataFrame, requests: DataFrame, policy: str = "first_feasible") -> DataFrame:
    """One row a request: kind, pos1, pos2 (entrances taken), seconds_a, seconds_o, seconds_b, seconds, nodes (outdoor), pixels_a, pixels_b, error.

    nodes: node_id, x (lon), y (lat), ord; arcs: src, dst, weight; pixels: image_id (the building), row, col, value; entrances:
    building_id, entrance_pos, indoor_x, indoor_y, lon, lat (see :func:`pair_entrances`); requests: request_id, building1, x1, y1,
    building2, x2, y2, bike, with "Outdoor" for no building. Indoor places are pixels (x is the column), outdoor ones degrees.
    ``first_feasible`` takes the candidate of least rank all of whose legs have a way, ``cheapest`` the one of least time.
    A request without such a candidate has nulls and an error. Legs that many candidates share are searched once.
    """
    if policy not in ("first_feasible", "cheapest"):
        raise ValueError(f"unknown policy {policy}")
    with Scratch(requests.sparkSession) as scratch:
        candidates = scratch.keep(route_candidates(requests, entrances))
        indoor = scratch.keep(
            candidates.select(F.explode(F.array("a", "b")).alias("leg")).filter("leg IS NOT NULL").distinct().withColumn("request_id", F.monotonically_increasing_id())
        )
        asked = indoor.select("request_id", F.col("leg.building").alias("image_id"), F.col("leg.y1").alias("row1"), F.col("leg.x1").alias("col1"), F.col("leg.y2").alias("row2"), F.col("leg.x2").alias("col2"))
        plans = pixels.withColumn("image_id", F.col("image_id").cast("string"))
        found = grid_routes.indoor_routes(plans, asked).filter("cost IS NOT NULL")
        inside = scratch.keep(indoor.join(found, "request_id").select("leg", "seconds", "path"))
        outside = scratch.keep(_outdoor_legs(candidates.select("o").filter("o IS NOT NULL").distinct(), nodes, arcs, scratch))
        leg = lambda c: inside.select(F.col("leg").alias(c), F.col("seconds").alias(f"seconds_{c}"), F.col("path").alias(f"pixels_{c}"))
        priced = candidates.join(leg("a"), "a", "left").join(leg("b"), "b", "left").join(outside, "o", "left")
        priced = priced.withColumn("seconds_o", outdoor_travel_time(F.col("metres"), F.col("bike")))
        has = lambda c: F.col(c).isNull() | F.col(f"seconds_{c}").isNotNull()
        total = F.coalesce("seconds_a", F.lit(0.0)) + F.coalesce("seconds_o", F.lit(0.0)) + F.coalesce("seconds_b", F.lit(0.0))
        kept = ["pos1", "pos2", "seconds_a", "seconds_o", "seconds_b", "seconds", "nodes", "pixels_a", "pixels_b"]
        whole = priced.filter(has("a") & has("o") & has("b")).select("request_id", "rank", total.alias("seconds"), *[c for c in kept if c != "seconds"])
        if policy == "cheapest":
            best = cheapest_route(whole.withColumn("cost", F.col("seconds")))
        else:
            best = first_feasible(whole.withColumn("cost", F.col("seconds")))
        kinds = requests.select("request_id", "building1", "building2")
        named = kinds.join(candidates.groupBy("request_id").agg(F.first("kind").alias("kind")), "request_id", "left").join(best.select("request_id", *kept), "request_id", "left")
        return cut(named.select("request_id", "kind", *kept, F.when(F.col("seconds").isNull(), "no route").alias("error")))
