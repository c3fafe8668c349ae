"""Walking network from nodes and ways: segments, ends, baseline weights, distinct edges, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridefield.functions.scalars import haversine, walking_time


def way_segments(ways: DataFrame) -> DataFrame:
    """way_id, pos, src, dst of consecutive node_refs. No shuffle: pairs are made inside the row."""
    refs = F.col("node_refs")
    ahead = F.slice(refs, 2, F.greatest(F.size(refs) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(refs, 1, F.greatest(F.size(refs) - 1, F.lit(0))).alias("src"), ahead.alias("dst"))
    return ways.select("way_id", F.posexplode(pairs).alias("pos", "p")).select("way_id", "pos", "p.src", "p.dst")


def resolve_segments(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends' coordinates; a segment with a missing end is left out. Shuffles on src, then dst."""
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("lon").alias(f"{end}_lon"), F.col("lat").alias(f"{end}_lat"))
    return segments.join(at("src"), "src").join(at("dst"), "dst")


def baseline_weights(resolved: DataFrame) -> DataFrame:
    """Segments with ``baseline_weight``, the seconds to walk them. No shuffle."""
    metres = haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return resolved.withColumn("baseline_weight", walking_time(metres))


def _order(weighted: DataFrame):
    """(way_id, pos) as a column of their order. Of whole numbers it is one number of fixed length, so that a group is hashed and its task needn't sort every segment first."""
    if all(weighted.schema[c].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") for c in ("way_id", "pos")):
        return F.col("way_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    return F.struct("way_id", "pos")


def distinct_edges(weighted: DataFrame) -> DataFrame:
    """One undirected edge per pair of ends, the first by (way_id, pos). One combined shuffle on the pair."""
    return (
        weighted.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.min_by("baseline_weight", _order(weighted)).alias("baseline_weight"))
    )


def place_ids(nodes: DataFrame) -> DataFrame:
    """node_id, place_id: the least id of the nodes at the same (x, y), in the same building and with the same kind of coordinates.

    nodes: node_id, x, y, use_global_coords, building_id. One shuffle on the place; the ids of one place stand in a list until they are told apart.
    """
    place = nodes.groupBy("x", "y", "use_global_coords", "building_id").agg(F.min("node_id").alias("place_id"), F.collect_list("node_id").alias("_ids"))
    return place.select(F.explode("_ids").alias("node_id"), "place_id")


def places(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one row a place, under its least id; of other columns those of that id's row."""
    ids = place_ids(nodes)
    return nodes.join(ids.filter("node_id = place_id").select("node_id"), "node_id", "left_semi")


def edges_between_places(weighted: DataFrame, nodes: DataFrame) -> DataFrame:
    """lo, hi, baseline_weight: one undirected edge between two places, the first by (way_id, pos); its ends in the order of (x, y), then of their ids.

    weighted: way_id, pos, src, dst, baseline_weight; nodes as in :func:`place_ids`. A segment between two ids of one place is a loop
    and stays. Shuffles on src, on dst and on the pair.
    """
    known = nodes.join(place_ids(nodes), "node_id").select("node_id", F.struct("x", "y", "place_id").alias("_at"))
    end = lambda c: known.select(F.col("node_id").alias(c), F.col("_at").alias(f"_{c}"))
    met = weighted.join(end("src"), "src").join(end("dst"), "dst")
    pair = met.groupBy(F.least("_src", "_dst")["place_id"].alias("lo"), F.greatest("_src", "_dst")["place_id"].alias("hi"))
    return pair.agg(F.min_by("baseline_weight", _order(weighted)).alias("baseline_weight"))


def undirected_arcs(edges: DataFrame) -> DataFrame:
    """Each edge from both ends; the union needs no shuffle."""
    return edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "baseline_weight").unionByName(
        edges.select(F.col("hi").alias("src"), F.col("lo").alias("dst"), "baseline_weight")
    )


# Highway tags of ways that can be walked
WALKABLE = ("unclassified", "residential", "service", "living_street", "pedestrian", "footway", "cycleway", "path", "track", "bridleway", "steps")


def filter_walkable(ways: DataFrame, kinds: tuple[str, ...] = WALKABLE) -> DataFrame:
    """Ways whose highway tag is one of ``kinds``."""
    return ways.filter(F.col("tags")["highway"].isin(*kinds))


def weekday_profile(readings: DataFrame) -> DataFrame:
    """Mean count per weekday and 15-minute slot; readings are combined before the shuffle."""
    slot = F.date_format(F.window("ts", "15 minutes")["start"], "HH:mm:ss")
    return readings.groupBy(F.date_format("ts", "EEEE").alias("weekday"), slot.alias("slot")).agg(F.avg("count").alias("avg_count"))


def normalize_entrance(nodes: DataFrame) -> DataFrame:
    """Entrance tags main and yes become yes; other values stay."""
    value = lambda k, v: F.when((k == "entrance") & v.isin("main", "yes"), F.lit("yes")).otherwise(v)
    return nodes.withColumn("tags", F.transform_values("tags", value))


def filter_buildings(ways: DataFrame) -> DataFrame:
    """Ways with a building tag, whatever its value. No shuffle."""
    return ways.filter(F.map_contains_key("tags", "building"))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the building they belong to, or Outdoor."""
    building = F.coalesce(F.col("tags")["building"], F.lit("Outdoor"))
    return nodes.withColumn("building_id", building).withColumn("use_global_coords", building == "Outdoor")


def edge_midpoints(resolved: DataFrame) -> DataFrame:
    """Segments with mid_lat and mid_lon. No shuffle."""
    return resolved.withColumn("mid_lat", (F.col("src_lat") + F.col("dst_lat")) / 2).withColumn("mid_lon", (F.col("src_lon") + F.col("dst_lon")) / 2)


def _refs(ways: DataFrame) -> DataFrame:
    return ways.select("way_id", F.posexplode("node_refs").alias("pos", "node_id"))


def building_vertices(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """way_id, pos, node_id, lat, lon of refs that exist, and way_id, pos, node_id of those that don't. One shuffle on node_id each."""
    refs = _refs(ways)
    return refs.join(nodes.select("node_id", "lat", "lon"), "node_id").select("way_id", "pos", "node_id", "lat", "lon"), refs.join(
        nodes.select("node_id"), "node_id", "left_anti"
    ).select("way_id", "pos", "node_id")


def override_nodes(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Nodes of ``extra`` replace nodes of ``base`` of the same id."""
    return base.join(extra.select("node_id"), "node_id", "left_anti").unionByName(extra)


def building_label(tags: str = "tags", way_id: str = "way_id"):
    """A building's name, else its id. A column expression."""
    return F.coalesce(F.col(tags)["name"], F.col(way_id).cast("string"))


def node_buildings(ways: DataFrame) -> DataFrame:
    """node_id, building_id: every building a node is on, labelled by name, else id."""
    return ways.select(F.explode("node_refs").alias("node_id"), building_label().alias("building_id")).distinct()


def building_entrance_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes with an entrance tag on a building outline."""
    return nodes.filter(F.map_contains_key("tags", "entrance")).join(ways.select(F.explode("node_refs").alias("node_id")), "node_id", "left_semi")


def buildings(vertices: DataFrame) -> DataFrame:
    """building_id, polygons, entrances: outlines (vertices by pos) of the ways of one label, and the places of their vertices tagged
    entrance, both by way and pos. vertices: building_id, way_id, pos, lat, lon, and is_entrance (without it there are none)."""
    if "is_entrance" not in vertices.columns:
        vertices = vertices.withColumn("is_entrance", F.lit(False))
    outline = vertices.groupBy("building_id", "way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("ring"))
    doors = vertices.filter("is_entrance").groupBy("building_id").agg(F.sort_array(F.collect_list(F.struct("way_id", "pos", "lat", "lon"))).alias("entrances"))
    polygons = outline.groupBy("building_id").agg(F.sort_array(F.collect_list(F.struct("way_id", "ring"))).alias("polygons"))
    known = polygons.join(doors, "building_id", "left")
    none = F.array().cast(doors.schema["entrances"].dataType)
    return known.select("building_id", "polygons", F.coalesce("entrances", none).alias("entrances"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, neighbours sorted by (dst, baseline_weight); a node's list is as long as its degree."""
    return undirected_arcs(edges).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "baseline_weight"))).alias("neighbours"))


def merge_adjacency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lists of ``b`` after those of ``a``."""
    right = b.withColumnRenamed("neighbours", "_more")
    empty = F.array().cast(a.schema["neighbours"].dataType)
    return a.join(right, "src", "full").select("src", F.concat(F.coalesce("neighbours", empty), F.coalesce("_more", empty)).alias("neighbours"))


def network_summary(nodes: DataFrame, arcs: DataFrame, entrances: DataFrame) -> DataFrame:
    """One row: nodes, edges (half of the arcs), buildings with entrances; each side is aggregated before they meet."""
    one = lambda df, e, name: df.agg(e.alias(name))
    return (
        one(nodes, F.count("*"), "n_nodes")
        .crossJoin(one(arcs, F.floor(F.count("*") / 2).cast("long"), "n_edges"))
        .crossJoin(one(entrances, F.count_distinct("building_id"), "n_buildings"))
    )


def extent(nodes: DataFrame, share: float = 0.05, least: float = 0.001) -> DataFrame:
    """One row of bounds, each side padded by a share of the span, by ``least`` degrees where the span is 0."""
    box = nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))])
    pad = {c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(f"max_{c}") - F.col(f"min_{c}")) * share).otherwise(least) for c in ("lat", "lon")}
    return box.select(*[(F.col(f"{n}_{c}") + s * pad[c]).alias(f"{n}_{c}") for c in ("lat", "lon") for n, s in (("min", -1), ("max", 1))])


def edge_flow_map(edge_flows: DataFrame) -> DataFrame:
    """edge_id, flow: the last polygon's."""
    return edge_flows.groupBy("edge_id").agg(F.max_by("flow", "polygon_id").alias("flow"))
