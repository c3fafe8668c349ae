"""Joins by place: each side is dealt to grid cells, joined on the cell, then tested exactly.

A pair that shares several cells is kept in one of them only (the corner of the overlap of both boxes), so no distinct
follows. Dense cells are an ordinary equi-join key, which AQE may split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from stridefield.functions.scalars import RADIUS_FT, haversine
from stridefield.operators.lineage import Scratch, cut

FEET_PER_DEGREE = 2 * math.pi * RADIUS_FT / 360


def _span(low: Column, high: Column, width: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def _side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _legs(ring: Column) -> Column:
    """The ring's sides as structs a, b; the ring need not repeat its first point."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def _on(leg: Column, x: Column, y: Column) -> Column:
    a, b = leg["a"], leg["b"]
    return (
        (_side(x, y, a["lon"], a["lat"], b["lon"], b["lat"]) == 0)
        & x.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))
        & y.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
    )


def _odd(legs: Column, x: Column, y: Column) -> Column:
    crossed = lambda leg: ((leg["a"]["lat"] > y) != (leg["b"]["lat"] > y)) & (
        x < (leg["b"]["lon"] - leg["a"]["lon"]) * (y - leg["a"]["lat"]) / (leg["b"]["lat"] - leg["a"]["lat"]) + leg["a"]["lon"]
    )
    return F.size(F.filter(legs, crossed)) % 2 == 1


def inside(legs: Column, x: Column, y: Column) -> Column:
    """Strictly inside: odd crossings and not on a side."""
    return _odd(legs, x, y) & ~F.exists(legs, lambda leg: _on(leg, x, y))


def _touches(leg: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    ax, ay, bx, by = leg["a"]["lon"], leg["a"]["lat"], leg["b"]["lon"], leg["b"]["lat"]
    boxes = (
        (F.least(ax, bx) <= F.greatest(x1, x2)) & (F.least(x1, x2) <= F.greatest(ax, bx))
        & (F.least(ay, by) <= F.greatest(y1, y2)) & (F.least(y1, y2) <= F.greatest(ay, by))
    )
    across = (F.signum(_side(x1, y1, ax, ay, bx, by)) * F.signum(_side(x2, y2, ax, ay, bx, by)) <= 0) & (
        F.signum(_side(ax, ay, x1, y1, x2, y2)) * F.signum(_side(bx, by, x1, y1, x2, y2)) <= 0
    )
    return boxes & across


#: The finest level of cells; a cell of level k is 2^k degrees wide.
FINEST = -30


def _level(*spans: Column) -> Column:
    """The finest level at which a box of these sides touches at most two cells a side."""
    return F.greatest(F.lit(FINEST), F.coalesce(F.ceil(F.log2(F.greatest(*spans))), F.lit(FINEST))).cast("int")


#: Polygons and points of their rings up to which all of them go to all workers.
FEW_POLYGONS, FEW_POINTS = 1_000, 50_000


def _few(polygons: DataFrame) -> pa.Table | None:
    """polygon_id and ring of the polygons, if they are few and whole."""
    bad = F.exists("ring", lambda p: p.isNull() | p["lat"].isNull() | p["lon"].isNull())
    n, points, odd = polygons.agg(F.count("*"), F.sum(F.size("ring")), F.max(F.coalesce(bad, F.lit(False)).cast("int"))).first()
    if n > FEW_POLYGONS or (points or 0) > FEW_POINTS or odd:
        return None
    return polygons.filter(F.size("ring") >= 3).select("polygon_id", F.transform("ring", lambda p: p["lon"].cast("double")).alias("x"), F.transform("ring", lambda p: p["lat"].cast("double")).alias("y")).toArrow().combine_chunks()


def _hits(edges: DataFrame, zones: pa.Table, mode: str, *kept: str) -> DataFrame:
    """The columns ``kept`` of all edges and ``_hits``, the ids of the polygons that each meets. No shuffle: the polygons, few, go to all workers and edges pass by in batches."""
    ids = zones.column("polygon_id").combine_chunks()
    rings = [(np.array(x), np.array(y)) for x, y in zip(zones.column("x").to_pylist(), zones.column("y").to_pylist(), strict=True)]
    shared = edges.sparkSession.sparkContext.broadcast((ids, rings))
    kind = zones.schema.field("polygon_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, zones_at = shared.value
        side = lambda px, py, ax, ay, bx, by: (bx - ax) * (py - ay) - (by - ay) * (px - ax)

        def odd(x: np.ndarray, y: np.ndarray, ax, ay, bx, by) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            return crossed.sum(1) % 2 == 1

        def on(x: np.ndarray, y: np.ndarray, ax, ay, bx, by) -> np.ndarray:
            return ((side(x, y, ax, ay, bx, by) == 0) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))).any(1)

        def met(ends: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Which of some edges meet a ring."""
            ax, ay, bx, by = x, y, np.roll(x, -1), np.roll(y, -1)
            x1, y1, x2, y2 = (e[:, None] for e in ends)
            if mode == "contains":
                return odd(x1, y1, ax, ay, bx, by) & odd(x2, y2, ax, ay, bx, by) & ~on(x1, y1, ax, ay, bx, by) & ~on(x2, y2, ax, ay, bx, by)
            boxes = (np.minimum(ax, bx) <= np.maximum(x1, x2)) & (np.minimum(x1, x2) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(y1, y2)) & (np.minimum(y1, y2) <= np.maximum(ay, by))
            across = (np.sign(side(x1, y1, ax, ay, bx, by)) * np.sign(side(x2, y2, ax, ay, bx, by)) <= 0) & (np.sign(side(ax, ay, x1, y1, x2, y2)) * np.sign(side(bx, by, x1, y1, x2, y2)) <= 0)
            return odd(x1, y1, ax, ay, bx, by) | (boxes & across).any(1)

        for batch in batches:
            ends = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x1", "_y1", "_x2", "_y2")]
            x1, y1, x2, y2 = ends
            low_x, low_y, high_x, high_y = np.minimum(x1, x2), np.minimum(y1, y2), np.maximum(x1, x2), np.maximum(y1, y2)
            rows, hit = [np.array([], int)], [np.array([], int)]
            for k, (x, y) in enumerate(zones_at):
                near = np.flatnonzero((low_x <= x.max()) & (x.min() <= high_x) & (low_y <= y.max()) & (y.min() <= high_y))
                for some in np.array_split(near, len(near) * len(x) // _PAIRS + 1):
                    found = some[met([e[some] for e in ends], x, y)]
                    rows.append(found)
                    hit.append(np.full(len(found), k))
            at, of = np.concatenate(rows), np.concatenate(hit)
            order = np.argsort(at, kind="stable")
            places = np.searchsorted(at[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), known.take(pa.array(of[order])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists.cast(pa.list_(kind))], [*kept, "_hits"])

    name = lambda c: edges.schema[c].dataType.simpleString()
    shape = ", ".join(f"`{c}` {name(c)}" for c in kept) + f", _hits array<{from_arrow_type(kind).simpleString()}>"
    ready = edges.select(*kept, *[F.col(c).cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    return ready.mapInArrow(run, shape)


def edges_in_polygons(edges: DataFrame, polygons: DataFrame, mode: str = "intersects") -> DataFrame:
    """polygon_id, edge_id. edges: edge_id, x1, y1, x2, y2 (x is lon); polygons: polygon_id, ring of (lat, lon).

    ``contains``: both ends strictly inside. ``intersects``: an end inside, or the segment touches a side.
    A box has the level of its own size, and two boxes meet in the cells of the coarser of their levels: each side is dealt, at
    its own level and at each coarser one that the other side has, to four cells at most. So one wide polygon among many small
    ones costs each edge four rows. Levels are powers of two, a few dozen at most, and are broadcast. One shuffle on the cell. Polygons that are few and small
    (``FEW_POLYGONS``, ``FEW_POINTS``; they are counted first) go to all workers instead, and nothing is shuffled.
    """
    if mode not in ("contains", "intersects"):
        raise ValueError(f"unknown mode {mode}")
    zones = _few(polygons)
    if zones is not None:
        return _hits(edges, zones, mode, "edge_id").select(F.explode("_hits").alias("polygon_id"), "edge_id")
    box = edges.select("edge_id", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("ex"), F.least("y1", "y2").alias("ey"), F.greatest("x1", "x2").alias("fx"), F.greatest("y1", "y2").alias("fy"))
    # written once: the boxes are read for their levels and for the join
    box = cut(box.withColumn("_e", _level(F.col("fx") - F.col("ex"), F.col("fy") - F.col("ey"))))
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    zone = polygons.filter(F.size("ring") >= 3).select(
        "polygon_id", _legs(F.col("ring")).alias("legs"),
        F.array_min(lon).alias("px"), F.array_min(lat).alias("py"), F.array_max(lon).alias("qx"), F.array_max(lat).alias("qy"),
    )
    zone = zone.withColumn("_p", _level(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")))
    width = F.pow(F.lit(2.0), F.col("level"))

    def dealt(df: DataFrame, own: str, other: DataFrame, theirs: str, low: str, high: str) -> DataFrame:
        """Rows at their own level and at the coarser ones of the other side."""
        known = F.broadcast(other.agg(F.collect_set(theirs).alias("_levels")))
        level = F.explode(F.concat(F.array(own), F.filter("_levels", lambda k: k > F.col(own))))
        at = df.crossJoin(known).withColumn("level", level).drop("_levels")
        return at.withColumn("cx", _span(F.col(f"{low}x"), F.col(f"{high}x"), width)).withColumn("cy", _span(F.col(f"{low}y"), F.col(f"{high}y"), width))

    met = dealt(box, "_e", zone, "_p", "e", "f").join(dealt(zone, "_p", box, "_e", "p", "q"), ["level", "cx", "cy"]).filter(F.col("level") == F.greatest("_e", "_p"))
    first = (F.col("cx") == F.greatest(F.floor(F.col("ex") / width), F.floor(F.col("px") / width))) & (
        F.col("cy") == F.greatest(F.floor(F.col("ey") / width), F.floor(F.col("py") / width))
    )
    x1, y1, x2, y2, legs = (F.col(c) for c in ("x1", "y1", "x2", "y2", "legs"))
    if mode == "contains":
        test = inside(legs, x1, y1) & inside(legs, x2, y2)
    else:
        test = _odd(legs, x1, y1) | F.exists(legs, lambda leg: _touches(leg, x1, y1, x2, y2))
    near = (F.col("ex") <= F.col("qx")) & (F.col("px") <= F.col("fx")) & (F.col("ey") <= F.col("qy")) & (F.col("py") <= F.col("fy"))
    return met.filter(first & near).filter(test).select("polygon_id", "edge_id")


def apply_closures(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges (edge_id unique) without those that touch a zone."""
    few = _few(zones)
    if few is not None:
        return _hits(edges, few, "intersects", *edges.columns).filter(F.size("_hits") == 0).drop("_hits")
    return edges.join(edges_in_polygons(edges, zones).select("edge_id"), "edge_id", "left_anti")


def edge_flows(members: DataFrame, segment_flows: DataFrame) -> DataFrame:
    """polygon_id, edge_id, flow: polygon i takes the i-th flow; polygons without one are left out."""
    return members.join(segment_flows.select("polygon_id", "flow"), "polygon_id")


def cell_bounds(i: Column, low: float, high: float, n: int) -> tuple[Column, Column]:
    """Lower and upper bound of cell ``i`` of ``n`` from ``low`` to ``high``. A column expression: no key, no shuffle."""
    step = (high - low) / n
    return low + i * F.lit(step), low + i * F.lit(step) + F.lit(step)


def cell_center(i: Column, low: float, high: float, n: int) -> Column:
    """The middle of cell ``i``. No shuffle."""
    a, b = cell_bounds(i, low, high, n)
    return (a + b) / 2


Bounds = tuple[float, float, float, float]  # lat low, lat high, lon low, lon high


def points_near_cells(points: DataFrame, bounds: Bounds, n: int, radius_ft: float) -> DataFrame:
    """i, j, feet of every cell whose centre is within the radius of a point (lat, lon).

    Cells follow from arithmetic on the point, so there is no join: each point is dealt to the few cells around it.
    """
    lat0, lat1, lon0, lon1 = bounds
    reach_lat = radius_ft / FEET_PER_DEGREE * 1.01
    reach_lon = reach_lat / math.cos(math.radians(max(abs(lat0), abs(lat1)) + reach_lat))

    def around(value: Column, reach: float, low: float, high: float) -> Column:
        step = (high - low) / n
        first = F.greatest(F.lit(0), F.floor((value - reach - low) / step))
        last = F.least(F.lit(n - 1), F.floor((value + reach - low) / step))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    dealt = points.withColumn("i", around(F.col("lat"), reach_lat, lat0, lat1)).withColumn("j", around(F.col("lon"), reach_lon, lon0, lon1))
    feet = haversine(cell_center(F.col("i"), lat0, lat1, n), cell_center(F.col("j"), lon0, lon1, n), F.col("lat"), F.col("lon"), RADIUS_FT)
    return dealt.withColumn("feet", feet).filter(F.col("feet") <= radius_ft).select("i", "j", "feet")


def edge_risk(edges: DataFrame, grid: DataFrame, bounds: Bounds, n: int) -> DataFrame:
    """edges (edge_id, mid_lat, mid_lon, ...) with multiplier of the cell of their midpoint, 1 outside.

    Bounds are inclusive and the lowest (i, j) wins, so the cell is chosen among three a side by exact bounds before one join.
    """
    lat0, lat1, lon0, lon1 = bounds

    def cell(value: Column, low: float, high: float) -> Column:
        guess = F.floor((value - low) / F.lit((high - low) / n))
        held = lambda k: (value >= cell_bounds(k, low, high, n)[0]) & (value <= cell_bounds(k, low, high, n)[1]) & k.between(0, n - 1)
        return F.array_min(F.filter(F.array(guess - 1, guess, guess + 1), held))

    placed = edges.withColumn("i", cell(F.col("mid_lat"), lat0, lat1)).withColumn("j", cell(F.col("mid_lon"), lon0, lon1))
    return placed.join(grid.select("i", "j", "multiplier"), ["i", "j"], "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0))).drop("i", "j")


#: Nodes of a cell that isn't divided, and how often the square around all nodes is divided by four at most.
CELL_NODES, DEEPEST = 32, 20


class _Cells:
    """Cells of four by four in one another, divided where they hold many nodes.

    levels[k] has the cells of level k: cx, cy, leaf, the box of their nodes, and ``least``, the first of them in order; homes has every node with the level and
    cell of its leaf. A level is one combined shuffle of the nodes whose cell was divided; cells of one place aren't.
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch, most: int = CELL_NODES):
        active = scratch.keep(nodes.select("node_id", "x", "y", "ord").filter("x IS NOT NULL AND y IS NOT NULL"))
        box = active.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
        self.levels: list[DataFrame] = []
        self.homes: DataFrame | None = None
        if box["lox"] is None:
            return
        side = max(box["hix"] - box["lox"], box["hiy"] - box["loy"]) * (1 + 1e-9) or 1.0
        for k in range(DEEPEST + 1):
            # widths are the side by powers of four, so a cell's numbers by four are its parent's
            at = lambda c: F.floor((F.col(c) - box[f"lo{c}"]) / (side / 4**k)).cast("long").alias(f"c{c}")  # noqa: E731, B023
            placed = active.select("*", at("x"), at("y"))
            made = placed.groupBy("cx", "cy").agg(
                F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))], F.min(F.struct("ord", "node_id", "x", "y")).alias("least")
            )
            one_place = (F.col("lox") == F.col("hix")) & (F.col("loy") == F.col("hiy"))
            cells = scratch.keep(made.withColumn("leaf", (F.col("n") <= most) | one_place | F.lit(k == DEEPEST)))
            self.levels.append(cells)
            leaf = cells.select("cx", "cy", "leaf")
            settled = placed.join(leaf.filter("leaf"), ["cx", "cy"]).select(F.lit(k).alias("level"), "cx", "cy", "node_id", "ord", F.col("x").alias("nx"), F.col("y").alias("ny"))
            self.homes = settled if self.homes is None else self.homes.unionByName(settled)
            if leaf.filter("NOT leaf").isEmpty():
                break
            active = scratch.keep(placed.join(leaf.filter("NOT leaf"), ["cx", "cy"], "left_semi").select("node_id", "x", "y", "ord"))


#: Nodes of a tile, which a task searches, and points of one tile that are dealt to a task.
TILE_NODES, TILE_POINTS = 16_384, 200_000
#: Distances are compared with this much room for rounding.
_ROOM = 1 + 1e-12
#: Pairs of points and nodes, or of points and tiles, that are looked at in one go.
_PAIRS = 2_000_000


def _nearest_in(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point (px, py) the first of the nearest nodes (x, y), and its distance.

    Nodes lie in a grid of some two a cell; a point looks at the cells around its own, and at twice as many a side while a nearer node may lie beyond them.
    """
    side = max(1, int(math.sqrt(len(x) / 2)))
    lox, loy = x.min(), y.min()
    wide, high = (float(np.ptp(x)) / side or 1.0), (float(np.ptp(y)) / side or 1.0)
    cell = lambda v, low, step: np.clip(np.floor((v - low) / step), 0, side - 1).astype(int)
    at = cell(y, loy, high) * side + cell(x, lox, wide)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(side * side + 1))
    cx, cy = cell(px, lox, wide), cell(py, loy, high)
    best, where = np.full(len(px), np.inf), np.full(len(px), len(x))
    left, reach = np.arange(len(px)), 1
    while len(left):
        for row in range(-reach, reach + 1):
            r = cy[left] + row
            at_row = left[(r >= 0) & (r < side)]
            if not len(at_row):
                continue
            base = (cy[at_row] + row) * side
            low, to = first[base + np.maximum(cx[at_row] - reach, 0)], first[base + np.minimum(cx[at_row] + reach, side - 1) + 1]
            for some in np.array_split(np.arange(len(at_row)), max(1, int((to - low).sum() // _PAIRS) + 1)):
                n = to[some] - low[some]
                p = np.repeat(at_row[some], n)
                node = order[np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                d = np.sqrt((px[p] - x[node]) * (px[p] - x[node]) + (py[p] - y[node]) * (py[p] - y[node]))
                keep = d <= best[p]
                p, node, d = p[keep], node[keep], d[keep]
                by = np.lexsort((node, d, p))
                p, node, d = p[by], node[by], d[by]
                one = np.concatenate(([True], p[1:] != p[:-1])) if len(p) else np.array([], bool)
                p, node, d = p[one], node[one], d[one]
                less = (d < best[p]) | (node < where[p])
                best[p[less]], where[p[less]] = d[less], node[less]
        # from a point to the end of what was looked at; beyond the grid there is nothing
        gap = lambda v, c, low, step: np.minimum(np.where(c - reach <= 0, np.inf, v - (low + (c - reach) * step)), np.where(c + reach >= side - 1, np.inf, low + (c + reach + 1) * step - v))  # noqa: E731, B023
        seen = np.minimum(gap(px[left], cx[left], lox, wide), gap(py[left], cy[left], loy, high))
        left = left[best[left] * _ROOM >= seen * (1 - 1e-9)]
        reach *= 2
    return where, best


def _first_in(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the first node within the radius and its distance, or none (the number of nodes): nodes are looked at in order, ever more at a time."""
    where, best, left, low, n = np.full(len(px), len(x)), np.full(len(px), np.inf), np.arange(len(px)), 0, 16
    while len(left) and low < len(x):
        n = min(2 * n, max(1, _PAIRS // len(left)))
        nx, ny = x[low : low + n], y[low : low + n]
        d = np.sqrt((px[left, None] - nx) ** 2 + (py[left, None] - ny) ** 2)
        met = d <= radius
        k, some = met.argmax(1), met.any(1)
        where[left[some]], best[left[some]] = low + k[some], d[some, k[some]]
        left, low = left[~some], low + n
    return where, best


def _searched(radius: float | None):
    """Rows by tile, nodes in order before points: each point's answer in the tile. A tile's nodes are held, its points pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, ready = None, [], None
        for batch in batches:
            of, share, kind = (batch.column(c).to_numpy() for c in ("_tile", "_part", "_kind"))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (share[1:] != share[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    if (of[low], share[low]) != tile:
                        tile, nodes, ready = (of[low], share[low]), [], None
                    nodes.append(part.select(["x", "y", "ord", "node_id"]))
                    continue
                if (of[low], share[low]) != tile:
                    continue
                if ready is None:
                    whole = pa.Table.from_batches(nodes).combine_chunks()
                    ready = whole, whole.column("x").to_numpy(), whole.column("y").to_numpy()
                known, x, y = ready
                px, py = part.column("x").to_numpy(), part.column("y").to_numpy()
                where, d = _nearest_in(x, y, px, py) if radius is None else _first_in(x, y, px, py, radius)
                got = np.flatnonzero(where < len(x))
                if len(got):
                    answer = known.select(["ord", "node_id"]).take(pa.array(where[got])).combine_chunks().to_batches()[0]
                    own = part.select(["point_id", "x", "y", "_tile"]).take(pa.array(got))
                    yield pa.RecordBatch.from_arrays([*own.columns, *answer.columns, pa.array(d[got])], ["point_id", "x", "y", "_home", "ord", "node_id", "d"])

    return run


class _Tiles:
    """Nodes, one a place, in tiles of bounded number; the tiles' boxes, some numbers each, go to all workers."""

    def __init__(self, nodes: DataFrame, scratch: Scratch):
        place = nodes.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        one = place.agg(F.min(F.struct("ord", "node_id")).alias("b")).select("x", "y", "b.ord", "b.node_id")
        cells = _Cells(one, scratch, TILE_NODES)
        self.scratch, self.found = scratch, cells.homes is not None
        if not self.found:
            return
        tiles = None
        for k, level in enumerate(cells.levels):
            leaf = level.filter("leaf").select(F.lit(k).alias("level"), "cx", "cy", "lox", "hix", "loy", "hiy", "least")
            tiles = leaf if tiles is None else tiles.unionByName(leaf)
        # by the first of their nodes, so the least number stands for the least node
        known = tiles.sort("least.ord", "least.node_id").select("level", "cx", "cy", "lox", "hix", "loy", "hiy").toArrow()
        self.boxes = np.stack([known.column(c).to_numpy() for c in ("lox", "hix", "loy", "hiy")])
        spark = nodes.sparkSession
        names = known.select(["level", "cx", "cy"]).append_column("_tile", pa.array(np.arange(known.num_rows)))
        numbers = spark.createDataFrame(names)
        self.homes = scratch.keep(cells.homes.join(F.broadcast(numbers), ["level", "cx", "cy"]).select("_tile", F.col("nx").alias("x"), F.col("ny").alias("y"), "ord", "node_id"))
        self.shared = spark.sparkContext.broadcast(self.boxes)

    def dealt(self, points: DataFrame, choose) -> DataFrame:
        """points (point_id, x, y, ...) with _tile, once for each tile that ``choose`` gives: of the least and greatest distances (points by tiles) and the batch a mask."""
        shared, names = self.shared, points.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lox, hix, loy, hiy = shared.value
            for batch in batches:
                step = max(1, _PAIRS // len(lox))
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    px, py = (part.column(c).to_numpy()[:, None] for c in "xy")
                    out = lambda p, a, b: np.maximum(0, np.maximum(a - p, p - b))
                    over = lambda p, a, b: np.maximum(np.abs(p - a), np.abs(p - b))
                    near = np.sqrt(out(px, lox, hix) ** 2 + out(py, loy, hiy) ** 2)
                    at, tile = np.nonzero(choose(part, near, lambda: np.sqrt(over(px, lox, hix) ** 2 + over(py, loy, hiy) ** 2)))  # noqa: B023
                    rows = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(tile)], [*names, "_tile"])

        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        return points.mapInArrow(run, f"{shape}, _tile long")

    def search(self, dealt: DataFrame, radius: float | None = None) -> DataFrame:
        """point_id, x, y, _home, ord, node_id, d: each row's answer in its tile. A tile with many points is dealt to several tasks, nodes and all."""
        dealt = self.scratch.keep(dealt.select("point_id", "x", "y", "_tile"))
        parts = dealt.groupBy("_tile").agg(F.ceil(F.count("*") / TILE_POINTS).cast("int").alias("_parts"))
        null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        spread = self.homes.join(F.broadcast(parts), "_tile").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        nodes = spread.select("_tile", "_part", F.lit(0).alias("_kind"), null(dealt, "point_id"), "x", "y", "ord", "node_id")
        asked = dealt.join(F.broadcast(parts), "_tile").withColumn("_part", F.pmod(F.xxhash64("point_id"), F.col("_parts")).cast("int"))
        rows = nodes.unionByName(asked.select("_tile", "_part", F.lit(1).alias("_kind"), "point_id", "x", "y", null(nodes, "ord"), null(nodes, "node_id")))
        named = lambda df, c: df.schema[c].dataType.simpleString()
        shape = f"point_id {named(dealt, 'point_id')}, x double, y double, _home long, ord {named(nodes, 'ord')}, node_id {named(nodes, 'node_id')}, d double"
        ordered = rows.repartition("_tile", "_part").sortWithinPartitions("_tile", "_part", "_kind", "ord", "node_id")
        # parts of one tile follow each other, each with its nodes before its points
        return ordered.select("_tile", "_part", "_kind", "point_id", "x", "y", "ord", "node_id").mapInArrow(_searched(radius), shape)


def nearest_nodes(points: DataFrame, nodes: DataFrame, early_exit_radius: float | None = None) -> DataFrame:
    """point_id, node_id, degrees: the node nearest in degrees, the first in order (``ord``) on ties; no nodes, or a point without coordinates: no row.

    points: point_id (unique), x, y; nodes: node_id, x, y, ord. Nodes, the first of each place, lie in tiles of at most ``TILE_NODES`` (:class:`_Cells`), whose boxes all workers know. A point goes to the
    nearest box first; its answer there bounds the distance, and the few other tiles that reach nearer are asked too. So a point moves
    some two times and a node once a search. With ``early_exit_radius`` the first node in order within it goes before the nearest: tiles wholly within answer
    by their first node, and of the others those are asked whose first node goes before it.
    """
    spark, ids = points.sparkSession, nodes.schema["node_id"].dataType
    with Scratch(spark) as scratch:
        asked = scratch.keep(points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"))
        tiles = _Tiles(nodes, scratch)
        if not tiles.found:
            own = points.schema["point_id"].dataType.simpleString()
            return spark.createDataFrame([], f"point_id {own}, node_id {ids.simpleString()}, degrees double")
        answered = None
        if early_exit_radius is not None:
            radius = early_exit_radius

            def rim(part: pa.RecordBatch, near: np.ndarray, far) -> np.ndarray:
                # tiles are numbered by their first nodes: those up to the first one wholly within the radius
                within = far() * _ROOM <= radius
                first = np.where(within.any(1), within.argmax(1), within.shape[1])
                return (near <= radius * _ROOM) & (np.arange(within.shape[1]) <= first[:, None])

            met = tiles.search(tiles.dealt(asked, rim), radius).groupBy("point_id").agg(F.min(F.struct("ord", "node_id", "d")).alias("b"))
            answered = scratch.keep(met.select("point_id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("degrees")))
            asked = scratch.keep(asked.join(answered.select("point_id"), "point_id", "left_anti"))

        def nearest_box(part: pa.RecordBatch, near: np.ndarray, far) -> np.ndarray:
            return np.arange(near.shape[1]) == near.argmin(1)[:, None]

        def others(part: pa.RecordBatch, near: np.ndarray, far) -> np.ndarray:
            home, d = (part.column(c).to_numpy()[:, None] for c in ("_home", "d"))
            return (near <= d * _ROOM) & (np.arange(near.shape[1]) != home)

        home = scratch.keep(tiles.search(tiles.dealt(asked, nearest_box)))
        more = tiles.search(tiles.dealt(home.select("point_id", "x", "y", "_home", "d"), others))
        both = home.unionByName(more).groupBy("point_id").agg(F.min(F.struct("d", "ord", "node_id")).alias("b"))
        found = both.select("point_id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("degrees"))
        return cut(found if answered is None else found.unionByName(answered))
