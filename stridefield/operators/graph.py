"""Loops over arcs: components, hop distances, least-cost paths, flow between states.

Each round is a join and an aggregate whose lineage is cut; the driver gets one small answer per round.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stridefield.operators.lineage import Scratch, cut


def connected_components(arcs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (its least node) of all ends of ``arcs`` (src, dst), direction ignored.

    Contraction: in each round every node goes over to the one of least random rank among itself and its neighbours, and arcs
    go over with their ends. About half the nodes of a path or more vanish in a round, so a long chain takes the logarithm of its
    length in rounds, and each round's tables are a part of the last one's. The moves are then followed back.
    One count a round comes to the driver. With ``scratch`` the result is a table of it.
    """
    if scratch is None:
        with Scratch(arcs.sparkSession) as own:
            return cut(connected_components(arcs, own))
    ends = arcs.select("src", "dst").unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    left = scratch.keep(ends)
    moves: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        first = left.groupBy("src").agg(F.least(F.min(rank("dst")), rank("src")).alias("_to"))
        move = scratch.keep(first.select(F.col("src").alias("node"), F.col("_to.node").alias("to")))
        moves.append(move)
        half = left.filter("src != dst").join(move.select(F.col("node").alias("src"), F.col("to").alias("_s")), "src").select("_s", "dst")
        both = half.join(move.select(F.col("node").alias("dst"), F.col("to").alias("_d")), "dst")
        left = scratch.keep(both.select(F.col("_s").alias("src"), F.col("_d").alias("dst")).filter("src != dst").distinct())
    if not moves:
        return ends.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = moves.pop()
    while moves:
        below = found.select(F.col("node").alias("to"), F.col("to").alias("_root"))
        found = scratch.keep(moves.pop().join(below, "to", "left").select("node", F.coalesce("_root", "to").alias("to")))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return scratch.keep(found.join(least, "to").select("node", "component"))


def largest_component(components: DataFrame) -> DataFrame:
    """The one component with most nodes, the lowest id on ties."""
    return components.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")


def keep_largest_component(arcs: DataFrame) -> DataFrame:
    """Arcs of the largest component; both ends of an arc share a component, so one semi-join is enough."""
    found = connected_components(arcs)
    return arcs.join(found.join(largest_component(found), "component").select(F.col("node").alias("src")), "src", "left_semi")


#: Arcs of a network that goes to all workers as arrays (24 bytes an arc, 8 a node). The arcs are counted first; beyond it they stay a table.
SHARED_ARCS = 2_000_000
#: A component of a larger network is searched in tasks of its own up to so many times ``SHARED_ARCS``.
COMPONENT_SHARE = 4
#: A network of up to so many times ``SHARED_ARCS`` arcs, and a component of up to so many times as many, is read packed by each task (12 bytes an arc, 24 if its ways back differ).
NET_SHARE, PACKED_SHARE = 32, 32
#: So few sources over a larger network are searched by tasks that the packed arcs pass by, up to so many times, and that hold what each node costs, if ids span no more than ``PASSED_SHARE`` times ``SHARED_ARCS``.
#: A task holds so many of them, 12 bytes each, or those of one source.
PASSED_SOURCES, PASSES, PASSED_SHARE, PASSED_NODES, PASSED_ARCS = 64, 32, 32, 1 << 25, 1 << 14
#: Arcs of a packed row, at most.
PACKED_ARCS = 1 << 18
#: Requests of a group, which is a task over the components that it takes part in, one after the other.
GROUP_REQUESTS = 20_000
#: A task that reads a packed network has at least one request for so many of its arcs, as long as all cores have two such tasks.
REQUEST_ARCS = 500
#: So many ends of one node, or one for each so many nodes of the network, are searched from both sides each.
FEW_ENDS, MANY_ENDS = 3, 400
#: Weights are told apart in so many levels by which the arcs of a node are sorted, and so many arcs are sorted at a time.
LEVELS, LAID_ARCS = 32, 1 << 20
#: So many searches, or as many as this number of nodes allows, go on together in a task.
SLOTS, SLOT_NODES = 32, 1 << 23
#: A node with so many ends is searched once for each of them, next to others.
PAIRED_ENDS = 2


class _Net:
    """Arcs as arrays: ids of the nodes in order, the place of each node's first arc, and ends and weights of the arcs by node, both ways."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        ids, place = np.unique(np.concatenate((src, dst)), return_inverse=True)
        src, dst = place[: len(src)], place[len(src) :]
        self._set(ids, self._by(len(ids), src, dst, weight), self._by(len(ids), dst, src, weight))

    def _set(self, ids: np.ndarray, ahead: tuple[np.ndarray, ...], back: tuple[np.ndarray, ...]) -> None:
        self.ids, self.ahead, self.back, self._part, self._sides = ids, ahead, back, None, None

    @classmethod
    def of_chunks(cls, chunks: list[tuple[np.ndarray, ...]], both: bool) -> _Net:
        """Of chunks (src, dst, weight) of arcs in any order, which are emptied; ``both``: an arc stands for its way back too, so one side serves both ways."""
        net = cls.__new__(cls)
        some = [ends for chunk in chunks for ends in chunk[:2] if len(ends)]
        low, high = min((int(x.min()) for x in some), default=0), max((int(x.max()) for x in some), default=-1)
        if high - low < 2 * sum(len(x) for x in some):
            # ids that lie close are found in a table
            known = np.zeros(high - low + 1, bool)
            for x in some:
                known[x - low] = True
            ids = np.flatnonzero(known) + low
            table = np.cumsum(known, dtype=np.int32) - 1
            for k, (src, dst, weight) in enumerate(chunks):
                chunks[k] = table[src - low], table[dst - low], weight
            net._set(ids, (), ())
        else:
            ids = np.zeros(0, np.int64)
            for at in range(0, len(chunks), 16):
                ids = np.unique(np.concatenate([ids, *[ends for chunk in chunks[at : at + 16] for ends in chunk[:2]]]))
            net._set(ids, (), ())
            for k, (src, dst, weight) in enumerate(chunks):
                # in order they are found some times as fast
                order = np.argsort(dst)
                ends = np.empty(len(dst), np.int32)
                ends[order] = net.places(dst[order])
                chunks[k] = net.places(src).astype(np.int32), ends, weight
        net.ahead = cls._laid(len(ids), chunks, [(0, 1), (1, 0)] if both else [(0, 1)])
        net.back = net.ahead if both else cls._laid(len(ids), chunks, [(1, 0)])
        return net

    @staticmethod
    def _laid(n: int, chunks: list[tuple[np.ndarray, ...]], ways: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Arcs of all chunks by their node, chunk by chunk; ``ways``: which ends of a chunk are node and end."""
        first = np.concatenate(([0], np.cumsum(sum(np.bincount(chunk[a], minlength=n) for chunk in chunks for a, _ in ways))))
        ends, weights, free = np.empty(first[-1], np.int32), np.empty(first[-1]), first[:-1].copy()
        for chunk in chunks:
            for a, b in ways:
                order = np.argsort(chunk[a], kind="stable")
                node = chunk[a][order]
                begins = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                counts = np.diff(np.append(begins, len(node)))
                to = np.repeat(free[node[begins]] - begins, counts) + np.arange(len(node))
                ends[to], weights[to] = chunk[b][order], chunk[2][order]
                free[node[begins]] += counts
        return first, ends, weights

    @staticmethod
    def _by(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(src, kind="stable")
        return np.searchsorted(src[order], np.arange(n + 1)), dst[order].astype(np.int32), weight[order]

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Places of nodes, -1 for those that no arc names."""
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[at] == nodes, at, -1) if len(self.ids) else np.full(len(nodes), -1)

    @property
    def slots(self) -> int:
        return max(1, min(SLOTS, SLOT_NODES // max(1, len(self.ids))))

    def sides(self) -> tuple[_Side, _Side]:
        """The two sides of searches, made once."""
        if self._sides is None:
            ahead = _Levels(self.ahead)
            back = ahead if self.back is self.ahead else _Levels(self.back)
            mark = np.zeros(self.slots * len(self.ids), np.int32)
            self._sides = _Side(ahead, self.slots, mark), _Side(back, self.slots, mark)
        return self._sides

    @property
    def part(self) -> np.ndarray:
        """A number of each place's component: labels of components that meet take the least one's, and labels are followed to their ends; told once."""
        if self._part is None:
            part, known = np.arange(len(self.ids), dtype=np.int32), None
            while known is None or (part != known).any():
                known = part.copy()
                for first, ends, _ in {id(a): a for a in (self.ahead, self.back)}.values():
                    some = np.flatnonzero(np.diff(first))
                    if len(some):
                        least = np.minimum.reduceat(part[ends], first[some])
                        np.minimum.at(part, part[some], least)
                        np.minimum.at(part, some, least)
                    while (part[part] != part).any():
                        part = part[part]
            self._part = part
        return self._part


def _shared(links: DataFrame) -> _Net:
    arcs = links.select(F.col("node").cast("long").alias("node"), F.col("dst").cast("long").alias("dst"), "weight").toArrow()
    return _Net(*[arcs.column(c).to_numpy() for c in ("node", "dst", "weight")])


def _search(start: int, targets: np.ndarray | None, arcs: tuple[np.ndarray, ...], band: float) -> tuple[np.ndarray, np.ndarray]:
    """cost and prev of all nodes, final for ``targets`` (None: all), from the node at place ``start``.

    Nodes are relaxed in bands of costs: all open nodes under the band's end at a time, until none is left under it.
    """
    first, ends, weights = arcs
    n_nodes = len(first) - 1
    cost, prev, open_ = np.full(n_nodes, np.inf), np.full(n_nodes, -1), np.zeros(n_nodes, bool)
    cost[start], open_[start], limit = 0.0, True, band
    while True:
        at = np.flatnonzero(open_ & (cost < limit))
        if not len(at):
            left = np.flatnonzero(open_)
            if not len(left) or (targets is not None and (cost[targets] < limit).all()):
                return cost, prev
            limit = max(limit, float(cost[left].min())) + band
            continue
        open_[at] = False
        n = first[at + 1] - first[at]
        arc = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        new, to, by = np.repeat(cost[at], n) + weights[arc], ends[arc], np.repeat(at, n)
        less = new < cost[to]
        new, to, by = new[less], to[less], by[less]
        np.minimum.at(cost, to, new)
        best = new == cost[to]
        to, by = to[best], by[best]
        prev[to] = n_nodes
        np.minimum.at(prev, to, by)
        open_[to] = True


class _Levels:
    """Arcs, which are sorted in place, of each node by the level of their weight, and how many of them are up to each level; ``tops``: the greatest weight of each level but the last."""

    def __init__(self, arcs: tuple[np.ndarray, ...]):
        first, ends, weights = arcs
        n, some = len(first) - 1, np.sort(weights[:: max(1, len(weights) >> 17)])
        # levels of light arcs are the finer, as those are read the most
        self.tops = np.unique(some[(len(some) * (np.arange(1, LEVELS) / LEVELS) ** 2).astype(int)]) if len(some) else np.zeros(0)
        most, levels = int(np.diff(first).max(initial=0)), len(self.tops) + 1
        self.upto = np.empty((n, levels), np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32)
        self.first, self.ends, self.weights = first, ends, weights
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(first, first[low] + LAID_ARCS, "right")) - 1)
            part = slice(first[low], first[high])
            key = (np.repeat(np.arange(high - low) * levels, np.diff(first[low : high + 1])) + np.searchsorted(self.tops, weights[part])).astype(np.int32 if (high - low) * levels < 1 << 31 else np.int64)
            order = np.argsort(key)
            ends[part], weights[part] = ends[part][order], weights[part][order]
            self.upto[low:high] = np.bincount(key, minlength=(high - low) * levels).reshape(-1, levels).cumsum(axis=1)
            low = high


class _Side:
    """What searches over a network know from one end each: costs, nodes before, what is open. It is cleared by what it has touched, not as a whole.

    Searches go on together, each in a slot of its own: a node's key is its place and ``n`` for each slot before. All nodes that cost up to ``low`` are settled, and of these those arcs are read that weigh
    up to twice what is left of ``low`` at their node. The way from one end to another that costs the sum of both sides' ``low`` or less has an arc that leads from what one side has settled to
    what the other has; it weighs no more than what is left on both sides, so no more than twice what is left on one of them, which has read it. So both sides have met on the best
    way, though most arcs were never read.
    """

    #: What a node is: not known, known at a cost over ``low``, settled with arcs left to read, settled with none.
    OPEN, LEFT, READ = 1, 2, 3

    def __init__(self, levels: _Levels, slots: int, mark: np.ndarray):
        self.levels, self.n = levels, len(levels.first) - 1
        size = slots * self.n
        self.cost, self.prev, self.state, self.read, self.mark = np.full(size, np.inf), np.full(size, -1, np.int32), np.zeros(size, np.int8), np.zeros(size, levels.upto.dtype), mark
        self.touched: list[np.ndarray] = []

    def begin(self, at: np.ndarray) -> None:
        """Begins a search at each of the places ``at``."""
        for touched in self.touched:
            self.cost[touched], self.state[touched], self.read[touched] = np.inf, 0, 0
        self.todo, self.left = (np.arange(len(at)) * self.n + at).astype(np.int32), np.zeros(0, np.int32)
        #: ``reach`` is ``low`` of all that have something left to settle or to read
        self.low, self.reach, self.step = np.zeros(len(at)), 0.0, 1.0
        self.cost[self.todo], self.prev[self.todo], self.state[self.todo], self.touched = 0.0, -1, self.OPEN, [self.todo]

    def keep(self, live: np.ndarray) -> None:
        """Goes on with those slots only."""
        self.todo, self.left = (keys[live[keys // self.n]] for keys in (self.todo, self.left))

    def _of(self, other: _Side, keys: np.ndarray) -> np.ndarray:
        """Costs of the other side, which may be one search that all slots share."""
        return other.cost[keys if len(other.low) == len(self.low) else keys % self.n]

    def grow(self, other: _Side, band: float, best: np.ndarray, met: np.ndarray, pruned: bool) -> None:
        """Settles the next band of costs; by slot, ``best`` is the cost of the best way that both sides know, ``met`` where they meet. ``pruned``: what can't be a part of a better way is left out."""
        first, ends, weights, tops, upto = self.levels.first, self.levels.ends, self.levels.weights, self.levels.tops, self.levels.upto
        cost, state, read, limit = self.cost, self.state, self.read, self.reach + band * self.step
        due = cost[self.todo] <= limit
        at, todo, idle = self.todo[due], [self.todo[~due]], True
        state[at] = self.LEFT
        left = [self.left, at]
        at = np.concatenate(left)
        while len(at):
            near, slot = cost[at], at // self.n
            node, room = at - slot * self.n, 2 * (limit - near)
            if pruned:
                bound = best[slot]
                room = np.minimum(room, bound - near)
            known = read[at]
            now = np.maximum(upto[node, np.searchsorted(tops, room)], known)
            read[at] = now
            some = np.flatnonzero(now > known)
            if not len(some):
                break
            idle = False
            at, near, known, node, count = at[some], near[some], known[some], node[some], (now - known)[some].astype(np.int64)
            until = np.cumsum(count)
            arc = np.repeat(first[node] + known - until + count, count) + np.arange(until[-1])
            to, new = ends[arc] + np.repeat(at - node, count), np.repeat(near, count) + weights[arc]
            less = new < cost[to]
            if pruned:
                less &= new + np.minimum(self._of(other, to), other.reach) < np.repeat(bound[some], count)
            less = np.flatnonzero(less)
            to, new, by = to[less], new[less], np.repeat(at, count)[less]
            np.minimum.at(cost, to, new)
            least = new == cost[to]
            to, by = to[least], by[least]
            # of several arcs to a node that cost the same the last one counts
            order = np.arange(len(to), dtype=np.int32)
            self.mark[to] = order
            one = self.mark[to] == order
            to, by = to[one], by[one]
            if not len(to):
                break
            self.prev[to] = by
            costs = cost[to]
            whole, slot = costs + self._of(other, to), to // self.n
            better = np.flatnonzero(whole < best[slot])
            if len(better):
                slot, whole = slot[better], whole[better]
                np.minimum.at(best, slot, whole)
                won = whole == best[slot]
                met[slot[won]] = to[better[won]] - slot[won] * self.n
            was = state[to]
            fresh, inner = was == 0, costs <= limit
            self.touched.append(to[fresh])
            at, outer = to[inner], to[fresh & ~inner]
            read[at] = 0
            left.append(at[was[inner] != self.LEFT])
            state[at], state[outer] = self.LEFT, self.OPEN
            todo.append(outer)
        # a band in which nothing was due is followed by a wider one
        self.reach, self.step = limit, 2 * self.step if idle else 1.0
        at, todo = np.concatenate(left), np.concatenate(todo)
        more = read[at] < upto[at % self.n, -1]
        state[at[~more]] = self.READ
        self.left, self.todo = at[more], todo[state[todo] == self.OPEN]
        self.low[:] = np.inf
        self.low[self.left // self.n] = self.low[self.todo // self.n] = limit

    def way(self, at: int) -> list[int]:
        """Nodes from the key ``at`` back to where the search began."""
        way = []
        while at >= 0:
            way.append(at % self.n)
            at = int(self.prev[at])
        return way


def _meet(near: _Side, far: _Side, band: float, best: np.ndarray, met: np.ndarray, left: int) -> None:
    """Grows both sides until each slot's best way is known. ``left``: how many searches will have used the near side, 0 if it stays as it is.

    No way that both sides don't know yet costs less than the sum of what they have settled, so a search ends when the best way found is no more than that.
    """
    live = np.ones(len(best), bool)
    while True:
        going = near.low + far.low < best
        if not going.any():
            return
        if (going != live).any():
            live = going
            far.keep(live)
            if len(near.low) == len(live):
                near.keep(live)
        if left and len(near.todo) + len(near.left) <= left * (len(far.todo) + len(far.left)):
            near.grow(far, band, best, met, left == 1)
        else:
            far.grow(near, band, best, met, True)


def _met_ways(net: _Net, hub: int, back: bool, ends: np.ndarray, band: float) -> Iterator[tuple[int, float, list[int]]]:
    """Of the places ``ends`` those with a way from the place ``hub`` (``back``: to it), its cost and places from the hub on.

    Searches from the ends meet the one from the hub, which all share and which the first of them makes grow the further the more they are.
    """
    ends = ends[net.part[ends] == net.part[hub]]
    near, far = net.sides() if not back else net.sides()[::-1]
    low, high = 0, 1
    while low < len(ends):
        some = ends[low:high]
        if not low:
            near.begin(np.array([hub]))
        far.begin(some)
        best, met = near.cost[some], some.copy()
        _meet(near, far, band, best, met, len(ends) if not low else 0)
        for k in np.flatnonzero(best < np.inf).tolist():
            yield int(some[k]), float(best[k]), near.way(int(met[k]))[::-1] + far.way(k * far.n + int(met[k]))[1:]
        low, high = high, high + net.slots


def _paired_ways(net: _Net, sources: np.ndarray, targets: np.ndarray, band: float) -> Iterator[tuple[int, int, float, list[int]]]:
    """source, target, cost and places of the way of each pair of places that has one, searched from both."""
    joined = net.part[sources] == net.part[targets]
    sources, targets = sources[joined], targets[joined]
    for low in range(0, len(sources), net.slots):
        some, others = sources[low : low + net.slots], targets[low : low + net.slots]
        near, far = net.sides()
        near.begin(some)
        far.begin(others)
        best, met = np.where(some == others, 0.0, np.inf), others.copy()
        _meet(near, far, band, best, met, 1)
        for k in np.flatnonzero(best < np.inf).tolist():
            at = k * near.n + int(met[k])
            yield int(some[k]), int(others[k]), float(best[k]), near.way(at)[::-1] + far.way(at)[1:]


def _ways(net: _Net, hub: int, back: bool, ends: np.ndarray, band: float) -> Iterator[tuple[int, float, list[int]]]:
    """Of the places ``ends`` those with a way from the place ``hub`` (``back``: to it), its cost and nodes: one search of all, or, unless they are many, one from each that meets the hub's."""
    if len(ends) <= max(FEW_ENDS, len(net.ids) // MANY_ENDS):
        for end, cost, way in _met_ways(net, hub, back, ends, band):
            yield end, cost, net.ids[way[::-1] if back else way].tolist()
        return
    cost, prev = _search(hub, ends, net.back if back else net.ahead, band)
    for end in ends[np.isfinite(cost[ends])].tolist():
        way, at = [], end
        while at >= 0:
            way.append(at)
            at = int(prev[at])
        yield end, float(cost[end]), net.ids[way if back else way[::-1]].tolist()


def _shared_search(links: DataFrame, asked: DataFrame, band: float, tree: bool) -> DataFrame:
    """source, target, cost, path of every distinct row of ``asked`` (source, target) that has a way; with ``tree`` source, node, cost, prev of all nodes."""
    spark = asked.sparkSession
    net = spark.sparkContext.broadcast(_shared(links))
    # a number of parts of our own: rows are few and dear
    parts = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = asked.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = net.value.ids
        places = {int(x): i for i, x in enumerate(ids.tolist())}
        for batch in batches:
            by_source: dict[int, list] = {}
            for source, target in zip(*[batch.column(c).to_pylist() for c in ("source", "target")], strict=True):
                by_source.setdefault(source, []).append(target)
            out: list[tuple] = []
            for source, targets in by_source.items():
                if source is None:
                    continue
                if source not in places:
                    out += [(source, source, 0.0, None if tree else [source])] if tree or source in targets else []
                    continue
                if tree:
                    cost, prev = _search(places[source], None, net.value.ahead, band)
                    at = np.flatnonzero(np.isfinite(cost))
                    before = np.where(prev[at] >= 0, ids[prev[at]], 0)
                    columns = [pa.array([source] * len(at), pa.int64()), pa.array(ids[at], pa.int64()), pa.array(cost[at]), pa.array(before, pa.int64(), mask=prev[at] < 0)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)
                    continue
                known = np.array([places[t] for t in targets if t in places], int)
                out += [(source, int(ids[end]), cost, way) for end, cost, way in _ways(net.value, places[source], False, known, band)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    whole = to_arrow_type(asked.schema["source"].dataType)
    names = ["source", "node", "cost", "prev"] if tree else ["source", "target", "cost", "path"]
    types = [whole, whole, pa.float64(), whole if tree else pa.list_(whole)]
    last = f"prev {kind}" if tree else f"path array<{kind}>"
    dealt = asked.select("source", "target").distinct().repartition(parts, "source").sortWithinPartitions("source")
    return dealt.mapInArrow(run, f"source {kind}, {names[1]} {kind}, cost double, {last}")


def _solved(net: _Net, hubs: np.ndarray, ends: np.ndarray, back: np.ndarray, band: float) -> Iterator[tuple[int, int, float, list[int]]]:
    """source, target, cost, path of requests between places, in the order of hub and ``back``, that have a way."""
    if not len(hubs):
        return  # a group may have its component's arcs and no request
    firsts = np.flatnonzero(np.concatenate(([True], (hubs[1:] != hubs[:-1]) | (back[1:] != back[:-1]))))
    counts = np.diff(np.append(firsts, len(hubs)))
    few = np.repeat(counts <= PAIRED_ENDS, counts)
    for a, b, cost, way in _paired_ways(net, np.where(back, ends, hubs)[few], np.where(back, hubs, ends)[few], band):
        yield net.ids[a], net.ids[b], cost, net.ids[way].tolist()
    for low, n in zip(firsts[counts > PAIRED_ENDS].tolist(), counts[counts > PAIRED_ENDS].tolist(), strict=True):
        hub, to_it = int(hubs[low]), bool(back[low])
        for end, cost, way in _ways(net, hub, to_it, ends[low : low + n], band):
            yield (*((net.ids[end], net.ids[hub]) if to_it else (net.ids[hub], net.ids[end])), cost, way)


def _in_batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    while out := list(itertools.islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _by_hub(asked: DataFrame) -> DataFrame:
    """``asked`` (source, target, ...) with _hub, that of its ends that more requests name, _end, the other, and _back, whether the hub is the target."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    known = asked.withColumn("_back", n("target") > n("source"))
    return known.withColumn("_hub", F.when(F.col("_back"), F.col("target")).otherwise(F.col("source"))).withColumn("_end", F.when(F.col("_back"), F.col("source")).otherwise(F.col("target")))


def _packed(arcs: DataFrame, own: Scratch) -> tuple[DataFrame, int, float, bool]:
    """Arcs (src, dst, weight) between whole numbers as a table of rows of many arcs, how many they are, a band of costs (see :func:`_links`), and whether each stands there the other way too.

    Rows: ahead, n, total, h0, h1, low, high, nodes, ends, weights. ``ahead`` are those from the lesser node, or from a node to itself: where each arc stands both ways they tell the whole network. Each task packs what it has
    computed, so this shuffles nothing. An arc without an end or weight leads nowhere.
    """
    # an arc and its way back tell the same sums
    told = [F.when(F.col("src") != F.col("dst"), F.pmod(F.xxhash64(F.least("node", "to"), F.greatest("node", "to"), "w", F.lit(k)), F.lit(1 << 31))).otherwise(F.lit(0)).alias(f"h{k}") for k in (0, 1)]
    rows = arcs.filter("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL")
    rows = rows.withColumns({"node": F.col("src").cast("long"), "to": F.col("dst").cast("long"), "w": F.col("weight").cast("double")}).select("node", "to", "w", *told)

    def numbers(x: np.ndarray) -> bytes:
        return x.astype(np.int32 if -(1 << 31) <= x.min() and x.max() < 1 << 31 else np.int64).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= PACKED_ARCS):
                node, to, w, *told = (pa.chunked_array([b.column(c) for b in held]).to_numpy() for c in names)
                held = []
                for ahead in (True, False):
                    some = np.flatnonzero((node <= to) == ahead)
                    some = some[np.argsort(node[some], kind="stable")]
                    if len(some):
                        span = [int(min(node[some].min(), to[some].min())), int(max(node[some].max(), to[some].max()))]
                        made = [ahead, len(some), float(w[some].sum()), *[int(h[some].sum()) for h in told], *span, numbers(node[some]), numbers(to[some]), w[some].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types, strict=True)], ["ahead", "n", "total", "h0", "h1", "low", "high", "nodes", "ends", "weights"])

    names = ["node", "to", "w", "h0", "h1"]
    types = [pa.bool_(), pa.int64(), pa.float64(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.binary()]
    packed = own.keep(rows.mapInArrow(pack, "ahead boolean, n long, total double, h0 long, h1 long, low long, high long, nodes binary, ends binary, weights binary"))
    side = lambda c, sign: F.coalesce(F.sum(F.when(F.col("ahead") == sign, F.col(c))), F.lit(0))
    n, total, *sums = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("total"), *[side(c, sign) for sign in (True, False) for c in ("h0", "h1")]).first()
    return packed, n, 4 * ((total or 0.0) / max(n, 1)) or 1.0, sums[:2] == sums[2:]


def _unpack(n: int, nodes: bytes, ends: bytes, weights: bytes) -> tuple[np.ndarray, ...]:
    """src, dst, weight of a row of :func:`_packed`."""
    return (*[np.frombuffer(x, np.int32 if len(x) == 4 * n else np.int64) for x in (nodes, ends)], np.frombuffer(weights))


def _unpacked(packed: DataFrame, node: str, dst: str) -> DataFrame:
    """node, dst, weight of the arcs that :func:`_packed` wrote, of these types; it is read anew by each use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("n", "nodes", "ends", "weights")], strict=True):
                made = _unpack(*[x.as_py() for x in row])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(made, (np.int64, np.int64, float), strict=True)], ["node", "dst", "weight"])

    links = packed.select("n", "nodes", "ends", "weights").mapInArrow(run, "node long, dst long, weight double")
    return links.select(F.col("node").cast(node).alias("node"), F.col("dst").cast(dst).alias("dst"), "weight")


def _packed_search(packed: DataFrame, n: int, both: bool, asked: DataFrame, band: float, scratch: Scratch) -> DataFrame:
    """source, target, cost, path of the distinct rows of ``asked`` (source, target) that have a way, over ``n`` arcs (:func:`_packed`) that a task may hold.

    Requests of a hub (:func:`_by_hub`) stand in one task, and a group of hubs is a row of packed requests. A product of both tables
    lets each task read the arcs from the written table, row by row, and then search for its group: nothing of the network goes through a shuffle, nor through the driver.
    """
    spark = asked.sparkSession
    kind, name = to_arrow_type(asked.schema["source"].dataType), asked.schema["source"].dataType.simpleString()
    long = lambda c, to: F.col(c).cast("long").alias(to)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            columns = [pa.chunked_array([b.column(c) for b in held]).to_numpy(zero_copy_only=False) for c in ("hub", "end", "back")]
            made = [c.astype(t).tobytes() for c, t in zip(columns, (np.int64, np.int64, bool), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], ["hubs", "others", "backs"])

    known = scratch.keep(_by_hub(asked).select(long("_hub", "hub"), long("_end", "end"), F.col("_back").alias("back")))
    groups = max(2 * spark.sparkContext.defaultParallelism, math.ceil(known.count() / max(GROUP_REQUESTS, n // REQUEST_ARCS)))
    grouped = known.repartition(groups, "hub").sortWithinPartitions("hub", "back").mapInArrow(gather, "hubs binary, others binary, backs binary")
    names, types = ["source", "target", "cost", "path"], [kind, kind, pa.float64(), pa.list_(kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, mine, batch = [], None, None
        for batch in batches:
            for k in range(batch.num_rows):
                mine = mine or [batch.column(c)[k].as_py() for c in ("hubs", "others", "backs")]
                chunks.append(_unpack(*[batch.column(c)[k].as_py() for c in ("n", "nodes", "ends", "weights")]))
        if mine is None:
            return
        del batch
        hubs, others, back = np.frombuffer(mine[0], np.int64), np.frombuffer(mine[1], np.int64), np.frombuffer(mine[2], bool)
        net = _Net.of_chunks(chunks, both)
        chunks.clear()
        hubs, others = net.places(hubs), net.places(others)
        fit = (hubs >= 0) & (others >= 0)
        yield from _in_batches(_solved(net, hubs[fit], others[fit], back[fit], band), types, names)

    told = packed.filter("ahead") if both else packed
    return told.select("n", "nodes", "ends", "weights").coalesce(1).hint("shuffle_replicate_nl").crossJoin(grouped).mapInArrow(run, f"source {name}, target {name}, cost double, path array<{name}>")


class _Passed:
    """Least costs from a few sources, by ids from ``low`` on, over arcs that pass by: what each node costs and the node before is held, no arc is."""

    def __init__(self, sources: list[int], low: int, high: int):
        self.low, self.size, self.sources = low, high - low + 1, sources
        # all sources' costs of a node stand together, as one is read after the other
        self.cost, self.prev = (np.full((self.size, len(sources)), x, t) for x, t in ((np.inf, np.float64), (-1, np.int32)))
        for k, source in enumerate(sources):
            if low <= source <= high:
                self.cost[source - low, k] = 0.0

    def take(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, both: bool) -> bool:
        """Whether some arc (``both``: or its way back) tells a lesser cost."""
        n, cost, prev, lesser = len(self.sources), self.cost.reshape(-1), self.prev.reshape(-1), False
        for low in range(0, len(src), PASSED_ARCS):
            part = slice(low, low + PASSED_ARCS)
            ends, w = [x[part] - self.low for x in (src, dst)], weight[part, None]
            costs = [self.cost.take(x, axis=0) for x in ends]
            # no arc with its way back tells both
            for k in (0, 1) if both else (0,):
                new = costs[k] + w
                less = np.flatnonzero(new < costs[1 - k])
                if len(less):
                    row = less // n
                    at, new = ends[1 - k][row].astype(np.int64) * n + less % n, new.reshape(-1)[less]
                    np.minimum.at(cost, at, new)
                    best = new == cost[at]
                    prev[at[best]] = ends[k][row[best]]
                    lesser = True
        return lesser

    def ways(self, k: int, targets: np.ndarray) -> Iterator[tuple[int, int, float, list[int]]]:
        """source, target, cost, path of those of ``targets`` that the k-th source has a way to."""
        cost, prev = self.cost[:, k], self.prev[:, k]
        targets = targets[(targets >= self.low) & (targets < self.low + self.size)] - self.low
        for target in targets[np.isfinite(cost[targets])].tolist():
            way, at = [], target
            while at >= 0:
                way.append(at + self.low)
                at = int(prev[at])
            yield self.sources[k], target + self.low, float(cost[target]), way[::-1]


def _passed_search(packed: DataFrame, both: bool, span: tuple[int, int], sources: list[int], asked: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """source, target, cost, path of the distinct rows of ``asked`` (source, target) that have a way, and whether these are all, for few sources over a network (:func:`_packed`) that no task holds.

    A task holds what each node costs from its sources. It reads the requests and then the packed arcs, again and again until a pass tells no lesser cost, which takes at most as many passes as the ways have steps;
    it ends then. Nothing of the network goes through a shuffle, nor through the driver. Sources whose ways take more than ``PASSES`` passes are not told.
    """
    spark = asked.sparkSession
    kind, name = to_arrow_type(asked.schema["source"].dataType), asked.schema["source"].dataType.simpleString()
    most = max(1, min(math.ceil(len(sources) / spark.sparkContext.defaultParallelism), PASSED_NODES // (span[1] - span[0] + 1)))
    groups = [sources[k : k + most] for k in range(0, len(sources), most)]
    groups = spark.createDataFrame(list(enumerate(groups)), "_group int, own array<long>").repartitionById(len(groups), F.col("_group")).select("own")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [batch.column(c).to_numpy().astype(np.int64).tobytes() for c in ("source", "target")]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *[pa.array([x], pa.binary()) for x in made], pa.array([b""], pa.binary())], ["n", "nodes", "ends", "weights"])

    requests = scratch.keep(asked.select("source", "target").mapInArrow(gather, "n long, nodes binary, ends binary, weights binary"))
    told = (packed.filter("ahead") if both else packed).select("n", "nodes", "ends", "weights")
    n_requests, n_told = requests.count(), told.count()
    rows = requests.withColumn("pass", F.lit(-1))
    for k in range(PASSES):
        rows = rows.unionByName(told.withColumn("pass", F.lit(k)))
    names, types = ["source", "target", "cost", "path"], [kind, kind, pa.float64(), pa.list_(kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, targets = None, []
        # of each pass, when it began and how many of its rows have come; when the last lesser cost came
        begun, come, at, last, whole = {}, {}, 0, -1, False
        for batch in batches:
            for k in range(batch.num_rows):
                if found is None:
                    found = _Passed(batch.column("own")[k].as_py(), *span)
                    targets = [[] for _ in found.sources]
                number, n, nodes, ends, weights = (batch.column(c)[k].as_py() for c in ("pass", "n", "nodes", "ends", "weights"))
                at += 1
                begun.setdefault(number, at)
                come[number] = come.get(number, 0) + 1
                if number < 0:
                    asks, wants = np.frombuffer(nodes, np.int64), np.frombuffer(ends, np.int64)
                    for source, mine in zip(found.sources, targets, strict=True):
                        mine.append(wants[asks == source])
                elif not whole:
                    if found.take(*_unpack(n, nodes, ends, weights), both):
                        last = at
                    whole = come[number] == n_told and last < begun[number]
            if whole and come.get(-1, 0) == n_requests:
                break
        if found is None:
            return
        if whole:
            rows = itertools.chain.from_iterable(found.ways(k, np.concatenate([*mine, np.zeros(0, np.int64)])) for k, mine in enumerate(targets))
            # that a source is done is told by a row without a target
            yield from _in_batches(itertools.chain(rows, ((source, None, None, None) for source in found.sources)), types, names)

    passed = rows.coalesce(1).hint("shuffle_replicate_nl").crossJoin(groups)
    known = scratch.keep(passed.mapInArrow(run, f"source {name}, target {name}, cost double, path array<{name}>"))
    return known.filter("target IS NOT NULL"), known.filter("target IS NULL").count() == len(sources)


def _grouped_search(links: DataFrame, asked: DataFrame, placed: DataFrame, sizes: DataFrame, band: float, scratch: Scratch) -> DataFrame:
    """source, target, cost, path of the rows of ``asked`` (source, target, component) that have a way, in components of bounded size.

    placed: node, component; sizes: component, requests. A request belongs to that of its ends that more requests name, from which one search serves them all. Components stand in a row by their
    requests, and the row is cut into groups of equal numbers of requests: a large component is dealt to several groups, small ones share one. A task reads
    its group's arcs and requests component by component and holds one component at a time. Arcs are shuffled once for each group that needs them.
    """
    spark, total = asked.sparkSession, sizes.agg(F.sum("requests")).first()[0] or 0
    kind = to_arrow_type(asked.schema["source"].dataType)
    name = asked.schema["source"].dataType.simpleString()
    groups = max(spark.sparkContext.defaultParallelism, math.ceil(total / GROUP_REQUESTS))
    # one row a component that is asked for
    until = F.sum("requests").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    group = lambda c: F.floor(c * groups / max(total, 1)).cast("int")
    spans = scratch.keep(sizes.withColumn("_u", until).select("component", group(F.col("_u") - F.col("requests")).alias("_a"), group(F.col("_u") - 1).alias("_b")))
    known = _by_hub(asked)
    known = known.join(spans, "component").withColumn("_group", F.col("_a") + F.pmod(F.xxhash64("_hub"), F.col("_b") - F.col("_a") + 1).cast("int"))
    requests = known.select("_group", "component", F.lit(1).alias("_kind"), F.col("_hub").cast("long").alias("a"), F.col("_end").cast("long").alias("b"), F.lit(0.0).alias("w"), F.col("_back").alias("back"))
    arcs = links.join(placed.join(spans, "component"), "node").withColumn("_group", F.explode(F.sequence("_a", "_b")))
    arcs = arcs.select("_group", "component", F.lit(0).alias("_kind"), F.col("node").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("weight").alias("w"), F.lit(False).alias("back"))
    dealt = arcs.unionByName(requests).repartitionById(groups, F.col("_group")).sortWithinPartitions("component", "_kind", "a", "back")
    names = ["source", "target", "cost", "path"]
    types = [kind, kind, pa.float64(), pa.list_(kind)]

    def solved(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        of, a, b, w, back = (table.column(c).to_numpy() for c in ("_kind", "a", "b", "w", "back"))
        cut_at = int(np.searchsorted(of, 1))
        net = _Net(a[:cut_at], b[:cut_at], w[:cut_at])
        hubs, ends, back = net.places(a[cut_at:]), net.places(b[cut_at:]), back[cut_at:]
        yield from _in_batches(_solved(net, hubs, ends, back, band), types, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            component = batch.column("component").to_numpy()
            borders = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(component)]
            for low, high in zip(borders, borders[1:], strict=False):
                if low == high:
                    continue
                if held and held[-1].column("component")[0].as_py() != component[low]:
                    yield from solved(held)
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from solved(held)

    return dealt.select("component", "_kind", "a", "b", "w", "back").mapInArrow(run, f"source {name}, target {name}, cost double, path array<{name}>")


def _banded_search(
    links: DataFrame, sources: DataFrame, waiting: DataFrame | None, band: float, own: Scratch, most_rounds: int, pruned: Callable[[DataFrame], DataFrame] = lambda reached: reached
) -> DataFrame:
    """source, node, cost, prev: settled nodes of every source, a table that is only appended to.

    Tentative labels are filed under the band of their cost and are looked at when the band comes up; labels of the band at
    hand are improved among themselves; then they are settled and never written again. A source ends with the band in which
    the last of its targets in ``waiting`` (source, target) is settled; without ``waiting`` it goes on to the end of its component.
    A round reads one band's labels and the settled keys and writes what has changed. ``pruned`` may leave out rows (source, node, cost, prev) that
    needn't be followed.
    """
    spark, folder = links.sparkSession, f"{own.folder}/bands-{uuid.uuid4().hex}"
    key, row = ["source", "node"], ["source", "node", "cost", "prev"]
    kind = links.schema["node"].dataType
    begin = sources.select("source", F.col("source").alias("node")).distinct()
    begin = begin.select(*key, F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("prev"), F.lit(0).cast("long").alias("band"))
    shape = begin.schema
    # few files: rows of a band come together, unless they are many
    add = lambda df, name: df.hint("rebalance", F.col("band")).write.mode("append").option("compression", "zstd").partitionBy("band").parquet(f"{folder}/{name}")
    read = lambda name: spark.read.schema(shape).parquet(f"{folder}/{name}")
    least = lambda df: df.groupBy(*key).agg(F.min(F.struct("cost", "prev")).alias("b")).select(*key, "b.cost", "b.prev")
    add(begin, "open")
    add(begin.limit(0), "closed")
    at, rounds = 0, 0
    while at is not None:
        fresh = least(read("open").filter(F.col("band") == at)).join(read("closed").select(*key), key, "left_anti")
        if waiting is not None:
            fresh = fresh.join(waiting.select("source"), "source", "left_semi")
        current, old = None, []
        while True:
            rounds += 1
            if rounds > most_rounds:
                raise RuntimeError(f"costs still fall after {most_rounds} rounds")
            fresh = own.keep(fresh)
            for n in old:
                own.remove(n)
            old = [own.n]
            if fresh.isEmpty():
                break
            if current is None:
                current = fresh
                old = []
            else:
                current, before = own.keep(current.join(fresh, key, "left_anti").select(*row).unionByName(fresh.select(*row))), current_n
                old.append(before)
            current_n = own.n
            onward = fresh.join(links, "node").select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("node").alias("prev"))
            reached = own.keep(pruned(least(onward)).withColumn("band", F.floor(F.col("cost") / band).cast("long")))
            old.append(own.n)
            add(reached.filter(F.col("band") > at), "open")
            known = current.select(*key, F.col("cost").alias("_was"))
            fresh = reached.filter(F.col("band") <= at).join(known, key, "left").filter("_was IS NULL OR cost < _was").select(*row)
            fresh = fresh.join(read("closed").select(*key), key, "left_anti")
        if current is not None:
            add(current.withColumn("band", F.lit(at).cast("long")), "closed")
            if waiting is not None:
                waiting = own.keep(waiting.join(current.select("source", F.col("node").alias("target")), ["source", "target"], "left_anti"))
            own.remove(current_n)
        later = read("open").filter(F.col("band") > at)
        if waiting is not None:
            later = later.join(waiting.select("source"), "source", "left_semi")
        at = later.agg(F.min("band")).first()[0]
    return read("closed").drop("band")


def _links(arcs: DataFrame, own: Scratch) -> tuple[DataFrame, int, float]:
    """The arcs as a table, how many they are, and a band of costs: four mean weights."""
    links = own.keep(arcs.select(F.col("src").alias("node"), "dst", F.col("weight").cast("double").alias("weight")))
    n, mean = links.agg(F.count("*"), F.avg("weight")).first()
    return links, n, 4 * (mean or 0.0) or 1.0


def _whole_numbers(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")


def path_tree(arcs: DataFrame, sources: DataFrame, most_rounds: int = 100_000, scratch: Scratch | None = None, shared_arcs: int = SHARED_ARCS) -> DataFrame:
    """source, node, cost, prev: least costs from each source over arcs (src, dst, weight >= 0) and the node before on such a way.

    Up to ``shared_arcs`` arcs between whole numbers go to all workers and each source is searched in a task; otherwise sources are searched
    together by joins, see :func:`_banded_search`, for which nodes may be of any type that can be sorted. With ``scratch`` the result is a
    table of it.
    """
    own = scratch or Scratch(arcs.sparkSession)
    links, n, band = _links(arcs, own)
    if n <= shared_arcs and _whole_numbers(links, "node"):
        found = own.keep(_shared_search(links, sources.select("source", F.col("source").alias("target")), band / 16, True))
    else:
        found = _banded_search(links, sources, None, band, own, most_rounds)
    if scratch is None:
        found = cut(found)
        own.remove()
    return found


def shortest_paths(arcs: DataFrame, requests: DataFrame, shared_arcs: int = SHARED_ARCS, most_rounds: int = 100_000) -> DataFrame:
    """requests (request_id, source, target) with cost and path (nodes in order); both null where there is no way.

    arcs: src, dst, weight >= 0. Of several ways of least cost one is given. A null end has no way; a source that no arc names has one to itself.
    Up to ``shared_arcs`` arcs between whole numbers go to all workers, and up to ``NET_SHARE`` times as many are packed and read by each task (:func:`_packed_search`). Over more, up to ``PASSED_SOURCES`` sources are
    searched while the packed arcs pass by (:func:`_passed_search`); otherwise a larger network is told apart
    into components first: ends in two of them have no way, which a join tells without a search. A component of up to ``COMPONENT_SHARE`` times ``shared_arcs`` arcs is searched in tasks of its own (:func:`_grouped_search`), one
    of up to ``PACKED_SHARE`` times as many is packed. What is left, a component that no task should hold or nodes that are no whole numbers, is searched together by joins, where paths are walked
    back by doubling (:func:`_walked`). For many sources over a large network see :func:`hub_labels`.
    """
    with Scratch(arcs.sparkSession) as scratch:
        asked = scratch.keep(requests.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
        whole = _whole_numbers(arcs, "src") and _whole_numbers(arcs, "dst") and _whole_numbers(asked, "source")
        if whole:
            packed, n, band, both = _packed(arcs, scratch)
            links = _unpacked(packed, *[arcs.schema[c].dataType.simpleString() for c in ("src", "dst")])
        else:
            links, n, band = _links(arcs, scratch)
        if n <= shared_arcs and whole:
            paths = scratch.keep(_shared_search(links, asked, band / 16, False))
            return cut(requests.join(paths, ["source", "target"], "left").select(*requests.columns, "cost", "path"))
        # a node has a way to itself, whether an arc names it or not
        paths = asked.filter("source = target").select("source", "target", F.lit(0.0).alias("cost"), F.array("source").alias("path"))
        if n <= NET_SHARE * shared_arcs and whole:
            paths = paths.unionByName(scratch.keep(_packed_search(packed, n, both, asked.filter("source != target"), band / 16, scratch)))
            return cut(requests.join(paths, ["source", "target"], "left").select(*requests.columns, "cost", "path"))
        span = packed.agg(F.min("low"), F.max("high")).first() if whole and n > PACKED_SHARE * shared_arcs > 0 else None
        if span and span[1] - span[0] < PASSED_SHARE * shared_arcs:
            few = [r["source"] for r in asked.filter("source != target").select("source").distinct().limit(PASSED_SOURCES + 1).collect()]
            if 0 < len(few) <= PASSED_SOURCES:
                found, all_told = _passed_search(packed, both, tuple(span), few, asked.filter("source != target"), scratch)
                if all_told:
                    return cut(requests.join(paths.unionByName(found), ["source", "target"], "left").select(*requests.columns, "cost", "path"))
        placed = connected_components(links.select(F.col("node").alias("src"), "dst"), scratch)
        of = lambda c: placed.select(F.col("node").alias(c), "component")
        met = scratch.keep(asked.filter("source != target").join(of("source"), "source").join(of("target"), ["target", "component"]).select("source", "target", "component"))
        sizes = met.groupBy("component").agg(F.count("*").alias("requests"))
        sizes = scratch.keep(sizes.join(links.join(placed, "node").groupBy("component").agg(F.count("*").alias("arcs")), "component"))
        most = COMPONENT_SHARE * shared_arcs if whole else 0
        small, large = sizes.filter(F.col("arcs") <= most), sizes.filter(F.col("arcs") > most)
        if not small.isEmpty():
            fits = small.select("component")
            found = _grouped_search(links, met.join(fits, "component", "left_semi"), placed, small.select("component", "requests"), band / 16, scratch)
            paths = paths.unionByName(scratch.keep(found))
        # few: each holds more than COMPONENT_SHARE * shared_arcs arcs
        for r in large.filter(F.col("arcs") <= (PACKED_SHARE * shared_arcs if whole else 0)).collect():
            one = F.col("component") == r["component"]
            own, n, _, both = _packed(links.join(placed.filter(one).select("node"), "node", "left_semi").withColumnRenamed("node", "src"), scratch)
            paths = paths.unionByName(scratch.keep(_packed_search(own, n, both, met.filter(one).select("source", "target"), band / 16, scratch)))
        large = large.filter(F.col("arcs") > (PACKED_SHARE * shared_arcs if whole else 0))
        if not large.isEmpty():
            rest = scratch.keep(met.join(large.select("component"), "component", "left_semi").select("source", "target"))
            tree = _banded_search(links, rest.select("source"), rest, band, scratch, most_rounds)
            ends = scratch.keep(rest.join(tree.select("source", F.col("node").alias("target"), "cost"), ["source", "target"]))
            paths = paths.unionByName(ends.join(_walked(tree, ends.select("source", "target"), scratch), ["source", "target"]).select("source", "target", "cost", "path"))
        return cut(requests.join(paths, ["source", "target"], "left").select(*requests.columns, "cost", "path"))


def _walked(tree: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """source, target, path of the distinct ``ends`` (source, target) along trees (source, node, prev).

    By doubling: in each round every node of a tree learns the node twice as far back and the steps to it, so a path of n nodes takes log n rounds.
    """
    # jump: the node 2^k steps back, and the nodes between, nearest first
    jump = tree.filter("prev IS NOT NULL").select("source", "node", F.col("prev").alias("to"), F.array("prev").alias("over"))
    walks = scratch.keep(ends.select("source", F.col("target").alias("node"), F.col("target").alias("at"), F.array("target").alias("back")))
    while not walks.filter("at != source").isEmpty():
        jump = scratch.keep(jump)
        onward = walks.join(jump.select("source", F.col("node").alias("at"), "to", "over"), ["source", "at"], "left")
        walks = scratch.keep(onward.select("source", "node", F.coalesce("to", "at").alias("at"), F.concat("back", F.coalesce("over", F.slice("back", 1, 0))).alias("back")))
        further = jump.select("source", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("over").alias("_over"))
        jump = jump.join(further, ["source", "to"], "left").select(
            "source", "node", F.coalesce("_to", "to").alias("to"), F.concat("over", F.coalesce("_over", F.slice("over", 1, 0))).alias("over")
        )
    return walks.select("source", F.col("node").alias("target"), F.reverse("back").alias("path"))


def hub_labels(arcs: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """node, hub, cost, prev: labels by which :func:`labelled_paths` answers any number of requests over the same arcs.

    arcs: src, dst, weight >= 0, each also the other way with the same weight. Nodes are ranked by their number of arcs; batches of them, of
    doubling size in the order of ranks, are searched together by :func:`_banded_search`. A node is left out, and not gone beyond, where the labels of
    the batches before already give the cost: one join of both ends' labels on the hub. So the first hubs reach everything and
    later ones a small neighbourhood; on road networks a node ends up with few labels. prev is the node before on the way from the hub. Built once,
    for networks that are too large for a search each; the number of batches is the logarithm of the number of nodes.
    """
    with Scratch(arcs.sparkSession) as scratch:
        links, _, band = _links(arcs, scratch)
        ranked = links.groupBy("node").agg(F.count("*").alias("n"))
        rank = scratch.keep(ranked.orderBy(F.desc("n"), F.xxhash64("node")).select("node", F.monotonically_increasing_id().alias("_place")))
        # the upper bits of a place are its part, and the lower ones count from 0 in it; one row a part is summed up
        part = F.shiftright("_place", 33).alias("p")
        sizes = rank.groupBy(part).agg(F.count("*").alias("n"))
        begins = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
        placed = rank.select("node", part, F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")).join(begins, "p")
        position = scratch.keep(placed.select("node", (F.col("_begin") + F.col("_in")).alias("at")))
        total = position.count()
        labels, low = None, 0
        while low < total:
            high = min(total, 2 * low + 1)
            hubs = position.filter((F.col("at") >= low) & (F.col("at") < high)).select(F.col("node").alias("source"))

            def pruned(reached: DataFrame, known: DataFrame | None = labels) -> DataFrame:
                if known is None:
                    return reached
                own = known.select(F.col("node").alias("source"), "hub", F.col("cost").alias("_a"))
                other = known.select("node", "hub", F.col("cost").alias("_b"))
                better = reached.join(own, "source").join(other, ["node", "hub"]).filter(F.col("_a") + F.col("_b") <= F.col("cost")).select("source", "node").distinct()
                return reached.join(better, ["source", "node"], "left_anti")

            found = _banded_search(links, hubs, None, band, scratch, most_rounds, pruned).select("node", F.col("source").alias("hub"), "cost", "prev")
            labels = scratch.keep(found if labels is None else labels.unionByName(found))
            low = high
        if labels is None:
            labels = links.select("node", F.col("node").alias("hub"), F.col("weight").alias("cost"), F.col("node").alias("prev")).limit(0)
        return cut(labels)


def labelled_paths(labels: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id unique, source, target) with cost and path, both null where there is no way, by the labels of :func:`hub_labels`.

    The labels of both ends are joined on the hub, so a request costs as many rows as its ends have labels, however many sources there are. Ends
    that no arc names have a way to themselves only.
    """
    with Scratch(requests.sparkSession) as scratch:
        labels = scratch.keep(labels)
        end = lambda c, k: labels.select(F.col("node").alias(c), "hub", F.col("cost").alias(f"_{k}"))
        met = requests.select("request_id", "source", "target").join(end("source", "a"), "source").join(end("target", "b"), ["target", "hub"])
        best = met.groupBy("request_id").agg(F.min(F.struct((F.col("_a") + F.col("_b")).alias("cost"), "hub")).alias("m")).select("request_id", "m.cost", "m.hub")
        known = scratch.keep(requests.join(best, "request_id", "left"))
        hubs = known.filter("hub IS NOT NULL")
        ends = hubs.select(F.col("hub").alias("source"), F.explode(F.array("source", "target")).alias("target")).distinct()
        way = scratch.keep(_walked(labels.select(F.col("hub").alias("source"), "node", "prev"), ends, scratch))
        side = lambda c: way.select(F.col("source").alias("hub"), F.col("target").alias(c), F.col("path").alias(f"_{c}"))
        joined = known.join(side("source"), ["hub", "source"], "left").join(side("target"), ["hub", "target"], "left")
        path = F.concat(F.reverse("_source"), F.slice("_target", 2, F.greatest(F.size("_target") - 1, F.lit(0))))
        alone = F.col("hub").isNull() & (F.col("source") == F.col("target"))
        return cut(joined.select(*requests.columns, F.when(alone, 0.0).otherwise(F.col("cost")).alias("cost"), F.when(alone, F.array("source")).otherwise(path).alias("path")))


def _both_ways(arcs: DataFrame) -> DataFrame:
    """Distinct src, dst of the arcs and their reverse. One shuffle of a row an arc; what comes of it is made in place."""
    pairs = arcs.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    pairs = pairs.filter(F.col("lo").isNotNull()).distinct()
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select(F.explode(F.when(F.col("lo") == F.col("hi"), F.array(way("lo", "hi"))).otherwise(F.array(way("lo", "hi"), way("hi", "lo")))).alias("w")).select("w.src", "w.dst")


def hop_distance(arcs: DataFrame, source: int, shared_arcs: int = SHARED_ARCS) -> DataFrame:
    """node, hops from one node, direction ignored; no rows if no arc names it.

    Least costs with a weight of 1: rings are appended to one table, so the plan of a round doesn't depend on the depth; up to ``shared_arcs`` arcs are searched in one task.
    """
    with Scratch(arcs.sparkSession) as scratch:
        both = scratch.keep(_both_ways(arcs).withColumn("weight", F.lit(1.0)))
        start = both.filter(F.col("src") == source).select(F.col("src").alias("source")).distinct()
        return cut(path_tree(both, start, scratch=scratch, shared_arcs=shared_arcs).select("node", F.col("cost").cast("long").alias("hops")))


def transition_matrix(arcs: DataFrame, sink: int, priority: list[int], favour: float = 1.5, kept: float = 0.5, directed: bool = False) -> DataFrame:
    """src, dst, share: how the flow of a state src is split among the states that ``arcs`` (src, dst) lead to, both ways unless ``directed``.

    A state with an arc to the sink sends ``1 - kept`` of its flow there and ``kept`` evenly to the others; if the sink is its only
    one the kept part is lost. Other states split by the hops of their neighbours from the sink (direction ignored; states that
    never reach it, and the sink, take nothing), ``favour`` times for priority states. A state with only itself keeps its flow.
    The even part of every pair is a scalar in :func:`steady_state`.
    """
    one = arcs.select("src", "dst")
    one = one.distinct() if directed else _both_ways(one)
    hops = hop_distance(arcs, sink).withColumnRenamed("node", "dst")
    by = Window.partitionBy("src")
    known = (
        one.join(hops, "dst", "left")
        .withColumn("_only", F.min(F.col("src") == F.col("dst")).over(by))
        .withColumn("_sinks", F.max(F.col("dst") == sink).over(by))
        .withColumn("_n", F.sum((F.col("dst") != sink).cast("long")).over(by))
    )
    pull = F.coalesce(F.col("hops").cast("double"), F.lit(0.0)) * F.when(F.col("dst").isin(priority), F.lit(favour)).otherwise(1.0)
    share = (
        F.when(F.col("_only"), F.lit(1.0))
        .when(F.col("_sinks") & (F.col("dst") == sink), F.lit(1 - kept))
        .when(F.col("_sinks"), F.lit(kept) / F.col("_n"))
        .otherwise(F.try_divide(pull, F.sum(pull).over(by)))  # null where no neighbour reaches the sink
    )
    return known.select("src", "dst", share.alias("share")).filter("share > 0")


#: Products in a row before the series is extrapolated.
PRODUCTS = 7
#: States of a block of the vector, shares that come out of one, and shares that are packed together, about.
BLOCK_STATES, BLOCK_SHARES, CELL_SHARES = 1 << 19, 1 << 25, 1 << 21


def _packed_shares(shares: DataFrame, states: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix as cells (block, to, ends, starts, shares) between blocks of states, in buckets of their block; the places (state, block, at); block, n.

    Each block has a row without shares too, under which its own vector passes by. Shares are shuffled three times here, and then no more.
    """
    n_shares = shares.count()
    blocks = max(1, math.ceil(n / BLOCK_STATES), math.ceil(n_shares / BLOCK_SHARES))
    chunks = max(1, math.ceil(n_shares / blocks**2 / CELL_SHARES))
    order = Window.partitionBy("block").orderBy("state")
    placed = states.withColumn("block", F.pmod(F.xxhash64("state"), F.lit(blocks)).cast("int"))
    placed = scratch.keep(placed.withColumn("at", F.row_number().over(order) - 1))
    end = lambda c, b, k: placed.select(F.col("state").alias(c), F.col("block").alias(b), F.col("at").alias(k))
    met = shares.join(end("src", "block", "_start"), "src").join(end("dst", "to", "_end"), "dst")
    met = met.select("block", "to", F.pmod(F.xxhash64("src", "dst"), F.lit(chunks)).alias("_chunk"), "_start", "_end", "share")

    def pack(rows: pa.Table) -> pa.Table:
        ends, starts, values = (rows.column(c).to_numpy() for c in ("_end", "_start", "share"))
        packed = [ends.astype(np.int32).tobytes(), starts.astype(np.int32).tobytes(), values.astype(np.float64).tobytes()]
        return pa.table([*rows.slice(0, 1).select(["block", "to"]).columns, *[pa.array([b], pa.binary()) for b in packed]], names=["block", "to", "ends", "starts", "shares"])

    cells = met.groupBy("block", "to", "_chunk").applyInArrow(pack, "block int, to int, ends binary, starts binary, shares binary")
    sizes = scratch.keep(placed.groupBy("block").agg(F.count("*").cast("int").alias("n")))
    none = F.lit(None).cast("binary")
    own = sizes.select("block", F.col("block").alias("to"), none.alias("ends"), none.alias("starts"), none.alias("shares"))
    parts = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.keep_bucketed(cells.unionByName(own), "block", parts), placed, sizes


_VECTOR = "block int, n int, made binary"


def _by_row(made: Callable[[dict], dict | None]):
    """A function of one row for mapInArrow, for few rows with much in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(made(batch.slice(k, 1).to_pylist()[0]))

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What cells send on: sums by place of a block (part), and of each block the vectors that were made of it. Some sixteen blocks' sums are held."""
    sums: dict[int, np.ndarray] = {}
    row = lambda block, n, made, part: pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([n], pa.int32()), pa.array([made], pa.binary()), pa.array([part], pa.binary())], ["block", "n", "made", "part"]
    )
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            if r["ends"] is None:
                yield row(r["block"], r["n"], r["made"], None)
                continue
            ends, starts = np.frombuffer(r["ends"], np.int32), np.frombuffer(r["starts"], np.int32)
            part = np.bincount(ends, weights=np.frombuffer(r["shares"]) * np.frombuffer(r["last"])[starts])
            known = sums.pop(r["to"], part[:0])
            if len(known) > len(part):
                known, part = part, known
            part[: len(known)] += known
            sums[r["to"]] = part
            if len(sums) > 16:
                to = next(iter(sums))
                yield row(to, None, None, sums.pop(to).tobytes())
    for to, part in sums.items():
        yield row(to, None, None, part.tobytes())


def _multiplied(cells: DataFrame, vector: DataFrame, damping: float, leading: float) -> DataFrame:
    """block, n, made: the vectors made so far, in a row, and one product more."""

    def came(rows: pa.Table) -> pa.Table:
        made = next(r for r in rows.select(["block", "n", "made"]).to_pylist() if r["made"] is not None)
        into = np.zeros(made["n"])
        for part in rows.column("part"):
            if part.is_valid:
                sums = np.frombuffer(part.as_buffer())
                into[: len(sums)] += sums
        out = made["made"] + ((damping * into + 1) / leading).tobytes()
        return pa.table([pa.array([made["block"]], pa.int32()), pa.array([made["n"]], pa.int32()), pa.array([out], pa.binary())], names=["block", "n", "made"])

    alone = F.col("ends").isNull()
    last = F.expr("substring(made, length(made) - 8 * n + 1, 8 * n)")
    met = cells.join(vector, "block").select("block", "to", "n", "ends", "starts", "shares", F.when(~alone, last).alias("last"), F.when(alone, F.col("made")).alias("made"))
    return met.mapInArrow(_products, "block int, n int, made binary, part binary").groupBy("block").applyInArrow(came, _VECTOR)


def steady_state(matrix: DataFrame, damping: float = 0.9, tolerance: float = 1e-11, most_rounds: int = 60, states: DataFrame | None = None) -> DataFrame:
    """state, value: the leading vector of damping * M + (1 - damping) / N, of length 1. matrix: src, dst, share >= 0.

    ``states`` (state) may name more than the matrix does. Columns of M need not sum to 1. Scaled so that the even part is 1 for every state, the vector x solves l x = damping * M x + 1
    for the leading value l. A round makes seven products in one job and takes the mix of them whose change is least; one
    row with the products of the changes and their sums comes to the driver, and l follows from the sums. The rounds end when
    the change of the mix, relative to it, and that of l are under ``tolerance``. States stand in blocks, shares in cells between two blocks that stay where they are,
    and a product sends on eight bytes a state for each block, not a row a share.
    """
    with Scratch(matrix.sparkSession) as scratch:
        shares = scratch.keep(matrix.select("src", "dst", F.col("share").cast("double").alias("share")))
        known = shares.select(F.col("src").alias("state")).unionByName(shares.select(F.col("dst").alias("state")))
        states = scratch.keep((known if states is None else known.unionByName(states.select("state"))).distinct())
        n = states.count()
        if not n:
            return cut(states.withColumn("value", F.lit(0.0)))
        cells, placed, sizes = _packed_shares(shares, states, n, scratch)
        row = lambda r, made: {"block": pa.array([r["block"]], pa.int32()), "n": pa.array([r["n"]], pa.int32()), "made": pa.array([made], pa.binary())}
        vector, leading = sizes.mapInArrow(_by_row(lambda r: row(r, np.full(r["n"], 1 / (1 - damping)).tobytes())), _VECTOR), 1.0
        pairs = [(i, j) for i in range(PRODUCTS) for j in range(i, PRODUCTS)]

        def summed(r: dict) -> dict:
            made = np.frombuffer(r["made"]).reshape(-1, r["n"])
            change = made[1:] - made[:-1]
            return {"s": pa.array([[*[float(change[i] @ change[j]) for i, j in pairs], *made.sum(axis=1).tolist(), float(made[-1] @ made[-1])]], pa.list_(pa.float64()))}

        for _ in range(most_rounds):
            made = vector
            for _ in range(PRODUCTS):
                made = _multiplied(cells, made, damping, leading)
            made = scratch.keep(made)
            sums = made.mapInArrow(_by_row(summed), "s array<double>")
            row_ = sums.agg(*[F.sum(F.col("s")[k]) for k in range(len(pairs) + PRODUCTS + 2)]).first()
            gram, sums = np.zeros((PRODUCTS, PRODUCTS)), np.array(row_[len(pairs) : -1])
            for (i, j), x in zip(pairs, row_, strict=False):
                gram[i, j] = gram[j, i] = x
            size = np.sqrt(np.outer(gram.diagonal(), gram.diagonal()))
            mix = np.eye(PRODUCTS)[-1]
            if (size > 0).all():
                # the weights, of sum 1, under which the changes cancel best
                scale = np.sqrt(gram.diagonal())
                w = np.linalg.pinv(gram / size, rcond=1e-13, hermitian=True) @ (1 / scale) / scale
                mix = w / w.sum() if np.isfinite(w).all() and abs(w.sum()) > 0 else mix
            gap = math.sqrt(max(0.0, mix @ gram @ mix) / row_[-1])
            total = float(mix @ sums[1:])
            was, leading = leading, (leading * total - n + (1 - damping) * float(mix @ sums[:-1])) / float(mix @ sums[:-1])
            # the mix of the products, one step on, scaled to an even part of 1
            weights = mix * (n / (1 - damping) / total)
            mixed = lambda r, weights=weights: weights @ np.frombuffer(r["made"]).reshape(-1, r["n"])[1:]
            vector = made.mapInArrow(_by_row(lambda r, mixed=mixed: row(r, mixed(r).tobytes())), _VECTOR)
            if gap < tolerance and abs(was - leading) < tolerance:
                break
        else:
            raise RuntimeError(f"the vector still changes after {most_rounds} rounds")
        spread = lambda r: {"block": pa.array(np.full(r["n"], r["block"], np.int32)), "at": pa.array(np.arange(r["n"], dtype=np.int32)), "value": pa.array(np.frombuffer(r["made"]))}
        value = scratch.keep(vector.mapInArrow(_by_row(spread), "block int, at int, value double"))
        length = value.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0]
        return cut(placed.join(value, ["block", "at"]).select("state", (F.col("value") / length).alias("value")))


def segment_flows(vector: DataFrame, known_flow: float, known_state: int, pairs: DataFrame) -> DataFrame:
    """pairs (polygon_id, a, b) with flow: the mean of both ends after scaling the vector to the known state's count."""
    known = vector.filter(F.col("state") == known_state).agg(F.max("value").alias("_k"))
    scaled = vector.crossJoin(F.broadcast(known)).select("state", (F.col("value") / F.col("_k") * known_flow).alias("v"))
    end = lambda c: scaled.select(F.col("state").alias(c), F.col("v").alias(f"_{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("polygon_id", "a", "b", ((F.col("_a") + F.col("_b")) / 2).alias("flow"))
