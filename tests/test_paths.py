"""Least costs, hops and steady vectors against plain versions, over shared arcs and by joins."""

import heapq
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridefield.operators import graph
from stridefield.operators.lineage import Scratch, checkpoint_dir

ARCS = "src long, dst long, weight double"


def plainly(arcs, source):
    near = {}
    for a, b, w in arcs:
        near.setdefault(a, []).append((b, w))
    cost, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > cost[at]:
            continue
        for to, w in near.get(at, []):
            if d + w < cost.get(to, float("inf")):
                cost[to] = d + w
                heapq.heappush(heap, (d + w, to))
    return cost


def random_arcs(n, m, seed, least=0):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), float(r.randint(least, 9))) for _ in range(m)]


@pytest.mark.parametrize("shared", [graph.SHARED_ARCS, 0])
def test_costs_and_paths(spark, shared):
    """Weights of 0, double arcs, loops, unreachable and unknown ends, repeated and null requests."""
    arcs = random_arcs(40, 110, 4) + [(1, 1, 0.0), (50, 51, 2.0)]
    asked = [(i, i % 40, i * 7 % 40) for i in range(60)] + [(100, 50, 51), (101, 51, 50), (102, 99, 99), (103, 99, 1), (104, 1, 99), (105, None, 1), (106, 1, None), (107, 3, 3), (108, 3, 3)]
    df = spark.createDataFrame(arcs, ARCS)
    got = graph.shortest_paths(df, spark.createDataFrame(asked, "request_id long, source long, target long"), shared).collect()
    assert len(got) == len(asked)
    cheapest = {}
    for a, b, w in arcs:
        cheapest[a, b] = min(w, cheapest.get((a, b), w))
    for r in got:
        want = plainly(arcs, r.source).get(r.target) if None not in (r.source, r.target) else None
        assert r.cost == want, r
        if want is None:
            assert r.path is None
        else:
            assert r.path[0] == r.source and r.path[-1] == r.target
            assert sum(cheapest[p] for p in zip(r.path, r.path[1:], strict=False)) == want
    empty = graph.shortest_paths(df.limit(0), spark.createDataFrame([(1, 2, 3), (2, 2, 2)], "request_id long, source long, target long"), shared)
    assert sorted((r.request_id, r.cost) for r in empty.collect() if r.cost is not None) == [(2, 0.0)]


def test_trees_of_both_ways_and_of_names(spark):
    arcs = random_arcs(60, 150, 9, 1)
    df, starts = spark.createDataFrame(arcs, ARCS), spark.createDataFrame([(0,), (7,), (7,)], "source long")
    want = {(s, n): c for s in (0, 7) for n, c in plainly(arcs, s).items()}
    for shared in (graph.SHARED_ARCS, 0):
        got = graph.path_tree(df, starts, shared_arcs=shared).collect()
        assert {(r.source, r.node): r.cost for r in got} == want and len(got) == len(want)
    named = df.select(*[F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")], "weight")
    got = graph.path_tree(named, spark.createDataFrame([("n7",)], "source string")).collect()
    assert {int(r.node[1:]): r.cost for r in got} == plainly(arcs, 7)


def test_settled_rows_are_written_once(spark, monkeypatch):
    """The table of settled nodes is appended to: each key stands in it once and its files never change; a source ends with its target."""
    side = 14
    arcs = [(i, j, 1.0) for i in range(side * side) for j in ((i + 1) if i % side < side - 1 else None, (i + side) if i < side * (side - 1) else None) if j is not None]
    arcs += [(b, a, w) for a, b, w in arcs]
    seen, added = {}, []

    class Watched(Scratch):
        def keep(self, df):
            out = super().keep(df)
            for at, _, names in os.walk(self.folder.removeprefix("file:")):
                for f in names:
                    if "/closed/" in f"{at}/" and f.endswith(".parquet"):
                        path = f"{at}/{f}"
                        state = os.stat(path).st_mtime_ns, os.stat(path).st_size
                        assert seen.setdefault(path, state) == state
            return out

        def remove(self, n=None):
            if n is None:
                added.append({p for p in seen if os.path.exists(p)} == set(seen))
            super().remove(n)

    monkeypatch.setattr(graph, "Scratch", Watched)
    asked = spark.createDataFrame([(1, 0, side * side - 1), (2, 0, 5), (3, 100, 101)], "request_id long, source long, target long")
    got = {r.request_id: (r.cost, len(r.path)) for r in graph.shortest_paths(spark.createDataFrame(arcs, ARCS), asked, 0).collect()}
    assert got == {1: (26.0, 27), 2: (5.0, 6), 3: (1.0, 2)}
    assert len(seen) > 3 and added == [True]
    with Scratch(spark) as scratch:
        links = scratch.keep(spark.createDataFrame(arcs, "node long, dst long, weight double"))
        waiting = spark.createDataFrame([(0, side * side - 1), (100, 101)], "source long, target long")
        closed = graph._banded_search(links, waiting.select("source"), waiting, 4.0, scratch, 1000)
        assert closed.count() == closed.select("source", "node").distinct().count()
        # the second source stops with its first band
        assert closed.filter("source = 0").count() == side * side and closed.filter("source = 100").agg(F.max("cost")).first()[0] < 4


def test_hub_labels_answer_every_pair(spark):
    """A lattice with gaps and a part of its own: all pairs, from one table of labels that is far from all pairs; unknown ends."""
    r = random.Random(5)
    side = 6
    one = [(i, j, float(r.randint(1, 9))) for i in range(side * side) for j in (i + 1, i + side) if j < side * side and (j != i + 1 or j % side) and r.random() < 0.85]
    one += [(100, 101, 2.0), (101, 102, 0.0)]
    arcs = one + [(b, a, w) for a, b, w in one]
    cheapest = {}
    for a, b, w in arcs:
        cheapest[a, b] = min(w, cheapest.get((a, b), w))
    labels = graph.hub_labels(spark.createDataFrame(arcs, ARCS))
    nodes = sorted({a for a, _, _ in arcs})
    assert len(nodes) < labels.count() < len(nodes) ** 2 / 2
    asked = [(a, b) for a in nodes for b in nodes] + [(999, 999), (999, 0), (0, 999)]
    requests = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(asked)], "request_id long, source long, target long")
    got = graph.labelled_paths(labels, requests).collect()
    assert len(got) == len(asked)
    costs = {a: plainly(arcs, a) for a in [*nodes, 999]}
    for x in got:
        want = costs[x.source].get(x.target)
        assert x.cost == want
        if want is not None:
            assert x.path[0] == x.source and x.path[-1] == x.target and sum(cheapest[p] for p in zip(x.path, x.path[1:], strict=False)) == want


def test_hops_deep_and_wide(spark):
    path = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    hops = {r.node: r.hops for r in graph.hop_distance(path, 0).collect()}
    assert hops == {i: i for i in range(2001)}
    arcs = [(a, b) for a, b, _ in random_arcs(50, 60, 2)]
    df = spark.createDataFrame(arcs, "src long, dst long")
    want = {n: int(c) for n, c in plainly([(a, b, 1.0) for a, b in arcs] + [(b, a, 1.0) for a, b in arcs], arcs[0][0]).items()}
    for shared in (graph.SHARED_ARCS, 0):
        assert {r.node: r.hops for r in graph.hop_distance(df, arcs[0][0], shared).collect()} == want
    assert graph.hop_distance(df, 999).count() == 0


def test_plans_do_not_grow_with_depth(spark, monkeypatch):
    sizes = []
    real = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: (sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())), real(self, df))[1])
    graph.hop_distance(spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), 0, 0).count()
    assert max(sizes[40:]) < 1.2 * max(sizes[:40])


@pytest.mark.parametrize("lost", [False, True])
def test_steady_state_against_numpy(spark, lost, monkeypatch):
    """Full and lossy columns; few jobs."""
    r = np.random.default_rng(3)
    n = 60
    m = np.where(r.random((n, n)) < 0.08, r.random((n, n)), 0.0)
    m[(np.arange(n) + 1) % n, np.arange(n)] += 0.3
    m /= m.sum(0)
    if lost:
        m[:, ::7] *= 0.4
    dst, src = np.nonzero(m)
    rows = spark.createDataFrame([(int(a), int(b), float(m[b, a])) for a, b in zip(src, dst, strict=True)], "src long, dst long, share double")
    value, vectors = np.linalg.eig(0.9 * m + 0.1 / n)
    want = np.abs(np.real(vectors[:, np.argmax(np.abs(value))]))
    tables = []
    real = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: (tables.append(1), real(self, df))[1])
    got = {x.state: x.value for x in graph.steady_state(rows).collect()}
    assert max(abs(got[i] - want[i] / np.linalg.norm(want)) for i in range(n)) < 1e-10
    assert 2 * len(tables) < 30  # a job that writes and one that sums, a round


def test_nothing_stays_behind(spark):
    before = {p for p in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if p.startswith("scratch-")}
    graph.shortest_paths(spark.createDataFrame([(1, 2, 1.0)], ARCS), spark.createDataFrame([(1, 1, 2)], "request_id long, source long, target long"), 0).count()
    assert {p for p in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if p.startswith("scratch-")} == before


def test_components_in_groups_match_one_search(spark):
    """Three components of a random network, one too large for a task: all three ways give the costs of the whole network's search, with ways that add up."""
    rng = random.Random(11)
    arcs = []
    for base, nodes, n in ((0, 40, 150), (1000, 40, 150), (2000, 120, 900)):
        arcs += [(base + rng.randrange(nodes), base + rng.randrange(nodes), float(rng.randrange(0, 20))) for _ in range(n)]
    arcs = list({(a, b): (a, b, w) for a, b, w in arcs}.values())
    ends = lambda: rng.choice((0, 1000, 2000)) + rng.randrange(45)
    asked = [(k, ends(), ends()) for k in range(300)] + [(300 + k, rng.randrange(40), 7) for k in range(40)] + [(340, 5, 5), (341, 77777, 77777), (342, None, 3)]
    df, requests = spark.createDataFrame(arcs, "src long, dst long, weight double"), spark.createDataFrame(asked, "request_id long, source long, target long")
    weight = {(a, b): w for a, b, w in arcs}
    whole = {r.request_id: r for r in graph.shortest_paths(df, requests).collect()}
    assert len(whole) == len(asked)
    for shared in (100, 0):
        got = {r.request_id: r for r in graph.shortest_paths(df, requests, shared_arcs=shared).collect()}
        assert {k: r.cost for k, r in got.items()} == {k: r.cost for k, r in whole.items()}
        for r in got.values():
            if r.cost is not None:
                assert r.path[0] == r.source and r.path[-1] == r.target and sum(weight[p] for p in zip(r.path, r.path[1:])) == r.cost


@pytest.mark.parametrize(("shared", "both"), [(200, False), (200, True), (100, True)])
def test_large_component_needs_no_search_by_joins(spark, monkeypatch, shared, both):
    """A component beyond a group's size is packed and read by each task; ends of one node, few or many, meet its search; one way only, or both ways alike."""
    monkeypatch.setattr(graph, "_banded_search", None)
    monkeypatch.setattr(graph, "PACKED_ARCS", 64, raising=False)
    rng = random.Random(3)
    arcs = {(b + rng.randrange(n), b + rng.randrange(n)): float(rng.randrange(30)) for b, n, m in ((-5, 130, 500 if both else 950), (3_000_000_000, 30, 60)) for _ in range(m)}
    arcs |= {(b, a): w for (a, b), w in arcs.items()} if both else {}
    arcs = [(a, b, w) for (a, b), w in ({k: min(w, arcs.get(k[::-1], w)) for k, w in arcs.items()} if both else arcs).items()]
    end = lambda: rng.choice((-5, -5, 3_000_000_000)) + rng.randrange(33)
    asked = [(k, end(), end()) for k in range(120)] + [(200 + k, 7, k) for k in range(130)] + [(400 + k, k, 9) for k in range(130)] + [(600 + k, 11, k) for k in range(3)]
    asked += [(700, 5, 5), (701, 77777, 77777), (702, 77777, 3), (703, 3, 77777), (704, None, 3)]
    got = graph.shortest_paths(spark.createDataFrame(arcs, ARCS), spark.createDataFrame(asked, "request_id long, source long, target long"), shared_arcs=shared).collect()
    assert sorted(r.request_id for r in got) == sorted(k for k, *_ in asked)
    weight, near = {(a, b): w for a, b, w in arcs}, {}
    for r in got:
        if r.source is None:
            assert r.cost is None and r.path is None
            continue
        if r.source not in near:
            near[r.source] = plainly(arcs, r.source)
        assert r.cost == near[r.source].get(r.target), r
        if r.cost is not None:
            assert r.path[0] == r.source and r.path[-1] == r.target and sum(weight[p] for p in zip(r.path, r.path[1:])) == r.cost


@pytest.mark.parametrize("both", [False, True])
def test_arcs_are_packed_where_they_are_computed(spark, monkeypatch, both):
    """No table of single arcs is written, packing shuffles nothing, and what is read back is every arc that leads somewhere, at any width of numbers."""
    monkeypatch.setattr(graph, "PACKED_ARCS", 16, raising=False)
    tables, real = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: (tables.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), real(self, df))[1])
    arcs = [(a, b, w) for a, b, w in random_arcs(30, 120, 8) if a < b] + [(7, 7, 1.0), (5 << 40, -(5 << 40), 0.0)]
    arcs += [(b, a, w) for a, b, w in arcs if a != b] if both else []
    df = spark.createDataFrame([*arcs, (1, None, 1.0), (None, 1, 1.0), (1, 2, None)], ARCS)
    asked = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in range(0, 30, 9) for b in range(31))] + [(900, -(5 << 40), 5 << 40)]
    got = graph.shortest_paths(df, spark.createDataFrame(asked, "request_id long, source long, target long"), shared_arcs=40).collect()
    assert {r.request_id: r.cost for r in got} == {k: plainly(arcs, a).get(b) for k, a, b in asked}
    assert not [columns for columns, _ in tables if "weight" in columns]
    assert [" Exchange " in plan or "Exchange range" in plan for columns, plan in tables if "weights" in columns] == [False]
    packed, n, _, told = graph._packed(df, Scratch(spark))
    assert (n, told) == (len(arcs), both)
    back = graph._unpacked(packed, "bigint", "bigint")
    assert sorted(map(tuple, back.collect())) == sorted(arcs)


def test_components_of_a_network_beyond_a_task(spark, monkeypatch):
    """A network that no task reads whole: a small component goes to a group and a large one is packed, both from the packed arcs."""
    monkeypatch.setattr(graph, "_banded_search", None)
    for name, x in (("NET_SHARE", 0), ("PACKED_ARCS", 64)):
        monkeypatch.setattr(graph, name, x, raising=False)
    used = []
    for name in ("_grouped_search", "_packed_search"):
        monkeypatch.setattr(graph, name, lambda *a, real=getattr(graph, name), name=name: (used.append(name), real(*a))[1])
    arcs = random_arcs(40, 150, 12) + [(a + 1000, b + 1000, w) for a, b, w in random_arcs(90, 700, 13)]
    asked = [(k, base + k % 40, base + k * 7 % 90) for k, base in enumerate([0, 1000] * 60)] + [(500, 3, 1003), (501, 88888, 88888)]
    got = graph.shortest_paths(spark.createDataFrame(arcs, ARCS), spark.createDataFrame(asked, "request_id long, source long, target long"), shared_arcs=100).collect()
    assert {r.request_id: r.cost for r in got} == {k: plainly(arcs, a).get(b) for k, a, b in asked}
    assert used == ["_grouped_search", "_packed_search"]


@pytest.mark.parametrize("many", [0, 10**9])
def test_ends_of_one_hub_share_its_search(monkeypatch, many):
    """One network serves hub after hub, ahead and back: the sides are made once, cleared between ends, and ends in another component begin no search."""
    monkeypatch.setattr(graph, "FEW_ENDS", 10**9 if not many else -1, raising=False)
    monkeypatch.setattr(graph, "MANY_ENDS", 10**9, raising=False)
    arcs = random_arcs(60, 200, 6) + [(a + 100, b + 100, w) for a, b, w in random_arcs(9, 20, 7)]
    src, dst, weight = (np.array(c) for c in zip(*arcs, strict=True))
    net = graph._Net(src, dst, weight)
    assert len(np.unique(net.part)) == len({min(plainly(arcs + [(b, a, w) for a, b, w in arcs], int(n))) for n in net.ids})
    for hub in range(0, len(net.ids), 7):
        for back in (False, True):
            want = plainly([(b, a, w) for a, b, w in arcs] if back else arcs, int(net.ids[hub]))
            found = {int(net.ids[end]): (cost, way) for end, cost, way in graph._ways(net, hub, back, np.arange(len(net.ids)), 2.0)}
            assert {k: cost for k, (cost, _) in found.items()} == want
            assert all((way[0], way[-1]) == ((k, net.ids[hub]) if back else (net.ids[hub], k)) for k, (_, way) in found.items())
    if not many:
        sides = net.sides()
        assert net.sides() is sides


@pytest.mark.parametrize("lost", [False, True])
def test_steady_state_over_blocks(spark, lost, monkeypatch):
    """The vector in several blocks and cells is that of numpy; a state beside the matrix has its even part."""
    for name, x in (("BLOCK_STATES", 16), ("CELL_SHARES", 7)):
        monkeypatch.setattr(graph, name, x, raising=False)
    r = np.random.default_rng(5)
    n = 61
    m = np.zeros((n, n))
    m[:-1, :-1] = np.where(r.random((n - 1, n - 1)) < 0.1, r.random((n - 1, n - 1)), 0.0)
    m[(np.arange(n - 1) + 1) % (n - 1), np.arange(n - 1)] += 0.3
    m[:, :-1] /= m[:, :-1].sum(0)
    if lost:
        m[:, ::7] *= 0.4
    dst, src = np.nonzero(m)
    rows = spark.createDataFrame([(int(a), int(b), float(m[b, a])) for a, b in zip(src, dst, strict=True)], "src long, dst long, share double")
    value, vectors = np.linalg.eig(0.9 * m + 0.1 / n)
    want = np.abs(np.real(vectors[:, np.argmax(np.abs(value))]))
    got = {x.state: x.value for x in graph.steady_state(rows, states=spark.createDataFrame([(n - 1,)], "state long")).collect()}
    assert max(abs(got[i] - want[i] / np.linalg.norm(want)) for i in range(n)) < 1e-10


def test_matrix_of_a_network_that_falls_apart(spark):
    """States that never reach the sink send nothing, and that is no error."""
    arcs = spark.createDataFrame([(0, 1), (1, 2), (7, 8), (8, 9)], "src long, dst long")
    found = {(r.src, r.dst): r.share for r in graph.transition_matrix(arcs, 0, []).collect()}
    assert found == {(0, 1): 1.0, (1, 0): 0.5, (1, 2): 0.5, (2, 1): 1.0}


class Counted(np.ndarray):
    """Counts how many elements are read by their places."""

    def __getitem__(self, at):
        if isinstance(at, np.ndarray):
            self.seen = getattr(self, "seen", 0) + len(at)
        return np.asarray(super().__getitem__(at))


def test_a_search_reads_few_arcs():
    """In a random network with many arcs a node a way between two nodes costs the reading of a small part of the arcs of the nodes that it goes over."""
    r = np.random.default_rng(5)
    n = 6000
    x, y = r.random((2, n))
    src, dst = r.integers(n, size=(2, 22 * n))
    src, dst = np.concatenate((src, dst)), np.concatenate((dst, src))
    arcs = src, dst, np.hypot(x[src] - x[dst], y[src] - y[dst])
    net = graph._Net.of_chunks([arcs], False)
    assert len(net.ids) == n
    plain = graph._Net(*arcs)
    first, ends, weights = net.ahead
    ends = ends.view(Counted)
    net.ahead = net.back = first, ends, weights
    found = 0
    for a, b in r.integers(n, size=(20, 2)).tolist():
        costs, _ = graph._search(a, None, plain.ahead, 0.1)
        for end, cost, way in graph._met_ways(net, a, False, np.array([b]), 0.1):
            assert end == b and abs(cost - costs[b]) < 1e-9 and way[0] == a and way[-1] == b
            steps = np.hypot(x[way[:-1]] - x[way[1:]], y[way[:-1]] - y[way[1:]])
            assert abs(steps.sum() - cost) < 1e-9
            found += 1
    assert found == 20 and ends.seen < 60_000


@pytest.mark.parametrize("kind", ["far apart", "directed", "whole", "spread"])
def test_searches_that_meet(kind):
    """Ways of the two-sided search against a plain one: weights of very different sizes, one-way arcs, weights of 0 and ties, ids that lie far apart."""
    r = np.random.default_rng(11)
    for n, m in ((3, 2), (30, 45), (200, 900)):
        src, dst = r.integers(n, size=(2, m))
        weight = {"far apart": 10.0 ** r.integers(-3, 6, m), "whole": r.integers(0, 4, m).astype(float)}.get(kind, r.random(m))
        if kind == "spread":
            src, dst = src * 10**12, dst * 10**12
        both = kind != "directed"
        net = graph._Net.of_chunks([(src[k::2], dst[k::2], weight[k::2]) for k in range(2)], both)
        a, b, w = (np.concatenate((src, dst)), np.concatenate((dst, src)), np.concatenate((weight, weight))) if both else (src, dst, weight)
        arcs = [(int(i), int(j), float(c)) for i, j, c in zip(net.places(a), net.places(b), w, strict=True)]
        least = {}
        for i, j, c in arcs:
            least[i, j] = min(c, least.get((i, j), c))
        for back in (False, True):
            for hub in r.integers(len(net.ids), size=6).tolist():
                known = plainly([(j, i, c) for i, j, c in arcs] if back else arcs, hub)
                ends = np.unique(r.integers(len(net.ids), size=7))
                got = {end: (cost, way) for end, cost, way in graph._met_ways(net, hub, back, ends, float(weight.mean()) / 4 or 1.0)}
                assert set(got) == {e for e in ends.tolist() if e in known}
                for end, (cost, way) in got.items():
                    assert cost == pytest.approx(known[end], rel=1e-12) and way[0] == hub and way[-1] == end
                    steps = zip(way, way[1:], strict=False)
                    assert sum(least[(j, i) if back else (i, j)] for i, j in steps) == pytest.approx(cost, rel=1e-12)


@pytest.mark.parametrize("both, passes", [(True, 32), (False, 32), (True, 2)])
def test_few_sources_over_arcs_that_pass_by(spark, monkeypatch, both, passes):
    """A network that no task holds is searched from few sources without components or joins in bands; ways of more steps than there are passes are found the other way."""
    if passes > 2:
        for name in ("_banded_search", "connected_components", "_grouped_search", "_packed_search"):
            monkeypatch.setattr(graph, name, None)
    monkeypatch.setattr(graph, "PACKED_ARCS", 16)
    monkeypatch.setattr(graph, "PASSES", passes, raising=False)
    rows = random_arcs(40, 110, 4) + [(1, 1, 0.0), (50, 51, 2.0), (52, 53, 0.0), (54, 55, 1.0)] + [(60 + k, 61 + k, 1.0) for k in reversed(range(4))]
    rows += [(b, a, w) for a, b, w in rows if a != b] if both else []
    ends = list(range(0, 66)) + [99, -5, 10**12]
    asked = [(s * 1000 + k, s, t) for s in (3, 17, 50, 54, 60, 99) for k, t in enumerate(ends)] + [(7, None, 1), (8, 1, None), (9, 3, 3)]
    got = graph.shortest_paths(spark.createDataFrame(rows, ARCS).repartition(5), spark.createDataFrame(asked, "request_id long, source long, target long"), 3).collect()
    assert len(got) == len(asked)
    least = {}
    for a, b, w in rows:
        least[a, b] = min(w, least.get((a, b), w))
    known = {s: plainly(rows, s) for s in (3, 17, 50, 54, 60, 99)}
    for r in got:
        want = known[r.source].get(r.target) if None not in (r.source, r.target) else None
        assert r.cost == want, r
        assert r.path is None if want is None else r.path[0] == r.source and r.path[-1] == r.target and sum(least[p] for p in zip(r.path, r.path[1:], strict=False)) == want
