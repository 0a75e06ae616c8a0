import math
import random

import pytest

from loomspan.operators import graph as g
from loomspan.operators import traversal
from loomspan.temporal import Graph, TemporalGraph, Vector
from tests.helpers import near

R2 = 1 / math.sqrt(2)


def directed(spark, e):
    return Graph.from_dict(spark, e, True)


def undirected(spark, e):
    return Graph.from_dict(spark, e)


# This graph and its distances below.
DAG = {(0, 1): 1.0, (1, 2): 1.0, (2, 3): 1.0, (3, 4): 1.5, (2, 4): 1.5}


def test_power_iteration(spark):
    a = directed(spark, {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.2, (1, 1): 0.8})
    v, e = a.power_iteration(iterations=20)
    assert abs(e - 1) < 1e-6 and near(v.as_dict(), {0: R2, 1: R2})
    v, _ = a.power_iteration(tolerance=1e-3)
    assert near(v.as_dict(), {0: R2, 1: R2}, 1e-3)
    v, e = (a * -1).power_iteration(Vector.from_dict(spark, {0: R2, 1: R2}), iterations=2)
    assert abs(e + 1) < 1e-6 and near(v.as_dict(), {0: R2, 1: R2})
    v, _ = undirected(spark, {(0, 0): 0.0, (1, 1): 1.0}).power_iteration(iterations=3)
    assert v.as_dict() == {0: 0.0, 1: 1.0}
    steps = traversal.power_steps(a.df, 20, directed=True)
    assert near({r["node"]: r["weight"] for r in steps.collect()}, {0: R2, 1: R2})


def test_distances(spark):
    a = directed(spark, DAG)
    assert a.distance(100, 0) == math.inf and a.distance(0, 0) == 0 and a.distance(100, 100) == 0
    assert a.distance(0, 4) == 3 and a.distance(0, 4, weighted=True) == 3.5
    assert a.all_distances(0).as_dict() == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
    assert a.all_distances(0, limit=2).as_dict() == {0: 0, 1: 1, 2: 2}
    assert a.all_distances(100).as_dict() == {100: 0}
    assert a.all_distances(0, weighted=True).as_dict() == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3.5}
    assert a.all_distances(0, weighted=True, limit=2.0).as_dict() == {0: 0, 1: 1, 2: 2}
    want = {(0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): 3.5, (1, 2): 1, (1, 3): 2, (1, 4): 2.5, (2, 3): 1, (2, 4): 1.5, (3, 4): 1.5}
    assert a.distance_graph(weighted=True).as_dict() == want
    for weighted in (False, True):
        p = traversal.visit_order(a.paths(0, weighted), weighted).orderBy("pos").collect()
        assert [(r["weight"], r["count"], r["parent"], r["node"]) for r in p] == [(0, 0, None, 0), (1, 1, 0, 1), (2, 2, 1, 2), (3, 3, 2, 3), (3.5, 3, 2, 4)]


def _floyd(edges, nodes, both):
    d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for (a, b), w in edges.items():
        for x, y in ((a, b), (b, a)) if both else ((a, b),):
            d[x, y] = min(d[x, y], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return {k: v for k, v in d.items() if k[0] != k[1] and v < math.inf}


def test_all_distances_keep_nothing_between_rounds(spark, monkeypatch):
    rng = random.Random(11)
    edges = {(100 * c + i, 100 * c + j): rng.choice([0.0, 0.5, 1.0, rng.random(), 20 * rng.random()]) for c in range(3) for i in range(12) for j in range(i + 1, 12) if rng.random() < (0.2, 0.9, 0.4)[c]}
    edges |= {(400 + i, 401 + i): 1.0 for i in range(30)} | {(500, 500): 1.0}  # a long way; a node without a partner
    nodes = sorted({x for e in edges for x in e})
    a, b = undirected(spark, edges), directed(spark, {(y, x) if (x + y) % 3 else (x, y): w for (x, y), w in edges.items()})
    cases = [(x, weighted, _floyd({k: w if weighted else 1.0 for k, w in x.as_dict().items()}, nodes, not x.directed)) for x, weighted in ((a, True), (b, False))]
    monkeypatch.setattr(traversal, "ROOTS", 7)
    monkeypatch.setattr(traversal, "CELLS", 50)
    monkeypatch.setattr(traversal, "LIGHT", 2)
    with monkeypatch.context() as m:
        m.setattr(traversal, "paths", None)  # no tables of ways by rounds
        for x, weighted, want in cases:
            assert near(x.distance_graph(weighted).as_dict(), want)
    monkeypatch.setattr(traversal, "IN_TASK", 30)  # by components, the dense one by rounds
    assert near(a.distance_graph(True).as_dict(), cases[0][2])
    assert undirected(spark, {(0, 1): math.inf}).distance_graph(True).as_dict() == {(0, 1): math.inf, (1, 0): math.inf}


def test_components(spark):
    c = undirected(spark, {(1, 0): 1, (1, 2): 2, (4, 3): 3, (4, 5): 4}).connected_components()
    assert c.as_dict() == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    with pytest.raises(ValueError):
        directed(spark, DAG).connected_components()
    rng = random.Random(5)
    nodes = list(range(60))
    edges = {(a, b): 1.0 for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(40))} | {(100 + i, 101 + i): 1.0 for i in range(40)}  # and a long chain
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    sets = {}
    for n in list(parent):
        sets.setdefault(find(n), []).append(n)
    order = sorted(sets.values(), key=min)
    assert undirected(spark, edges).connected_components().as_dict() == {n: float(i) for i, s in enumerate(order) for n in s}


def test_degrees_anomalies_normalized(spark):
    # The edges of this graph, and its anomalies.
    e = {(0, 1): 1.0, (1, 1): 2.0, (1, 2): 4.0, (2, 2): 5.0, (1, 3): 7.0, (2, 3): 8.0, (0, 4): 10.0, (1, 4): 11.0, (3, 4): 13.0, (4, 4): 14.0}
    a = undirected(spark, e)
    assert near(a.degree_anomalies().as_dict(), dict(enumerate([-2.5, 1.6, -2 / 3, -1.0, 0.5])))
    assert near(a.weight_anomalies().as_dict(), dict(enumerate([-34.90909194946289, -9.119998931884766, -7.0588226318359375, -5.392856597900391, 18.39583396911621])), 1e-5)
    assert a.clear().degree_anomalies().as_dict() == {}
    b = {(0, 1): 1.0, (0, 2): 0.5, (0, 3): 0.5, (2, 1): 3.0}
    assert near(directed(spark, b).normalized().as_dict(), {(0, 1): 0.125, (0, 2): 0.5, (0, 3): 0.5, (2, 1): 0.25})
    assert near(undirected(spark, b).normalized().as_dict(), {(0, 1): 0.125, (0, 2): 0.0714285714, (0, 3): 0.5, (1, 2): 0.2142857142})
    z = directed(spark, {(0, 1): 0.0, (0, 2): 1.0, (2, 2): 2.0})
    assert z.out_degrees().as_dict() == {0: 2, 2: 1} and z.in_degrees().as_dict() == {1: 1, 2: 2}
    assert z.out_weights().as_dict() == {0: 1.0, 2: 2.0} and z.in_weights().as_dict() == {1: 0.0, 2: 3.0}
    u = undirected(spark, {(1, 1): 2.0, (1, 2): 3.0})
    assert u.nodes().as_dict() == {1: 3, 2: 1} and u.out_weights().as_dict() == {1: 5.0, 2: 3.0} and u.neighbours(2).as_dict() == {1: 3.0} and u.degree(1) == 2


def test_anomalies_of_a_star(spark):
    # A centre of weight 1 + 2 + 3 = 6 and three leaves: leaf k has k less 6 * k / k; the centre 6 less (1 + 4 + 9) / 6.
    star = undirected(spark, {(0, 1): 1.0, (0, 2): 2.0, (0, 3): 3.0})
    assert near(star.weight_anomalies().as_dict(), {0: 6 - 14 / 6, 1: 1 - 6.0, 2: 2 - 6.0, 3: 3 - 6.0})
    assert near(star.degree_anomalies().as_dict(), {0: 3 - 1.0, 1: 1 - 3.0, 2: 1 - 3.0, 3: 1 - 3.0})


def test_filter_top_and_subgraph(spark):
    a = directed(spark, {(0, 1): 1.0, (1, 2): 2.0, (2, 3): 3.0, (3, 4): 4.0, (2, 4): 5.0})
    assert a.within(Vector.from_dict(spark, dict.fromkeys([1, 2, 3], 1.0))).as_dict() == {(1, 2): 2.0, (2, 3): 3.0}
    grid = directed(spark, {(i, j): 100.0 - i for i in range(10) for j in range(10)})
    assert [grid.top_edges(k).num_edges() for k in (0, 1, 10, 11)] == [0, 10, 10, 20]
    assert [grid.top_edges(k, True).num_edges() for k in (0, 1, 11)] == [0, 1, 11]
    t = TemporalGraph.from_graphs(spark, [(100, {(0, 1): 1.0, (0, 2): 0.5, (1, 2): 0.5, (0, 3): 0.25, (1, 3): 0.25})], positive=True)
    h = t.topics(51, 150).sparse_subgraph(num_seeds=1, num_neighbors=1)
    assert near(h.as_dict(), {(0, 1): 1.0, (0, 2): 2 / 3, (1, 2): 2 / 3})


def brute_sparse(edges, num_seeds, num_neighbors):
    e = {k: w for k, w in edges.items() if k[0] != k[1]}
    order = sorted(e, key=lambda k: (-e[k], k))
    if not order:
        return {}
    least = e[order[min(num_seeds, len(order)) - 1]]
    seeds = [k for k in order if e[k] >= least]
    out, used = {k: e[k] for k in seeds}, set()
    w = lambda a, b: e.get((min(a, b), max(a, b)))
    for s in seeds:
        i, j = s
        common = []
        for k in {x for p in e for x in p} - {i, j}:
            sides = [(min(i, k), max(i, k)), (min(j, k), max(j, k))]
            if all(x in e and x not in used for x in sides):
                common.append((-min(w(i, k), w(j, k)), k))
        for _, k in sorted(common)[:num_neighbors]:
            out[min(i, k), max(i, k)] = w(i, k)
            out[min(j, k), max(j, k)] = w(j, k)
        used.add(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_subgraph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    e = {(a, b): float(rng.randrange(1, 9)) for a in range(12) for b in range(a, 12) if rng.random() < 0.5}
    assert undirected(spark, e).sparse_subgraph(num_seeds=4, num_neighbors=2).as_dict() == brute_sparse(e, 4, 2)


def test_algebra(spark):
    a, b = undirected(spark, {(0, 1): 1.0, (2, 1): 2.0}), undirected(spark, {(1, 0): 0.5, (5, 5): 4.0})
    assert (a + b).as_dict() == {(0, 1): 1.5, (1, 2): 2.0, (5, 5): 4.0}
    assert (a - a).as_dict() == {(0, 1): 0.0, (1, 2): 0.0} and (a - a).without_small().as_dict() == {}
    assert a.set({(1, 0): 7.0, (0, 1): 8.0, (9, 9): 1.0}).as_dict() == {(0, 1): 8.0, (1, 2): 2.0, (9, 9): 1.0}
    assert a.add({(1, 0): 1.0}).as_dict()[0, 1] == 2.0 and a.delete([(1, 0), (7, 7)]).as_dict() == {(1, 2): 2.0}
    assert (1, 0) in a and a[1, 0] == 1.0 and a[7, 7] == 0.0 and (7, 7) not in a
    assert (a * 2).sum_weights() == 6.0 and a.num_edges() == 2 and a.clear().empty()
    with pytest.raises(ValueError):
        a + directed(spark, {(0, 1): 1.0})
    p = Graph.from_dict(spark, {(0, 1): -5.0, (0, 2): 0.5, (0, 3): 0.6}, positive=True)
    assert p.without_small(0.5).as_dict() == {(0, 3): 0.6}
    assert undirected(spark, {(0, 1): -5.0, (0, 2): 0.5}).without_small(-0.5).as_dict() == {(0, 1): -5.0}
    v, w = Vector.from_dict(spark, {0: 3.0, 1: 4.0}), Vector.from_dict(spark, {1: 1.0, 2: 2.0})
    assert v.dot(w) == 4.0 and v.norm() == 5.0 and v.sum_weights() == 7.0 and abs(v.distance(w) - math.sqrt(22)) < 1e-9
    assert (v + w).as_dict() == {0: 3, 1: 5, 2: 2} and (v - w).as_dict() == {0: 3, 1: 3, 2: -2} and (v * 2)[1] == 8.0 and 2 not in v and len(v) == 2
    assert v.set({1: 9.0}).add({0: 1.0}).delete([5]).as_dict() == {0: 4.0, 1: 9.0} and v.clear().norm() == 0.0
    m = directed(spark, {(i, j): float(3 * i + j + 1) for i in range(3) for j in range(3)})
    assert m.multiply(Vector.from_dict(spark, {0: 1.0, 1: 2.0, 2: 3.0})).as_dict() == {0: 14, 1: 32, 2: 50}


def test_odd_rows(spark):
    df = spark.createDataFrame([(2, 1, None, "x"), (None, 1, 1.0, "x"), (1, None, 1.0, "x"), (3, 3, 1.0, "x")], "source int, target int, weight float, node string")
    assert sorted(map(tuple, g.canonical(df).collect())) == [(1, 2, 0.0), (3, 3, 1.0)]
    none = g.canonical(df.limit(0))
    for out in (g.nodes(none), g.degrees(none), g.anomalies(none), g.normalized(none), g.top_edges(none, 3), g.sparse_subgraph(none), traversal.components(none)):
        assert out.count() == 0
