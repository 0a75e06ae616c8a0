import random

import pytest

from loomspan.operators import metrics as m
from tests.helpers import near, rows

# These snapshots and the metrics of them in test_goldens.
V = [{(0, 0): 1.0, (0, 1): 0.0, (1, 1): 2.0, (2, 2): 2.0}, {(0, 0): 1.0, (0, 1): 1.0, (1, 1): 1.0, (2, 2): 2.0}, {(0, 0): 1.0, (0, 1): 2.0, (1, 1): 0.0, (2, 2): 2.0}]
KEYS = ["source", "target"]


def sampled(spark, values, zeros=True):
    data = [(i, s, t, w) for i, v in enumerate(values) for (s, t), w in v.items() if zeros or w]
    return spark.createDataFrame(data, "step int, source bigint, target bigint, weight double")


def got(df):
    return {(r["source"], r["target"]): r["weight"] for r in df.collect()}


def four(a, b, c, d):
    return {(0, 0): a, (0, 1): b, (1, 1): c, (2, 2): d}


@pytest.mark.parametrize("zeros", [True, False])
def test_goldens(spark, zeros):
    s = sampled(spark, V, zeros)
    assert near(got(m.average(s, KEYS, 3)), four(1, 1, 1, 2)) and near(got(m.deviation(s, KEYS, 3)), four(0, 1, 1, 0)) and near(got(m.trend(s, KEYS, 3)), four(0, 1, -1, 0))
    r = got(m.stability_ratio(s, KEYS, 3))
    assert r[0, 0] == r[2, 2] == float("inf") and abs(r[0, 1] - 1.22474487) < 1e-7
    assert near(got(m.entropy(s, KEYS, 3, 2)), four(0.89587973, 0.74918778, 0.74918778, 0.45580389), 1e-7)
    assert near(got(m.entropy_local(s, KEYS, 3, 2)), four(0.90890873, 0.77809669, 0.77809669, 0.77809669), 1e-7)
    assert near(got(m.entropy_2d(s, KEYS, 3, 2)), four(0.0, 0.25993019, 0.25993019, 0.43152310), 1e-7)
    assert got(m.stability_pareto(s, KEYS, 3)) == four(2, 3, 3, 1) and got(m.stability_pareto(s, KEYS, 3, 0.5)) == four(0.5, 0.25, 0.25, 1.0)


def test_worked_out_values(spark):
    # Weights 1, 3, 5, 7 of a key, and 6 once of another: means 4 and 1.5, sums of squares 20 and 27.
    s = sampled(spark, [{(0, 1): 1.0}, {(0, 1): 3.0, (1, 2): 6.0}, {(0, 1): 5.0}, {(0, 1): 7.0}])
    pair = lambda a, b: {(0, 1): a, (1, 2): b}
    assert near(got(m.average(s, KEYS, 4)), pair(4.0, 1.5)) and near(got(m.deviation(s, KEYS, 4)), pair((20 / 3) ** 0.5, 3.0))
    assert near(got(m.trend(s, KEYS, 4)), pair(2.0, -0.6)) and near(got(m.stability_ratio(s, KEYS, 4)), pair(4 / 5**0.5, 1.5 / 6.75**0.5))
    assert got(m.stability_pareto(s, KEYS, 4)) == pair(1.0, 2.0)


def test_few_steps(spark):
    s = sampled(spark, V[:1])
    with pytest.raises(ValueError):
        m.deviation(s, KEYS, 1)
    assert set(got(m.trend(s, KEYS, 1)).values()) == {0.0}
    same = sampled(spark, [{(0, 0): 3.0}, {(0, 0): 3.0}])
    assert got(m.entropy(same, KEYS, 2)) == {(0, 0): 0.0} and got(m.deviation(same, KEYS, 2)) == {(0, 0): 0.0}


def brute_fronts(points):
    left, out, front = dict(points), {}, 0
    while left:
        front += 1
        on = [k for k, p in left.items() if not any(all(x <= y for x, y in zip(q, p)) and q != p for q in left.values())]
        for k in on:
            out[k] = float(front)
            del left[k]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pareto(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(m, "CELL", [10**6, 7, 2][seed])
    pts = {i: (float(rng.randrange(8)), float(rng.randrange(8))) for i in range(60)}
    df = spark.createDataFrame([(k, *p, "x") for k, p in pts.items()], "node bigint, a double, b double, front string")
    assert {r["node"]: r["weight"] for r in m.pareto(df, ["node"], "a", "b", False, False).collect()} == brute_fronts(pts)
    flipped = {k: (-a, b) for k, (a, b) in pts.items()}
    assert {r["node"]: r["weight"] for r in m.pareto(df, ["node"], "a", "b", True, False, 0.5).collect()} == {k: 0.5 ** (v - 1) for k, v in brute_fronts(flipped).items()}
    assert {r["node"]: r["weight"] for r in m.pareto_many(df, ["node"], {"a": False, "b": False}, block=7).collect()} == brute_fronts(pts)


def test_pareto_three_values_and_empty(spark):
    rng = random.Random(9)
    pts = {i: tuple(float(rng.randrange(4)) for _ in range(3)) for i in range(40)}
    df = spark.createDataFrame([(k, *p) for k, p in pts.items()], "node bigint, a double, b double, c double")
    assert {r["node"]: r["weight"] for r in m.pareto_many(df, ["node"], {"a": False, "b": False, "c": False}).collect()} == brute_fronts(pts)
    assert rows(m.pareto(df.limit(0), ["node"], "a", "b")) == [] and rows(m.pareto_many(df.limit(0), ["node"], {"a": True})) == []


def test_rows_behind_the_first_fronts_are_left_out_where_they_are_read(spark):
    rng = random.Random(12)
    pts = {i: (float(rng.randrange(300)), float(rng.randrange(300))) for i in range(3000)} | {3000: (float("inf"), 5.0), 3001: (7.0, None)}
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()], "node bigint, a double, b double").repartition(3)
    few = m.in_first_fronts(df, "a", "b", True, False, 4).collect()
    full = brute_fronts({k: (-a, b) for k, (a, b) in pts.items() if b is not None})
    assert {k for k, f in full.items() if f <= 4} <= {r["node"] for r in few} and len(few) < 1000
    assert {k: f for k, f in brute_fronts({r["node"]: (-r["a"], r["b"]) for r in few}).items() if f <= 4} == {k: f for k, f in full.items() if f <= 4}
