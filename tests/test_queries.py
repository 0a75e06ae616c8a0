"""Every named core query on the smallest data set, against its SQL."""

import glob
import heapq
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.plans import core_problems, graph_queries, store_queries

CORE = {**graph_queries.QUERIES, **store_queries.QUERIES, **core_problems.QUERIES}
SQL = {**graph_queries.ORACLES, **store_queries.ORACLES, **core_problems.ORACLES}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(x):
        if x is None or x != x:
            return ""
        return f"{x + 0.0:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, duck, name):
    df = CORE[name](spark, data)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    want = duck.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert plain(tuple(r[c] for c in cols) for r in got) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "target", "weight"]
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def parts(duck):
    """Weight of each edge between parts, over all time."""
    rows = duck.execute(graph_queries.PARTS + "SELECT source, target, weight FROM g").fetchall()
    return {(s, t): w for s, t, w in rows}


def test_components_of_parts(spark, data, parts):
    low = {n: n for p in parts for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in parts:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    number = {m: i for i, m in enumerate(sorted(set(low.values())))}
    got = {r["node"]: r["component"] for r in CORE["connected_components"](spark, data).collect()}
    assert got == {n: number[m] for n, m in low.items()}


def test_distances_of_parts(spark, data, parts):
    near = {}
    for (a, b), w in parts.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    root = min(a for a, _ in parts)
    want, heap = {}, [(0.0, root)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in want:
            want[n] = d
            for m, w in near[n]:
                heapq.heappush(heap, (d + w, m))
    got = {r["node"]: r["weight"] for r in CORE["distance_weight"](spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-5 for n in want)
