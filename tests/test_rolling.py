import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomspan.operators import rolling
from tests.helpers import rows

EDGE = "edge_id bigint, edge_from bigint, edge_to bigint, edge_value double, edge_ts timestamp, loaded_at timestamp, node string, day_no string"
T0 = datetime(2023, 1, 1, tzinfo=timezone.utc)
D0 = 19358


def brute(data, periods, first, last):
    best = {}
    for r in data:
        if r[0] not in best or r[5] > best[r[0]][5]:
            best[r[0]] = r
    daily, nodes = {}, set()
    for _, a, b, v, ts, *_ in best.values():
        if ts is None:
            continue
        day = int(ts.timestamp() // 86400)
        if day > last:
            continue
        for n in {a, b} - {None}:
            nodes.add(n)
            daily[n, day] = daily.get((n, day), 0) + Decimal(str(v or 0))
    return {(n, d): [sum((daily.get((n, x), 0) for x in range(d - p + 1, d + 1)), Decimal(0)) for p in periods] for n in nodes for d in range(first, last + 1)}


def test_against_brute_force(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        ts = T0 + timedelta(hours=rng.randrange(-24 * 40, 24 * 80))
        data.append((rng.randrange(300), rng.choice([1, 1, 1, 2, 3, None]), rng.choice([1, 2, 4, None]), rng.choice([0.1, 0.2, 0.7, -0.3, 0.0, None]), ts, T0 + timedelta(seconds=i), "x", "y"))
    df = spark.createDataFrame(data, EDGE)
    cur = rolling.latest_rows(df, "edge_id", "loaded_at", ["edge_ts", "edge_from", "edge_to", "edge_value"])
    got = rolling.trailing_totals(cur, ["edge_from", "edge_to"], "edge_ts", "edge_value", [7, 30], D0, D0 + 60)
    want = brute(data, [7, 30], D0, D0 + 60)
    found = {(r["node"], r["day_no"]): r for r in got.collect()}
    assert found.keys() == want.keys()
    for k, (a, b) in want.items():
        assert abs(found[k]["total_7"] - float(a)) < 1e-9 and abs(found[k]["avg_30"] - float(b) / 30) < 1e-9
        assert (found[k]["total_7"] == 0) == (a == 0)  # no rest of floating sums


def test_odd_rows(spark):
    data = [
        (None, 1, 2, 1.0, T0, T0, "", ""), (None, 1, 2, 1.0, T0, T0, "", ""),  # without an id: each counts
        (7, 3, 3, 2.0, T0, T0, "", ""),  # a loop is one end
        (8, 4, None, float("nan"), T0, None, "", ""), (9, 5, 6, 1.0, None, T0, "", ""), (10, None, None, 1.0, T0, T0, "", ""),
    ]
    cur = rolling.latest_rows(spark.createDataFrame(data, EDGE), "edge_id", "loaded_at", ["edge_ts", "edge_from", "edge_to", "edge_value"])
    got = rolling.trailing_totals(cur, ["edge_from", "edge_to"], "edge_ts", "edge_value", [7], D0, D0)
    assert rows(got, "node", "total_7") == [(1, 2.0), (2, 2.0), (3, 2.0), (4, 0.0)]


def test_empty(spark):
    cur = rolling.latest_rows(spark.createDataFrame([], EDGE), "edge_id", "loaded_at", ["edge_ts", "edge_from", "edge_to", "edge_value"])
    assert rolling.trailing_totals(cur, ["edge_from", "edge_to"], "edge_ts", "edge_value", [7], D0, D0 + 5).count() == 0


def test_latest_row_ties(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0), (1, None, 9.0)], "k bigint, o bigint, v double")
    assert rows(rolling.latest_rows(df, "k", "o", ["v"])) == [(2.0,)]
    assert rolling.spread(spark.createDataFrame([(1, 3, 5, "a")], "node bigint, run_from int, run_to int, t string")).agg(F.count("*")).first()[0] == 3


def test_large_amounts(spark):
    data = [(1, 1, None, 1e15, T0, T0, "", ""), (2, 1, None, 0.125, T0, T0, "", ""), (3, 1, None, float("inf"), T0, T0, "", ""), (4, 1, None, float("nan"), T0, T0, "", "")]
    df = spark.createDataFrame(data, EDGE)
    got = rows(rolling.trailing_totals(df, ["edge_from", "edge_to"], "edge_ts", "edge_value", [1], D0, D0 + 1), "node", "day_no", "total_1")
    assert got == [(1, D0, 1e15 + 0.125), (1, D0 + 1, 0.0)]
    with pytest.raises(Exception, match="too large"):
        rolling.daily_amounts(spark.createDataFrame([(1, 1, None, 1e300, T0, T0, "", "")], EDGE), ["edge_from"], "edge_ts", "edge_value").collect()
