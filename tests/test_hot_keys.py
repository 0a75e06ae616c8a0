import math
import random

import pytest

from loomspan.operators import hot_keys
from tests.helpers import rows

SCHEMA = "k string, v double, n_rows string, bin string"


def test_totals_and_heavy_keys(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 5 + [f"k{i}" for i in range(20)] + [None]), rng.choice([1.5, None, float("nan")]), "x", "y") for _ in range(2000)]
    df = spark.createDataFrame(data, SCHEMA)
    want = {}
    for k, v, *_ in data:
        if k is not None:
            n, m, t = want.get(k, (0, 0, 0.0))
            ok = v is not None and not math.isnan(v)
            want[k] = (n + 1, m + ok, t + (v if ok else 0))
    got = {r["key_text"]: (r["n_rows"], r["n_values"], r["total"]) for r in hot_keys.key_totals(df, "k", "v").collect()}
    assert got == want
    for share in (0.01, 0.04, 0.2, 1.0):
        heavy = {r["key_text"]: r["n_rows"] for r in hot_keys.heavy_keys(df, "k", share, bits=3).collect()}
        assert heavy == {k: n for k, (n, *_) in want.items() if n >= share * len(data)}
    even = spark.createDataFrame([("a" if i < 7 else f"k{i}", 1.0, "", "") for i in range(100)], SCHEMA)
    assert rows(hot_keys.heavy_keys(even, "k", 0.07)) == [("a", 7)]
    with pytest.raises(ValueError):
        hot_keys.heavy_keys(df, "k", 0)


@pytest.mark.parametrize("hot_rows,bins", [(10_000, 1024), (50, 4), (0, 2)])
def test_quantiles(spark, hot_rows, bins):
    rng = random.Random(3)
    data = [(rng.choice(["a"] * 6 + ["b", "c", "d", None]), rng.choice([rng.gauss(0, 1), rng.randrange(3) * 1.0, 1e300, -1e-300, None, float("nan")]), "", "") for _ in range(1500)]
    data += [("e", 5.0, "", "")] * 3 + [("f", None, "", ""), ("g", float("inf"), "", "")] + [("a", x, "", "") for x in (math.inf, -math.inf, -math.inf)]
    df = spark.createDataFrame(data, SCHEMA)
    probs = [0.0, 0.5, 0.9, 1.0]
    by = {}
    for k, v, *_ in data:
        if k is not None and v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    want = {(k, p): sorted(x)[max(1, math.ceil(p * len(x))) - 1] for k, x in by.items() for p in probs}
    got = {(r["key_text"], r["prob"]): r["quantile"] for r in hot_keys.key_quantiles(df, "k", "v", probs, hot_rows, bins).collect()}
    assert got == want


def test_large_amounts(spark):
    df = spark.createDataFrame([("a", 1e15, "", ""), ("a", 0.25, "", ""), ("b", 1e300, "", ""), ("c", -math.inf, "", "")], SCHEMA)
    assert {r["key_text"]: r["total"] for r in hot_keys.key_totals(df, "k", "v").collect()} == {"a": 1e15 + 0.25, "b": 1e300, "c": -math.inf}


def test_heavy_key_codes(spark):
    # Refined down to single hashes: one bit a round takes as many rounds as tell the keys apart.
    df = spark.createDataFrame([(f"k{i % 7}", 1.0, "", "") for i in range(70)] + [(None, 1.0, "", "")] * 30, SCHEMA)
    want = [(f"k{i}", 10) for i in range(7)]
    assert rows(hot_keys.heavy_keys(df, "k", 0.1, bits=1)) == rows(hot_keys.heavy_keys(df, "k", 0.1)) == want and rows(hot_keys.heavy_keys(df, "k", 0.11)) == []


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(hot_keys.key_totals(df, "k", "v")) == [] and rows(hot_keys.heavy_keys(df, "k", 0.1)) == [] and rows(hot_keys.key_quantiles(df, "k", "v", [0.5])) == []
