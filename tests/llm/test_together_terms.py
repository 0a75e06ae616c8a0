import random
from collections import Counter
from itertools import combinations

import pytest

from loomspan.llm import terms, together

SCHEMA = "a bigint, s int, item string, k0 string, n bigint, sign int"


def brute(data):
    by = {}
    for a, s, i, *_ in data:
        if None not in (a, s, i):
            by.setdefault((a, s), set()).add(i)
    pairs = Counter(p for v in by.values() for p in combinations(sorted(v), 2))
    items = Counter(i for v in by.values() for i in v)
    return pairs, items, len(by)


def check(t, data):
    pairs, items, n = brute(data)
    assert {(r["a"], r["b"]): r["c"] for r in t.pairs().collect()} == dict(pairs)
    assert {r["item"]: r["n"] for r in t.items().collect()} == dict(items) and t.n == n
    for r in t.scores().collect():
        assert abs(r["lift"] - r["c"] * n / (items[r["a"]] * items[r["b"]])) < 1e-9


def data_of(seed, n=200):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(15)]), rng.randrange(3), rng.choice([None, "é", "z", "Z", "", *"abcd"]), "x", 1, 1) for _ in range(n)]


def test_together(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    one = data_of(1)
    df = spark.createDataFrame(one, SCHEMA)
    t = together.together(df, ["a", "s"], "item", folder)
    check(t, one)
    # Baskets change, vanish and arrive.
    two = [r for r in one if r[0] != 3] + [(3, 0, "new", "x", 1, 1), (3, 0, "a", "x", 1, 1), (99, 1, "b", "x", 1, 1), (99, 1, "c", "x", 1, 1)]
    old = together.baskets(df.where("a = 3"), ["a", "s"], "item")
    new = together.baskets(spark.createDataFrame([r for r in two if r[0] in (3, 99)], SCHEMA), ["a", "s"], "item")
    t.apply(old, new)
    check(t, two)
    again = together.PairTable(spark, folder)  # as another run finds it
    check(again, two)
    again.apply(together.baskets(spark.createDataFrame(two, SCHEMA), ["a", "s"], "item"), None)
    assert again.n == 0 and again.pairs().count() == 0 and again.items().count() == 0


@pytest.mark.parametrize("least,lift", [(3, 0.0), (1, 4.0), (3, 4.0)])
def test_only_pairs_that_can_count(spark, tmp_path, least, lift):
    folder = f"file://{tmp_path}/t"

    def check_those(t, data):
        pairs, items, n = brute(data)
        good = lambda c, a, b: c >= least and c * n >= lift * items[a] * items[b]
        got = {(r["a"], r["b"]): r["c"] for r in t.scores(least).collect() if good(r["c"], r["a"], r["b"])}
        assert got == {p: c for p, c in pairs.items() if good(c, *p)}

    one = data_of(11, 120)
    t = together.together(spark.createDataFrame(one, SCHEMA), ["a", "s"], "item", folder, least, lift)
    check_those(t, one)
    rng = random.Random(12)
    now = one
    for step in range(3):  # items become eligible, or cease to be
        gone = {rng.randrange(15) for _ in range(4)}
        added = [(50 + step, s, i, "x", 1, 1) for s in range(3) for i in rng.sample(["a", "b", "q", "w", "z"], 3)]
        then = [r for r in now if r[0] not in gone] + added
        old = together.baskets(spark.createDataFrame([r for r in now if r[0] in gone] or now[:0], SCHEMA), ["a", "s"], "item")
        new = together.baskets(spark.createDataFrame(added, SCHEMA), ["a", "s"], "item")
        t = together.PairTable(spark, folder)
        t.apply(old, new, together.baskets(spark.createDataFrame(then, SCHEMA), ["a", "s"], "item"))
        check_those(t, then)
        now = then


def test_torn_commit_growth_and_large_baskets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(together, "PART", 3)
    monkeypatch.setattr(together, "ROWS", 10)
    monkeypatch.setattr(together, "LEAST_BUCKETS", 2)
    one = data_of(21)
    one += [(200, 0, f"i{k}", "x", 1, 1) for k in range(12)]  # a basket of several parts
    t = together.together(spark.createDataFrame(one, SCHEMA), ["a", "s"], "item", f"file://{tmp_path}/t")
    check(t, one)
    assert t.state["buckets"]["pairs"] >= 8
    (tmp_path / "t/commits/000000000001.json").write_text("")  # a driver died here
    again = together.PairTable(spark, f"file://{tmp_path}/t")
    check(again, one)
    more = [(300, 0, f"i{k}", "x", 1, 1) for k in range(30)]
    again.apply(None, together.baskets(spark.createDataFrame(more, SCHEMA), ["a", "s"], "item"))
    check(again, one + more)
    assert again.state["buckets"]["pairs"] > t.state["buckets"]["pairs"]
    # Only buckets of pairs whose counts, or whose items' counts, changed are written.
    before = dict(again.state["places"]["pairs"])
    again.apply(None, together.baskets(spark.createDataFrame([(301, 0, "i0", "x", 1, 1)], SCHEMA), ["a", "s"], "item"))
    check(again, [*one, *more, (301, 0, "i0", "x", 1, 1)])
    assert 0 < sum(before[b] == p for b, p in again.state["places"]["pairs"].items()) < len(before)


def test_eligible_items_need_all_baskets(spark):
    df = spark.createDataFrame([(1, 1, "a", "", 1, 1), (1, 1, "b", "", 1, 1)], SCHEMA)
    t = together.together(df, ["a", "s"], "item", least=2)
    assert t.pairs().count() == 0
    with pytest.raises(ValueError):
        t.apply(None, together.baskets(df.replace(1, 2, ["a"]), ["a", "s"], "item"))


def test_no_baskets(spark):
    t = together.together(spark.createDataFrame([], SCHEMA), ["a", "s"], "item")
    assert t.scores().count() == 0 and t.n == 0


def test_terms(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, *range(30)]), rng.choice([None, "", "hot", "hot", "hot", *[f"w{i}" for i in range(400)]]), rng.choice([None, "A", "B"]), "x") for _ in range(1500)]
    data += data[:50] + [(1, "y" * 2000, "A", "x")]
    df = spark.createDataFrame(data, "rec bigint, w string, t string, id string")
    got = {(r["field_name"], r["field_value"]): (r["n_rows"], r["n_records"], r["mark"]) for r in terms.term_frequencies(df, ["w", "t"], "rec").collect()}
    total = len({r[0] for r in data} - {None})
    want = {}
    for f, k in (("w", 1), ("t", 2)):
        for v in {r[k] for r in data} - {None}:
            own = [r[0] for r in data if r[k] == v]
            d = len(set(own) - {None})
            want[f, v] = (len(own), d, "rare" if d < 3 else "common" if d > 0.1 * total else None)
    assert got == want
    d = terms.dictionary(df, ["w", "t"])
    assert sorted(r["id"] for r in d.collect()) == list(range(len(want)))
    assert terms.term_frequencies(df.limit(0), ["w"], "rec").count() == 0


def test_blocks_that_overflow(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(terms, "HELD", 2)
    rng = random.Random(3)
    ids = [rng.randrange(3000) for _ in range(2000)]
    parts = list(terms._accumulate(iter([pd.DataFrame({"id": ids[i : i + 100], "rows": 2, "records": 1}) for i in range(0, 2000, 100)])))
    assert len(parts) > 1
    whole = pd.concat(parts).sort_values("block")
    out = pd.concat(list(terms._sum_ranges(iter([whole[:7], whole[7:]]))))
    assert dict(zip(out.id, out.n_records)) == dict(Counter(ids)) and (out.n_rows == 2 * out.n_records).all()
