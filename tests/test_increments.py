import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import increments as inc
from tests.helpers import rows


def nums(spark, xs):
    return spark.createDataFrame([(x, f"p{x}") for x in xs], "seq bigint, block string")


def test_intervals_merge_subtract(spark):
    rng = random.Random(4)
    b = inc.BLOCK
    pool = [*range(-5, 30), *range(b - 6, b + 6), *range(3 * b - 3, 3 * b + 3)]
    xs, ys = [rng.choice(pool) for _ in range(40)], [rng.choice(pool) for _ in range(40)]
    a, c = inc.intervals(nums(spark, [*xs, None])), inc.intervals(nums(spark, ys))
    cover = lambda df: [x for r in df.collect() for x in range(r["lo"], r["hi"] + 1)]
    assert sorted(cover(a)) == sorted(set(xs))
    m = inc.merge(a, c)
    assert sorted(cover(m)) == sorted({*xs, *ys})
    lohi = sorted((r["block"], r["lo"], r["hi"]) for r in m.collect())
    assert all(q[0] != p[0] or q[1] > p[2] + 1 for p, q in zip(lohi, lohi[1:]))  # disjoint and maximal
    left = inc.subtract(nums(spark, [*pool, *pool, None]), "seq", a)
    assert left.columns == ["seq", "block"]
    assert rows(left) == rows(nums(spark, [x for x in [*pool, *pool] if x not in set(xs)]))
    none = spark.createDataFrame([], "block bigint, lo bigint, hi bigint")
    assert inc.subtract(nums(spark, [1, 2]), "seq", none).count() == 2 and inc.intervals(nums(spark, [])).count() == 0


def test_changed_rows(spark, tmp_path):
    schema = "id bigint, url string, t int, body string, taken string, mark string"
    data = [
        (1, "new", 1, "a"), (2, "same", 1, "a"), (3, "same", 2, "a"), (4, "changed", 1, "a"), (5, "changed", 2, "b"), (6, "back", 1, "a"), (7, "back", 2, "b"), (8, "back", 3, "a"),
        (10, "twice", 2, "b"), (9, "twice", 2, "b"), (11, "nulls", 1, None), (12, "nulls", 2, None), (13, None, 1, "a"), (14, "untimed", None, "a"), (15, "lost", 2, "a"), (16, "to-null", 1, "a"), (17, "to-null", 2, None), (18, "empty", 1, ""), (19, "empty", 2, None),
        (20, "late", 1, "z"), (21, "late", 3, "a"), (22, "gone", 1, "a"), (23, "redelivered", 1, "a"), (24, "redelivered", 1, "b"), (None, "unnumbered", 1, "a"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], schema)
    taken = spark.createDataFrame([("same", 1), ("same", 1), ("changed", 1), ("back", 1), ("back", 2), ("nulls", 1), ("lost", 1), ("to-null", 1), ("empty", 1), (None, 3),
                                   ("late", 3), ("gone", 1), ("gone", 5), ("redelivered", 1)], "url string, t int")
    run = lambda d, n: inc.changed_rows(d, taken, "id", "url", "t", "body", inc.Ledger(spark, f"file://{tmp_path}/{n}"))
    # "late": an older version that came late is no news; "gone": taken over last was a version that isn't there any more, so its row is taken anew.
    assert [r[0] for r in rows(run(df, "all"))] == [1, 5, 8, 9, 15, 17, 19, 22]
    assert run(df.limit(0), "none").count() == 0
    # The ledger has the result and all numbers looked at.
    ledger = inc.Ledger(spark, f"file://{tmp_path}/all")
    assert ledger.commits() == 2 and sum(r["hi"] - r["lo"] + 1 for r in ledger.done().collect()) == 24


def test_ledger_takes_each_number_once(spark, tmp_path):
    ledger = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    first = nums(spark, [1, 2, 3, 7, 100_000])
    assert ledger.run(first, "seq", lambda d: d) == 5
    assert ledger.run(first, "seq", lambda d: d) == 0
    late = nums(spark, [1, 2, 3, 5, 7, 8, 100_000, -4, None])  # 5 and -4 were committed late

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(late, "seq", broken)
    assert ledger.output().count() == 5
    assert ledger.run(late, "seq", lambda d: d) == 3
    assert rows(ledger.output()) == rows(late.where("seq is not null"))
    assert ledger.commits() == 2


def test_ledger_survives_a_torn_commit(spark, tmp_path):
    ledger = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.run(nums(spark, [1, 2]), "seq", lambda d: d) == 2
    (tmp_path / "ledger/commits/000000000001.json").write_text("")  # created, then the driver died
    (tmp_path / "ledger/commits/.abc.draft").write_text('{"count"')  # died before the rename
    again = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    assert again.commits() == 1 and again.run(nums(spark, [1, 2, 3]), "seq", lambda d: d) == 1
    assert rows(again.output()) == rows(nums(spark, [1, 2, 3])) and rows(inc.Ledger(spark, again.folder).done(), "lo", "hi") == [(1, 3)]


def test_ledger_with_a_long_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "LISTED", 2)
    ledger = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    for k in range(6):
        ledger.run(nums(spark, range(k + 1)), "seq", lambda d: d)
    assert rows(ledger.output()) == rows(nums(spark, range(6))) and len(ledger.log.last()[1]["outputs"]) <= 2


def test_spans_skip_what_is_processed(spark, tmp_path):
    b = inc.BLOCK
    full = spark.range(-b, 3 * b).select(F.col("id").alias("seq"))
    ledger = inc.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.adopt(full.where(f"seq <> {b + 5}"))
    assert ledger.log.last()[1]["spans"] == [[-b, b - 1], [2 * b, 3 * b - 1]]
    path = f"{tmp_path}/source"
    full.withColumn("x", F.lit(1)).write.parquet(path)
    source = spark.read.parquet(path)
    plan = source.where(inc.outside(F.col("seq"), [[-b, b - 1]]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and f"LessThan(seq,{-b})" in plan
    assert ledger.run(source, "seq", lambda d: d) == 1 and rows(ledger.output(), "seq") == [(b + 5,)]
    assert rows(inc.within(nums(spark, [1, 5, 5, 9, None]), "seq", inc.intervals(nums(spark, [5, 9]))), "seq") == [(5,), (5,), (9,)]


def test_ledger_lets_one_of_two_commit(spark, tmp_path):
    a, b = (inc.Ledger(spark, f"file://{tmp_path}/ledger") for _ in range(2))

    def meanwhile(d):
        b.run(nums(spark, [1, 2]), "seq", lambda x: x)
        return d

    with pytest.raises(Exception, match="(?i)exist"):
        a.run(nums(spark, [1, 2]), "seq", meanwhile)
    assert rows(a.output()) == rows(nums(spark, [1, 2]))
