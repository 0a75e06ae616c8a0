import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import timeline as tl
from loomspan.plans.rollup import Intervals, Rollup
from loomspan.streaming import streams
from loomspan.temporal import TemporalGraph
from tests.helpers import near, rows

SIX = [(100, {(0, 1): 1.0}), (200, {(0, 1): 1.0}), (200, {(1, 2): 0.5}), (300, {(0, 1): 0.5}), (300, {(0, 1): 1.0}), (300, {(1, 2): 1.0})]


def test_topics(spark):
    t = TemporalGraph.from_graphs(spark, SIX, positive=True)
    for r, want in (((51, 150), 1), ((151, 250), 2 / 3), ((251, 350), 12 / 17), ((51, 350), 28 / 37), ((0, 400), 28 / 37)):
        assert abs(t.topics(*r)[0, 1] - want) < 1e-9
    for r, want in (((51, 350), 14 / 17), ((0, 350), 126 / 167), ((0, 400), 126 / 181)):
        assert abs(t.topics(*r, step=100, offset=51)[0, 1] - want) < 1e-9
    assert abs(t.topics(0, 400, windows=[(0, 50), (51, 150), (151, 250), (251, 350), (351, 999)])[0, 1] - 126 / 181) < 1e-9
    for bad in ([(0, 50), (60, 400)], [(0, 300)], []):
        with pytest.raises(ValueError):
            t.topics(0, 400, windows=bad)
    with pytest.raises(ValueError):
        t.topics(1, 0)
    u = TemporalGraph.from_graphs(spark, [(100, {(0, 1): 50.0}), (100, {(0, 1): 50.0}), (100, {(1, 2): 1.0})])
    assert abs(u.topics(51, 150)[0, 1] - 25 / 19) < 1e-9 and abs(u.topics(51, 150, step=100, offset=51)[0, 1] - 25 / 21) < 1e-9
    z = TemporalGraph.from_graphs(spark, [(1, {(0, 1): 1.0}), (1, {(0, 1): -1.0})])
    assert z.topics(0, 2).as_dict() == {(0, 1): 0.0}


def test_range_aggregations(spark):
    t = TemporalGraph.from_graphs(spark, [(100, {(0, 1): 1.0, (3, 3): 1.0}), (200, {(1, 0): 2.0, (1, 2): 0.0}), (300, {(0, 1): -3.0}), (300, {})])
    assert t.sum_edges().as_dict() == {(3, 3): 1.0}  # what comes to 0 goes
    assert t.sum_edges(100, 200).as_dict() == {(0, 1): 3.0, (3, 3): 1.0} and t.sum_edges(100, 200, eps=1.0).as_dict() == {(0, 1): 3.0}
    assert t.count_edges().as_dict() == {(0, 1): 3, (3, 3): 1, (1, 2): 1}
    assert t.sum_nodes().as_dict() == {0: 3, 1: 4, 2: 1, 3: 2} and t.count_nodes().as_dict() == {0: 3, 1: 3, 2: 1, 3: 1}
    assert [t.count_graphs(*r) for r in ((0, 100), (101, 299), (300, None), (None, None), (2**63, None))] == [1, 1, 2, 4, 0]
    with pytest.raises(ValueError):
        t.sum_edges(1, 0)
    assert t.sum_edges(-50, 100).num_edges() == 2
    assert t.extract(lambda ts: F.when(ts < 300, ts / 100).otherwise(0)).as_dict() == {(0, 1): 5.0, (3, 3): 1.0, (1, 2): 0.0}
    e = TemporalGraph.from_graphs(spark, [(i, {(0, 1): float(i * i % 7)}) for i in range(1, 8)])
    mean = 0.0
    for i in range(1, 8):
        mean = 0.3 * mean + 0.7 * (i * i % 7)
    assert near(e.sum_edges_exp_norm(0, 7, beta=0.3).as_dict(), {(0, 1): mean})
    assert near(e.sum_edges_exp(0, 7, beta=0.3, weight=2).as_dict(), {(0, 1): mean / 0.7 * 2})


def test_windows():
    rng = random.Random(6)
    for _ in range(3000):
        step, off = rng.randrange(1, 30), rng.randrange(0, 60)
        lo = rng.randrange(0, 100)
        hi = lo + rng.randrange(0, 100)
        o = off % step
        seen = {0 if x < o else 1 + (x - o) // step for x in range(lo, hi + 1)}
        assert tl.count_windows(lo, hi, step, off) == len(seen)
    assert tl.hopping(0, 9, 4, 3) == [(0, 0, 3), (1, 3, 6), (2, 6, 9)]
    with pytest.raises(ValueError):
        tl.hopping(0, 9, 0)


def test_compress_and_samples(spark):
    t = TemporalGraph.from_graphs(spark, [(10, {(0, 1): 1.0}), (60, {(0, 1): 2.0}), (140, {(0, 1): 4.0}), (150, {})])
    assert rows(t.compress(100, 50).edges, "ts", "weight") == [(0, 1.0), (50, 6.0)]
    assert [r[0] for r in rows(t.compress(100, 50).documents, "ts")] == [0, 50, 150] and t.compress(math.inf).edges.count() == 1
    s = TemporalGraph.from_graphs(spark, [(100, {(0, 0): 1.0}), (200, {(0, 0): 1.0}), (300, {(0, 0): 1.0})])
    assert rows(s.sample_graphs(100, 300, 101, 3), "step", "weight") == [(0, 2.0), (1, 1.0), (2, 2.0)]
    assert rows(s.sample_graphs(100, 300, 101, 3, "count_edges"), "step", "weight") == [(0, 2.0), (1, 1.0), (2, 2.0)]
    assert s.sample_graphs(100, 300, 101, 3, "topics").count() == 3
    assert s.sample_eigenvectors(100, 300, 101, 2, iterations=2).count() == 2


def test_calendar(spark):
    day = 86_400_000
    got = [tuple(r) for r in tl.calendar_ranges(spark, "1w", 3 * day, 13 * day).orderBy("step").collect()]  # a Sunday to a Wednesday
    assert got == [(0, 3 * day, 4 * day - 1), (1, 4 * day, 11 * day - 1), (2, 11 * day, 13 * day)]
    m = tl.calendar_ranges(spark, "2M", 31 * day, 150 * day).orderBy("step").collect()
    assert [r["win_min"] // day for r in m] == [31, 90, 151][: len(m)] and m[-1]["win_max"] == 150 * day
    assert [r["win_min"] // day for r in tl.calendar_ranges(spark, "2d", 3 * day, 6 * day).orderBy("step").collect()] == [3, 4, 6]
    assert [r["win_min"] // day for r in tl.calendar_ranges(spark, "1q", 40 * day, 100 * day).orderBy("step").collect()] == [40, 90]
    assert tl.calendar_ranges(spark, "1y", 0, 364 * day).count() == 1 and tl.calendar_ranges(spark, "500", 0, 999).count() == 2
    with pytest.raises(ValueError):
        tl.calendar_ranges(spark, "1x", 0, 1)


def test_lookup(spark):
    t = TemporalGraph.from_graphs(spark, [(100, {}), (200, {}), (200, {}), (300, {})])
    one = lambda d: [r["ts"] for r in d.collect()]
    assert one(t.lookup_ge(100.5)) == [200] and one(t.lookup_ge(301)) == [] and one(t.lookup_le(199.9)) == [100] and one(t.lookup_le(99)) == []
    assert one(t.lookup_near(150)) == [200] and one(t.lookup_near(149)) == [100] and one(t.lookup_near(999)) == [300]
    assert one(t.listing(limit=2)) == [100, 200] and one(t.listing(newest_first=True, limit=1)) == [300]
    from loomspan.operators import lookup

    n = {r["doc_id"]: (r["prev_doc"], r["next_doc"]) for r in lookup.neighbours_in_time(t.documents).collect()}
    assert n == {0: (None, 1), 1: (0, 2), 2: (1, 3), 3: (2, None)}
    assert one(lookup.page(t.documents, 200, 1, "next", 5)) == [200, 300] and one(lookup.page(t.documents, 200, 2, "prev", 5)) == [200, 100]
    assert list(lookup.pages(t.documents, size=3)) == [[(100, 0), (200, 1), (200, 2)], [(300, 3)]] and list(lookup.pages(t.documents, 250, size=2, back=True)) == [[(200, 2), (200, 1)], [(100, 0)]]
    assert one(lookup.page(t.documents, 200, None, "prev", 5)) == [200, 200, 100] and one(lookup.page(t.documents, 200, None, "ge", 1)) == [200]


def test_container(spark):
    a = TemporalGraph.from_graphs(spark, [(1, {(0, 1): 1.0})])
    with pytest.raises(ValueError):
        a.link(a)
    with pytest.raises(ValueError):
        TemporalGraph.from_graphs(spark, [(-1, {})])
    b = TemporalGraph.from_graphs(spark, [(1, {}), (2, {(0, 1): 5.0})])
    both = a.link(b.unlink(spark.createDataFrame([(0,)], "doc_id bigint")))
    assert both.count_graphs() == 2 and both.sum_edges().as_dict() == {(0, 1): 6.0} and both.graph(1).as_dict() == {(0, 1): 5.0}
    n = spark.createDataFrame([(0, {"text": "A"}), (1, {"text": "A", "norm": "B"}), (2, {})], "node bigint, attrs map<string,string>")
    t = a.with_nodes(n)
    assert rows(t.labelled(n.select("node"))) == [(0, "A"), (1, "B"), (2, "Node 2")]
    k = t.keyed_by("text")
    assert rows(k.nodes.select("node")) == [(0,), (2,)] and k.find_nodes(text="A").count() == 1
    assert k.with_attributes(0, x="1").with_attributes(0, x="2").find_nodes(x="2").count() == 1
    for bad in ({"text": "Z"}, {"": "1"}, {"a;b": "1"}):
        with pytest.raises(ValueError):
            k.with_attributes(0, **bad)
    more = spark.createDataFrame([({"text": "A", "x": "1"},), ({"text": "N"},), ({"text": "N", "x": "2"},), ({"y": "1"},), ({"text": "M"},)], "attrs map<string,string>")
    grown = k.get_or_create(more)
    assert rows(grown.nodes.select("node", F.col("attrs")["text"])) == [(0, "A"), (2, None), (3, "M"), (4, "N")] and grown.find_nodes(text="A", x="1").count() == 0
    first = TemporalGraph(a.documents, a.edges, primary_key=("text",)).get_or_create(more.limit(1))
    assert rows(first.nodes.select("node")) == [(0,)] and rows(first.get_or_create(more).nodes.select("node", F.col("attrs")["text"])) == [(0, "A"), (1, "M"), (2, "N"), (3, None)]
    with pytest.raises(ValueError):
        t.get_or_create(more)
    assert t.with_nodes(spark.createDataFrame([(0, {"text": "Q"})], "node bigint, attrs map<string,string>")).find_nodes(text="Q").count() == 0
    assert t.without_nodes(spark.createDataFrame([(0,)], "node bigint")).nodes.count() == 2


def test_intervals():
    rng = random.Random(7)
    s, plain = Intervals(), [0] * 110
    for _ in range(2000):
        lo = rng.randrange(100)
        hi = min(99, lo + rng.randrange(20))
        w = rng.choice([-1, 1])
        before = sum(map(bool, plain))
        change = s.change_of_length(lo, hi, w)
        s.add(lo, hi, w)
        for x in range(lo, hi + 1):
            plain[x] += w
        assert s.length() == sum(map(bool, plain)) == before + change
    assert [s.weight(x) for x in range(110)] == plain
    with pytest.raises(ValueError):
        s.add(2, 1)


def test_rollup(spark, tmp_path):
    rng = random.Random(8)
    data = [(rng.randrange(0, 1000), {(rng.randrange(4), 9): float(rng.randrange(1, 5))}) for _ in range(120)]
    t = TemporalGraph.from_graphs(spark, data)
    r = Rollup(spark, f"file://{tmp_path}/r", 100)
    r.build(t.edges)
    for _ in range(12):
        a = rng.randrange(0, 1000)
        b = a + rng.randrange(0, 1000)
        assert near(r.sum_edges(t.edges, a, b).rdd.map(lambda x: ((x[0], x[1]), x[2])).collectAsMap(), t.sum_edges(a, b).as_dict())
        assert near({(x[0], x[1]): x[2] for x in r.count_edges(t.edges, a, b).collect()}, t.count_edges(a, b).as_dict())
    late = t.link(TemporalGraph(*[d.withColumn("doc_id", F.lit(10_000).cast("bigint")) for d in (lambda x: (x.documents, x.edges))(TemporalGraph.from_graphs(spark, [(450, {(0, 9): 100.0})]))]))
    r.refresh(late.edges, None, [450])
    assert near({(x[0], x[1]): x[2] for x in r.sum_edges(late.edges, 0, 999).collect()}, late.sum_edges(0, 999).as_dict())


def test_streams(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, rng.randrange(0, 10_000), 1, rng.randrange(2, 4), 1.0 + i % 3) for i in range(60)]
    schema = "doc_id bigint, ts bigint, source bigint, target bigint, weight double"
    df = spark.createDataFrame(data, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    read = lambda: streams.read_edges(spark, f"{tmp_path}/in", schema, 1)
    streams.run_to_table(streams.tumbling_sums(read(), 1000, 300, drop_late=False), f"{tmp_path}/a", f"{tmp_path}/ca", "complete")
    got = streams.latest_batch(spark, f"{tmp_path}/a", ["window_start", "source", "target"])
    want = df.groupBy(tl.window_start(F.col("ts"), 1000, 300).alias("window_start"), "source", "target").agg(F.sum("weight").alias("weight"))
    assert rows(got, *want.columns) == rows(want)
    lb = -0.001
    best = {}
    for _, ts, s, t, w in data:
        best.setdefault((s, t), []).append((ts, w))
    want = {k: (max(ts for ts, _ in v), round(sum(w * math.exp(lb * (max(x for x, _ in v) - ts)) for ts, w in v), 6)) for k, v in best.items()}
    streams.run_to_table(streams.decayed_sums(read(), lb), f"{tmp_path}/b", f"{tmp_path}/cb", "update")
    one = streams.latest_batch(spark, f"{tmp_path}/b", ["source", "target"])
    two = streams.run_decayed(read(), lb, f"{tmp_path}/c", f"{tmp_path}/cc")
    for out in (one, two):
        assert {(r["source"], r["target"]): (r["ts"], round(r["value"], 6)) for r in out.collect()} == want
    streams.run_to_table(streams.tumbling_sums(read(), 1000), f"{tmp_path}/d", f"{tmp_path}/cd")
    streams.run_to_table(streams.hopping_sums(read(), 2000, 1000), f"{tmp_path}/e", f"{tmp_path}/ce")
    assert spark.read.parquet(f"{tmp_path}/d").columns == ["window_start", "source", "target", "weight"]


def test_decayed_sums_call_python_per_state_not_per_edge(spark, tmp_path):
    schema = "doc_id bigint, ts bigint, source bigint, target bigint, weight double"
    lb, rng = -0.001, random.Random(10)
    data = [(i, rng.randrange(0, 5000), i % 3000, 5000 + i % 7, float(i % 5)) for i in range(9000)]
    spark.createDataFrame(data + [(1, 5, None, 1, 1.0), (1, None, 1, 1, 1.0)], schema).repartition(2).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 9, 3, 5003, None), (2, 6000, 4, 5004, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = streams.decayed_sums(streams.read_edges(spark, f"{tmp_path}/in", schema, 1), lb, 2.0)
    q = s.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).outputMode("update").foreachBatch(lambda df, n: df.write.parquet(f"{tmp_path}/out/batch={n}")).start()
    q.awaitTermination()
    states = [x.stateOperators[0].numRowsTotal for x in q.recentProgress if x.stateOperators]
    assert max(states) <= streams.STATES  # states in the store
    want = {}
    for _, ts, a, b, w in [*data, (1, 9, 3, 5003, 0.0), (2, 6000, 4, 5004, 1.0)]:
        want.setdefault((a, b), []).append((ts, w))
    ends = {k: max(ts for ts, _ in v) for k, v in want.items()}
    want = {k: sum(2 * w * math.exp(lb * (ends[k] - ts)) for ts, w in v) for k, v in want.items()}
    got = streams.latest_batch(spark, f"{tmp_path}/out", ["source", "target"]).collect()
    assert {(r["source"], r["target"]): r["ts"] for r in got} == ends
    assert near({(r["source"], r["target"]): r["value"] for r in got}, want)
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().collect()}
    assert min(sizes.values()) == 2  # edges that a batch has no rows of aren't given out


def test_node_sizes_take_converged_eigenvectors(spark):
    from loomspan.plans import dashboards

    t = TemporalGraph.from_graphs(spark, [(10, {(0, 0): 1.0, (1, 1): 0.9}), (290, {(0, 0): 0.5, (1, 1): 1.0})])  # 0.9 ** 20 is 0.12
    got = {r["node"]: (r["weight"], r["colour"]) for r in dashboards.node_sizes(t, "trend", 0, 300, steps=2).collect()}
    assert got[1][0] > 0.97 and got[0][0] > 0.97 and (got[0][1], got[1][1]) == ("red", "green")


def test_stable_topics_look_at_first_fronts_only(spark, monkeypatch):
    from loomspan.operators import graph as g
    from loomspan.operators import metrics
    from loomspan.plans import dashboards

    rng = random.Random(13)
    data = [(rng.randrange(0, 3000), {(a, a + 1 + rng.randrange(20)): rng.choice([0.1, 0.4, 1.0]) for a in (rng.randrange(30) for _ in range(6))}) for _ in range(300)]
    t = TemporalGraph.from_graphs(spark, data)
    s = dashboards.normalized_samples(tl.sample_graphs(t.edges, dashboards.windows_of(100, 2900)))
    topic = t.topics(100, 2900).df
    dev = metrics.deviation(s, g.EDGE, 9).withColumnRenamed("weight", "dev")
    both = topic.withColumnRenamed("weight", "topic").join(dev, g.EDGE, "left").select(*g.EDGE, F.round("topic", 9).alias("topic"), F.round(F.coalesce("dev", F.lit(0.0)), 12).alias("dev"))
    want = g.top_edges(metrics.pareto(both, g.EDGE, "topic", "dev", True, False, 0.5), 8)
    shown = g.sparse_subgraph(topic, topic.join(want.select(*g.EDGE, (-F.col("weight")).alias("rank")), g.EDGE))
    asked, pareto = [], metrics.pareto
    monkeypatch.setattr(metrics, "pareto", lambda values, *a: (asked.append(values.count()), pareto(values, *a))[1])
    got, seeds = dashboards.subgraph(t, "stable_topics", 100, 2900)
    assert rows(seeds, *g.EDGE, "weight") == rows(want, *g.EDGE, "weight") and rows(got, *g.EDGE, "weight") == rows(shown, *g.EDGE, "weight")
    monkeypatch.setattr(dashboards, "SENT", 0)  # nodes too many to be sent
    assert rows(dashboards._rated(t, 100, 2900, 9).select(*g.EDGE, F.round("weight", 9).alias("topic"), F.round("dev", 12).alias("dev"))) == rows(both)
    assert asked[0] < both.count()  # the others are known to be behind
