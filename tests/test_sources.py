import math
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import ids
from loomspan.functions.dates import free_text_range, publishing_date, social_date
from loomspan.sources import codec, cooccurrence, filters, news, textfiles, webpages
from loomspan.temporal import TemporalGraph
from tests.helpers import near, rows

DOC = "doc_id bigint, ts bigint, ext_id string"


def mentions(spark, occ):
    docs = spark.createDataFrame([(1, 1000, "AB")], DOC)
    raw = spark.createDataFrame([(1, s, e, "x") for s, e in occ], "doc bigint, sen bigint, ent bigint, ts string")
    return docs, cooccurrence.occurrences_of(raw, "doc", "sen", "ent")


def test_cooccurrence(spark):
    for i in range(8):
        t = TemporalGraph.from_mentions(*mentions(spark, [(1, 1), (1 + i, 2), (None, 1), (1, None), (-1, 3)]), max_distance=5)
        g = t.graph(ext_id="ab")
        assert near(g.as_dict(), {(1, 2): math.exp(-i)} if i <= 5 else {}) and g.nodes().as_dict() == {1: 1, 2: 1}
    assert g.connected_components().as_dict() == {1: 0.0, 2: 1.0}  # mentioned, but without an edge
    loop = TemporalGraph.from_mentions(*mentions(spark, [(i, 1) for i in range(10)] * 2), max_distance=5).graph(1)
    assert loop.num_edges() == 0 and loop.nodes().as_dict() == {1: 20}
    with pytest.raises(KeyError):
        t.graph(ext_id="zz")
    far = [(0, 1), (2**63 - 1, 2)]
    assert TemporalGraph.from_mentions(*mentions(spark, far), max_distance=5).graph(1).num_edges() == 0
    assert TemporalGraph.from_mentions(*mentions(spark, far)).graph(1).as_dict() == {(1, 2): 0.0}
    for occ in ([(1, 1), (2, 2), (4, 1)], [(1, 1), (3, 2), (4, 1)]):
        m = mentions(spark, occ)
        assert near(TemporalGraph.from_mentions(*m, max_distance=5).graph(1).as_dict(), {(1, 2): math.exp(-1) + math.exp(-2)})
        assert near(TemporalGraph.from_mentions(*m, max_distance=5, how="max").graph(1).as_dict(), {(1, 2): math.exp(-1)})
        assert near(TemporalGraph.from_mentions(*m, max_distance=5, normalize=True).graph(1).as_dict(), {(1, 2): 1.0})


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(10)
    occ = [(rng.randrange(3), rng.randrange(40), rng.randrange(6)) for _ in range(150)]
    docs = spark.createDataFrame([(d, 10 * d, None) for d in range(3)], DOC)
    df = spark.createDataFrame(occ, "doc_id bigint, sen bigint, ent bigint")
    want = {}
    for i, (d, s, e) in enumerate(occ):
        for d2, s2, e2 in occ[:i]:
            if d == d2 and e != e2 and abs(s - s2) <= 4:
                k = (d, min(e, e2), max(e, e2))
                want[k] = want.get(k, 0) + math.exp(-abs(s - s2))
    got = {(r["doc_id"], r["source"], r["target"]): r["weight"] for r in cooccurrence.cooccurrences(docs, df, 4).collect()}
    assert near(got, want)


def test_edge_list(spark, tmp_path):
    p = tmp_path / "a.graph"
    p.write_bytes(b"# comment\r\n; other\r\n\r\n1 2 0.5 100\r\n2\t1  1.5 100 junk\r\n 3 3 1 100\r\n1 2 4 200\r\nbad line here x\r\n")
    t = TemporalGraph.load(spark, f"file://{p}")
    assert rows(t.edges, "ts", "source", "target", "weight") == [(100, 1, 2, 1.5), (100, 3, 3, 1.0), (200, 1, 2, 4.0)] and t.count_graphs() == 2
    assert rows(textfiles.edge_list(spark, f"file://{p}", directed=True), "ts", "source", "target", "weight")[:2] == [(100, 1, 2, 0.5), (100, 2, 1, 1.5)]
    textfiles.write_edge_list(t.edges.select("ts", "source", "target", "weight"), f"file://{tmp_path}/out")
    assert rows(textfiles.edge_list(spark, f"file://{tmp_path}/out"), "ts", "source", "target", "weight") == rows(t.edges, "ts", "source", "target", "weight")
    p.write_text("1 2 1 200\n1 2 1 100\n")
    with pytest.raises(ValueError):
        TemporalGraph.load(spark, f"file://{p}", check_order=True)
    p.write_text("# nothing\n")
    with pytest.raises(ValueError):
        TemporalGraph.load(spark, f"file://{p}")
    n = tmp_path / "a.nodes"
    n.write_text("1\tA\tPER\textra\n2\tB\n1\tZ\tORG\n")
    assert rows(textfiles.node_list(spark, f"file://{n}", "text;NE").select("node", F.col("attrs")["text"], F.col("attrs")["NE"])) == [(1, "A", "PER"), (2, "B", None)]
    assert rows(textfiles.node_list(spark, f"file://{n}", ";NE").select("node", F.col("attrs")["NE"])) == [(1, "A"), (2, "B")]


def test_raw_exports(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("id1\tid2\ttype1\ttype2\tdate\tarticle\toutlet\tdist\n1\t2\tL\tO\t2016-08-18 16:10:00\t7\tWP\t0\n1\t2\tL\tO\t2016-08-18 15:10:00\t7\tWP\t0\n1\t2\tL\tO\t2016-08-18 15:10:00\t7\tWP\t1\n3\t4\tL\tO\t2016-08-18 15:10:00\t8\tXX\t2\n")
    raw = textfiles.raw_edges(spark, f"file://{tmp_path}/e.tsv", [("WP", "2016-08-18 16:00:00", "2016-08-18 19:00:00")])
    assert raw.count() == 3
    e1, e2 = math.exp(-1), math.exp(-2)
    for how, a, b in (("sum", 1 + e1, e2), ("mean", (1 + e1) / 2, e2), ("max", 1.0, e2), ("norm", 1.0, 1.0)):
        assert near({(r["source"], r["target"]): r["weight"] for r in cooccurrence.edge_variants(raw, how).collect()}, {(1, 2): a, (3, 4): b})
    (tmp_path / "n.tsv").write_text("id\ttype\twikidata\tlabel\n2\tL\tQ1\tB\n1\tT\t\tA\n")
    assert rows(textfiles.raw_nodes(spark, f"file://{tmp_path}/n.tsv")) == [(1, "A", "TER"), (2, "B", "LOC")]


def test_entities(spark):
    df = spark.createDataFrame([(5, "b", "x"), (3, "c", None), (9, "b", "x"), (4, "a", "x"), (1, None, None)], "at int, name string, kind string")
    assert rows(cooccurrence.dense_entities(df, ["name", "kind"], ["at"])) == [(0, None, None), (1, "c", None), (2, "a", "x"), (3, "b", "x")]
    when = spark.createDataFrame([(1, datetime(2023, 1, 1, tzinfo=timezone.utc), "x"), (None, None, "y"), (2, None, "z")], "id int, time timestamp, k string")
    assert rows(cooccurrence.documents_of(when, "id", "time")) == [(1, 1672531200000, None)] and cooccurrence.documents_of(when, "id", "time", k="z").count() == 0


def test_codec(spark, tmp_path):
    s, t, w = [0, 1, 2, 3, 2], [1, 2, 3, 4, 4], [1.0, 2.0, 3.0, 4.0, 5.0]
    data = codec.encode_graph(s, t, w, flags=4)
    # Fixed value: the file of this graph.
    assert data.hex() == "5456474701000000040000000000000000000000" "0500000000000000" + "".join(
        f"{a:02x}00000000000000{b:02x}00000000000000{h}00000000" for a, b, h in ((0, 1, "0000803f"), (1, 2, "00000040"), (2, 3, "00004040"), (2, 4, "0000a040"), (3, 4, "00008040"))
    )
    for n in range(len(data)):
        with pytest.raises(ValueError):
            codec.decode_graph(data[:n])
    with pytest.raises(ValueError):
        codec.decode_vector(data)
    with pytest.raises(ValueError):
        codec.decode_graph(data + b"x")
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1000, 50), rng.integers(0, 1000, 50)
    e, flags = codec.decode_graph(codec.encode_graph(a, b, a + 0.5, 5, (2, 3)))
    assert flags == 5 and sorted(zip(e["source"], e["target"])) == sorted(zip(a, b))
    v, _ = codec.decode_vector(codec.encode_vector(a[:20], b[:20], 0, 2))
    assert sorted(v["node"]) == sorted(a[:20])
    (tmp_path / "g.bin").write_bytes(data)
    assert codec.read_graphs(spark, f"file://{tmp_path}/g.bin").count() == 5
    (tmp_path / "v.bin").write_bytes(codec.encode_vector([3, 1], [1.0, 2.0]))
    assert rows(codec.read_vectors(spark, f"file://{tmp_path}/v.bin"), "node", "weight") == [(1, 2.0), (3, 1.0)]
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 5, 6, 2.0)], "doc_id bigint, source bigint, target bigint, weight double")
    assert all(len(codec.decode_graph(bytes(r["content"]))[0]) == 1 for r in codec.graphs_as_bytes(edges).collect())


# Texts and the days they stand for.
FREE = [
    ("1 april 2015 (really!) - 12 november 2016 (exactly)", None, ["2015-04-01", "2016-11-12"]), ("1 april 2015\nother stuff", None, ["2015-04-01"] * 2), ("1 april 2015 -\nother stuff", None, None),
    ("1 april 2015 -\n\n\n12 november 2016", None, ["2015-04-01", "2016-11-12"]), ("april 1 - november 12, 2016", None, ["2016-04-01", "2016-11-12"]), ("april 1, 2015 – present", None, ["2015-04-01", "NOW"]),
    ("april - november 2016", None, ["2016-04-01", "2016-11-30"]), ("2002 - 2019", None, ["2002-01-01", "2019-12-31"]), ("2002 - present", None, ["2002-01-01", "NOW"]), ("5 august - october 2016", None, ["2016-08-05", "2016-10-31"]),
    ("january, 2018 - february, 2018", None, ["2018-01-01", "2018-02-28"]), ("april 1 - april 5", None, None), ("april 1 - april 5", "2017-01-01", ["2017-04-01", "2017-04-05"]), ("april - may", "2017-01-01", ["2017-04-01", "2017-05-31"]),
    ("monday, april 1 2015", None, ["2015-04-01"] * 2), ("12:00, 1 april 2015", None, ["2015-04-01"] * 2), ("26 april 1986; 33 years ago", None, ["1986-04-26"] * 2), ("april 1", None, None), ("april", "2017-01-01", ["2017-04-01", "2017-04-30"]),
    ("1 - 12 november 2016", None, ["2016-11-01", "2016-11-12"]), ("april 21-22, 2016", None, ["2016-04-21", "2016-04-22"]), ("april 1-5", None, None), ("april 1-5", "2017-01-01", ["2017-04-01", "2017-04-05"]), ("present", None, None), ("", None, None), (None, None, None), ("soon", "2017-01-01", None),
]


FREE += [("31 april 2015", None, None), ("29 february 2016", None, ["2016-02-29"] * 2), ("1 2 may 2015", None, None), ("monday", None, None), ("monday april", "2017-01-01", None), ("5 - 6", "2017-01-01", None), ("april - present", None, None),
         ("total: 3 may 2011", None, ["2011-05-03"] * 2), ("1 may 2015 - 2 may", None, None), ("x" * 20_000, None, None), ("1 - 2 - 3 may 2011", None, None)]


def test_free_text_range(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(FREE)], "i int, t string, r string")
    got = {r["i"]: r["x"] for r in df.select("i", free_text_range(F.col("t"), F.col("r")).alias("x")).collect()}
    assert {FREE[i][:2]: x for i, x in got.items()} == {(t, r): want for t, r, want in FREE}


def test_publishing_date(spark):
    crawl = datetime(2019, 1, 1)
    cases = [("2019-04-15", "2019-04-15 00:00:00"), ("2019-04-15T17:15:38+02:00", "2019-04-15 15:15:38"), ("2019-04-15T17:15:38+02:00[Europe/Paris]", "2019-04-15 15:15:38"), ("2019-05-23T11:13:00Z", "2019-05-23 11:13:00"), ("2019-05-22T03:33:14.929+02:00", "2019-05-22 01:33:14.929"), ("2019-05-22T03:33:14.929Z", "2019-05-22 03:33:14.929"), ("2019-05-Invalid", "2019-01-01 00:00:00"), (None, "2019-01-01 00:00:00")]
    df = spark.createDataFrame([(t, crawl) for t, _ in cases], "t string, c timestamp")
    got = [r[0] for r in df.select(publishing_date(F.col("t"), F.lit("2019-01-01").cast("timestamp")).cast("string")).collect()]
    assert got == [w for _, w in cases]


def test_news(spark):
    ex = spark.createDataFrame([("a", 5), ("b", 5), ("b", 7), ("c", 1), (None, 9)], "url string, t int").withColumn("extracttime", F.timestamp_seconds("t"))
    done = ex.where("url = 'a'")
    assert rows(news.new_articles(ex, done), "url", "t") == [("b", 5)]
    assert rows(news.new_articles(ex, done.limit(0), "1970-01-01"), "url", "t") == [("a", 5), ("b", 5), ("c", 1)]
    d = spark.createDataFrame([(1, "Anna met Bert. He saw Carla!"), (2, None), (3, "")], "id int, text string")
    assert rows(news.sentence_mentions(d, "id", "text")) == [(1, 0, "Anna"), (1, 0, "Bert"), (1, 1, "Carla")]


PAGE = """<table class="x vevent"><tr><td><span class="summary">May 2 (2019-05-02)</span><dl><dt>Arts</dt></dl>
<ul><li><a href="/wiki/War">War</a><ul><li>First <a href="/n1">news</a>.</li><li><a href="/wiki/Sub">Sub</a><ul><li>Second</li></ul></li></ul></li>
<li>Third<br>line</li></ul><div role="heading">Law</div><ul><li>Fourth</ul></td></tr></table><div class="vevent"><span class="summary">no date</span><li>x</li></div>"""
WIKI = '<table class="infobox"><tr><th>Date</th><td>1 may 2019 –<br>present<sup>[1]</sup></td></tr></table>'


def test_web_pages(spark):
    e = webpages.events_of(PAGE)
    assert [(x["text"], x["section"], x["category"], x["date"]) for x in e] == [("First news.", ["War"], "Arts", "2019-05-02"), ("Second", ["Sub", "War"], "Arts", "2019-05-02"), ("Thirdline", [], "Arts", "2019-05-02"), ("Fourth", [], "Law", "2019-05-02")]
    assert e[0]["text_urls"] == {"news": "/n1"} and e[0]["urls"] == {"news": "/n1", "War": "/wiki/War"} and e[1]["section_urls"] == {"Sub": "/wiki/Sub", "War": "/wiki/War"}
    assert "2019" in webpages.infobox_date_text(WIKI) and webpages.infobox_date_text("<p>") is None
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>nothing")], "id int, html string")
    out = webpages.events(pages, "id", "html")
    assert out.count() == 4
    wiki = spark.createDataFrame([("/wiki/War", WIKI), ("/wiki/Sub", "<p>")], "url string, html string")
    assert rows(webpages.section_dates(out, wiki, "id")) == [(1, "First news.", "War", "2019-05-01", "NOW"), (1, "Second", "War", "2019-05-01", "NOW")]


def test_filters(spark):
    df = spark.createDataFrame([(i, 10 * i) for i in range(6)], "doc_id int, ts int")
    names = {"id": "doc_id", "time": "ts"}
    pick = lambda q: [r[0] for r in df.where(filters.condition(q, names)).orderBy("doc_id").collect()]
    assert pick({"id": 3}) == [3] and pick({"time": {"$gt": 10, "$lte": 30}, "id": {"$lt": 3}}) == [2] and pick({}) == list(range(6))
    assert pick({"$or": [{"time": {"$gte": 40}}, {"id": 0, "time": 0}]}) == [0, 4, 5]
    for bad in ({"id": {"$in": [1]}}, {"$and": []}, {"$or": []}, {"id": {}}):
        with pytest.raises(NotImplementedError):
            filters.condition(bad)
    assert [r[0] for r in df.orderBy(*filters.order({"time": -1, "id": 1}, names)).limit(2).collect()] == [5, 4]
    with pytest.raises(NotImplementedError):
        filters.order({"id": 0})


def test_object_ids(spark):
    cases = [(0, 0, "0" * 24), (255, 16, "000000ff" + "0" * 14 + "10"), (2**32 - 1, -1, "f" * 24), (2**32, 0, None), (-1, 0, None), (None, 1, None)]
    df = spark.createDataFrame(cases, "h bigint, l bigint, t string")
    assert df.where(~ids.oid_text(F.col("h"), F.col("l")).eqNullSafe(F.col("t"))).count() == 0
    back = df.where("t is not null").select("h", "l", ids.oid_parts(F.col("t")).alias("p"))
    assert back.where("p.high <> h or p.low <> l").count() == 0
    assert spark.createDataFrame([("xyz",), (None,), ("0" * 23,)], "t string").where(ids.oid_parts(F.col("t")).isNotNull()).count() == 0


def test_social_date(spark):
    df = spark.createDataFrame([("Wed Oct 10 20:19:24 +0200 2018",), ("10 Oct 2018",), (None,)], "t string")
    assert [r[0] for r in df.select(social_date(F.col("t")).cast("string")).collect()] == ["2018-10-10 18:19:24", None, None]
