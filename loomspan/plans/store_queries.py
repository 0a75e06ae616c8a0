"""Named queries for files, containers, late data and streams, with the same in SQL.

Files are written from the tables into the shared folder and read back by the
loaders, so each query goes through a whole source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import dates
from loomspan.operators import graph as g
from loomspan.operators import timeline
from loomspan.plans import dashboards
from loomspan.plans.graph_queries import ALL, BASE, DAY, LOG_BETA, MONTH, SCHEMA, SPLIT, TOPIC_OUT, TOPICS, YEAR, between, documents, network, r6
from loomspan.plans.rollup import Rollup
from loomspan.plans.runtime import new_path, staged
from loomspan.sources import codec, cooccurrence, textfiles, webpages
from loomspan.sources.tables import table
from loomspan.streaming import streams
from loomspan.temporal import Graph, TemporalGraph, Vector

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- text files --------------------------------------------------------------------
DAILY = BASE + ", y AS (SELECT ts, source, target, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2, 3) "


@query(DAILY + "SELECT ts, source, target, weight FROM y")
def text_edge_list(spark, folder):
    """Graphs of days written as text lines and loaded again."""
    path = new_path(spark, "edges-text")
    daily = timeline.compress(network(spark, folder).edges, lambda ts: ts)
    textfiles.write_edge_list(daily, path)
    return r6(TemporalGraph.load(spark, path, check_order=True).edges).select("ts", "source", "target", "weight")


@query("SELECT s_suppkey AS node, s_name AS text, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def text_node_list(spark, folder):
    path = new_path(spark, "nodes-text")
    table(spark, folder, "supplier").select(F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey").alias("value")).write.text(path)
    n = textfiles.node_list(spark, path, "text;nation")
    return n.select("node", F.col("attrs.text").alias("text"), F.col("attrs.nation").alias("nation"))


@query("""WITH r AS (SELECT epoch_ms(o_orderdate) AS ts, o_orderkey AS article, l_suppkey AS source, l_partkey AS target, exp(CAST(-l_linenumber AS DOUBLE)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT ts, source, target, round(sum(weight), 6) AS weight FROM (SELECT ts, article, source, target, max(w) AS weight FROM r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def text_raw_edges(spark, folder):
    """A tab-separated export of raw co-occurrences, read with its header and made into edges."""
    path = new_path(spark, "raw-edges")
    j = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    row = [F.col("l_suppkey").cast("string").alias("id1"), F.col("l_partkey").cast("string").alias("id2"), F.lit("A").alias("type1"), F.lit("O").alias("type2"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
           F.col("o_orderkey").cast("string").alias("article"), F.lit("x").alias("outlet"), F.col("l_linenumber").cast("string").alias("dist")]
    j.select(*row).write.option("sep", "\t").option("header", "true").csv(path)
    return r6(cooccurrence.edge_variants(textfiles.raw_edges(spark, path), "max"))


@query("""SELECT s_suppkey AS node, s_name AS label, CASE s_nationkey % 5 WHEN 0 THEN 'LOC' WHEN 1 THEN 'ORG' WHEN 2 THEN 'ACT' WHEN 3 THEN 'DAT' ELSE 'TER' END AS type FROM supplier""")
def text_raw_nodes(spark, folder):
    path = new_path(spark, "raw-nodes")
    letter = F.element_at(F.array(*[F.lit(x) for x in "LOADT"]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    table(spark, folder, "supplier").select(F.concat_ws("\t", "s_suppkey", letter, F.lit("Q1"), "s_name").alias("value")).write.text(path)
    return textfiles.raw_nodes(spark, path)


# ---- binary files -----------------------------------------------------------------------
MONTHLY = BASE + ", y AS (SELECT epoch_ms(date_trunc('month', make_timestamp(ts * 1000))) AS doc_id, source, target, sum(weight) AS w FROM e GROUP BY 1, 2, 3) "


@query(MONTHLY + "SELECT doc_id, source, target, round(CAST(CAST(w AS FLOAT) AS DOUBLE), 4) AS weight FROM y")
def binary_graphs(spark, folder):
    """A binary file per month, written by the tasks and read back; weights have the precision of 32 bits."""
    path = new_path(spark, "graphs")
    months = timeline.compress(network(spark, folder).edges, lambda ts: timeline.calendar_start(ts, "M")).withColumnRenamed("ts", "doc_id")
    codec.write_graphs(months, path)
    return codec.read_graphs(spark, f"{path}/*.graph").select(codec.id_of("path").alias("doc_id"), "source", "target", F.round("weight", 4).alias("weight"))


@query(BASE + "SELECT epoch_ms(date_trunc('month', make_timestamp(ts * 1000))) AS doc_id, node, CAST(sum(freq) AS DOUBLE) AS weight FROM n GROUP BY 1, 2")
def binary_vectors(spark, folder):
    path = new_path(spark, "vectors")
    n = network(spark, folder).doc_nodes
    months = n.groupBy(timeline.calendar_start(F.col("ts"), "M").alias("doc_id"), "node").agg(F.sum("freq").alias("weight"))
    codec.write_vectors(months, path)
    return codec.read_vectors(spark, f"{path}/*.vector").select(codec.id_of("path").alias("doc_id"), "node", "weight")


# ---- web pages ---------------------------------------------------------------------------
@query("SELECT p_partkey AS page, p_name AS text, p_brand AS section, p_type AS category, '2023-05-0' || CAST(p_size % 9 + 1 AS VARCHAR) AS date FROM part")
def web_events(spark, folder):
    """Events from nested lists of pages: one page per part, its brand the heading above its name."""
    p = table(spark, folder, "part")
    day = F.concat(F.lit("2023-05-0"), (F.col("p_size") % 9 + 1).cast("string"))
    html = F.concat(F.lit('<table class="vevent"><tr><td><span class="summary">Day ('), day, F.lit(")</span><dl><dt>"), "p_type", F.lit("</dt></dl><ul><li>"), "p_brand", F.lit("<ul><li>"), "p_name", F.lit("</li></ul></li></ul></td></tr></table>"))
    e = webpages.events(p.select(F.col("p_partkey").alias("page"), html.alias("html")), "page", "html")
    return e.select("page", "text", F.col("section")[0].alias("section"), "category", "date")


# ---- dates --------------------------------------------------------------------------------
@query("""WITH d AS (SELECT o_orderkey AS doc_id, o_orderdate AS t, o_orderkey % 4 AS k FROM orders)
SELECT doc_id, strftime(CASE k WHEN 2 THEN date_trunc('month', t) WHEN 3 THEN make_timestamp(year(t), 1, 1, 0, 0, 0) ELSE t END, '%Y-%m-%d') AS first,
  strftime(CASE k WHEN 0 THEN t WHEN 1 THEN t + INTERVAL 40 DAY WHEN 2 THEN last_day(t) ELSE make_timestamp(year(t) + 2, 12, 31, 0, 0, 0) END, '%Y-%m-%d') AS last FROM d""")
def free_text_ranges(spark, folder):
    """Days, ranges of days, months and ranges of years, written out and read again."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("t"))
    long_, late = F.date_format("t", "d MMMM yyyy"), F.date_format(F.date_add("t", 40), "MMMM d, yyyy")
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("Monday, "), long_)).when(kind == 1, F.concat(long_, F.lit(" (about) – "), late)).when(kind == 2, F.date_format("t", "MMMM yyyy")).otherwise(F.concat(F.year("t"), F.lit(" - "), F.year("t") + 2))
    days = dates.free_text_range(text, F.lit(None).cast("string"))
    return o.select("doc_id", days[0].alias("first"), days[1].alias("last"))


@query("SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) - 7200000 AS ms FROM orders")
def social_dates(spark, folder):
    o = table(spark, folder, "orders")
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "E MMM dd HH:mm:ss '+0200' yyyy")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.unix_millis(dates.social_date(text)).alias("ms"))


# ---- containers ------------------------------------------------------------------------------
def _halves(spark, folder) -> tuple[TemporalGraph, TemporalGraph]:
    t = network(spark, folder)
    return t.within_time(None, SPLIT - 1), t.within_time(SPLIT, ALL[1])


@query(BASE + "SELECT source, target, round(weight, 6) AS weight FROM g")
def link_graphs(spark, folder):
    """Documents of the later half linked to those of the earlier."""
    a, b = _halves(spark, folder)
    return r6(a.link(b).sum_edges().df)


@query(BASE + "SELECT source, target, round(sum(weight), 6) AS weight FROM e WHERE doc NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2")
def unlink_graphs(spark, folder):
    gone = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    return r6(network(spark, folder).unlink(gone).sum_edges().df)


@query(BASE + "SELECT source, target, round(weight, 6) AS weight FROM e WHERE doc = (SELECT min(doc) FROM e)")
def single_graph(spark, folder):
    t = network(spark, folder)
    return r6(t.graph(t.edges.agg(F.min("doc_id")).first()[0]).df)


def _named(spark, folder) -> TemporalGraph:
    s = table(spark, folder, "supplier")
    attrs = F.create_map(F.lit("text"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    return TemporalGraph(documents(spark, folder), network(spark, folder).edges, None, s.select(F.col("s_suppkey").alias("node"), attrs.alias("attrs")), primary_key=("text",))


@query("SELECT s_suppkey AS node, s_name AS text FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def node_get_or_create(spark, folder):
    """Nations get the next numbers, suppliers keep theirs."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    both = s.select(F.create_map(F.lit("text"), F.col("s_name")).alias("attrs")).unionByName(n.select(F.create_map(F.lit("text"), F.col("n_name")).alias("attrs")))
    return _named(spark, folder).get_or_create(both).nodes.select("node", F.col("attrs.text").alias("text"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS nation, min(s_suppkey) AS node FROM supplier GROUP BY 1")
def node_primary_key(spark, folder):
    """Of nodes that share a new primary key the least stays."""
    return _named(spark, folder).keyed_by("nation").nodes.select(F.col("attrs.nation").alias("nation"), "node")


@query("SELECT s_suppkey AS node, CASE WHEN s_suppkey = 3 THEN 'big' END AS size, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_nationkey <> 7")
def node_attributes(spark, folder):
    """An attribute set on one node; nodes of a nation taken out."""
    t = _named(spark, folder)
    t = t.without_nodes(t.find_nodes(nation="7")).with_attributes(3, size="big")
    return t.nodes.select("node", F.try_element_at("attrs", F.lit("size")).alias("size"), F.col("attrs.nation").alias("nation"))


@query("SELECT s_suppkey AS node, CASE WHEN s_nationkey < 5 THEN 'again' ELSE s_name END AS text FROM supplier")
def node_link(spark, folder):
    """Nodes linked again under the same number, the last of them kept."""
    more = table(spark, folder, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("node"), F.create_map(F.lit("text"), F.lit("again")).alias("attrs"))
    return _named(spark, folder).with_nodes(more, first_wins=False).nodes.select("node", F.col("attrs.text").alias("text"))


@query("SELECT * FROM (VALUES (1, 4.0), (2, 2.5), (4, 0.5)) v(node, weight)".replace("(1, 4.0)", "(CAST(1 AS BIGINT), CAST(4.0 AS DOUBLE))"))
def vector_entries(spark, folder):
    """Entries set, added, taken away and deleted one by one, and read back as a dictionary."""
    v = Vector.from_dict(spark, {1: 1.0, 2: 2.0, 3: 3.0}).set({1: 4.0}).add({2: 1.0, 4: 1.0}).add({2: 0.5, 4: 0.5}, -1.0).delete([3, 9])
    return Vector.from_dict(spark, v.as_dict()).df


@query(BASE + ", t AS (SELECT * FROM g ORDER BY weight DESC, source, target LIMIT 50) SELECT source, target, round(weight, 6) AS weight FROM t")
def graph_dictionary(spark, folder):
    """The fifty heaviest edges as a dictionary, and a graph made of it again."""
    top = network(spark, folder).sum_edges().top_edges(50, truncate=True)
    return r6(Graph.from_dict(spark, top.as_dict()).df)


# ---- windows of one's own, sizes of nodes ------------------------------------------------------
CUT = [YEAR[0], YEAR[0] + 10 * DAY, YEAR[0] + 100 * DAY, YEAR[0] + 300 * DAY]
CUT_SQL = "CASE " + " ".join(f"WHEN ts >= {a} THEN {a}" for a in reversed(CUT)) + " END"


@query(BASE + TOPICS.format(more=f", CAST(count(DISTINCT {CUT_SQL}) AS DOUBLE) AS t", r=between(YEAR)) + TOPIC_OUT.format(score="3.0 / ((x.c + y.c - d) / d + d / s + 4.0 / t)"))
def topics_custom_windows(spark, folder):
    windows = list(zip(CUT, [*(a - 1 for a in CUT[1:]), YEAR[1]]))
    return r6(network(spark, folder).topics(*YEAR, windows=windows).df)


def _size_sql(expr: str) -> str:
    return BASE + f", v AS ({expr}) SELECT node, CASE WHEN x > 0 THEN round(greatest(ln(x) + 10, 1), 6) ELSE 1 END AS weight FROM v"


def _sizes(spark, folder, kind: str) -> DataFrame:
    return r6(dashboards.node_sizes(network(spark, folder), kind, *ALL)).select("node", "weight")


@query(_size_sql("SELECT node, CAST(dg AS DOUBLE) AS x FROM deg"))
def dashboard_degrees(spark, folder):
    return _sizes(spark, folder, "out_degrees")


@query(_size_sql("SELECT node, ow AS x FROM deg"))
def dashboard_weights(spark, folder):
    return _sizes(spark, folder, "in_weights")


@query(_size_sql("SELECT b.source AS node, any_value(o.ow) - sum(b.weight * p.ow) / any_value(o.ow) AS x FROM b JOIN deg o ON o.node = b.source JOIN deg p ON p.node = b.target GROUP BY 1"))
def dashboard_weight_anomalies(spark, folder):
    return _sizes(spark, folder, "weight_anomalies")


@query()
def dashboard_entropy(spark, folder):
    """How unusual each node's places in the eigenvectors of nine windows are."""
    return dashboards.node_sizes(network(spark, folder), "entropy", *ALL).select("node", "weight")


# ---- late data, streams ---------------------------------------------------------------------------
@query(BASE + "SELECT source, target, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2")
def rollup_late_data(spark, folder):
    """A rollup of the documents that aren't urgent, refreshed in the buckets of the urgent ones that come late."""
    edges = staged(network(spark, folder).edges, "edges")
    late = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    r = Rollup(spark, new_path(spark, "rollup"), MONTH)
    r.build(edges.join(late, "doc_id", "left_anti"))
    buckets = [x[0] for x in edges.join(late, "doc_id", "left_semi").select(F.floor(F.col("ts") / MONTH).alias("b")).distinct().collect()]  # a number per bucket of a month
    r.refresh(edges, None, [b * MONTH for b in buckets])
    return r6(r.sum_edges(edges, *ALL))


@query(BASE + f"""SELECT w AS window_start, source, target, round(sum(weight), 6) AS weight FROM (SELECT *, ts - (ts - {5 * DAY}) % {MONTH} AS w, (SELECT max(ts) FROM e) AS m FROM e)
WHERE w + {MONTH} <= m - 3600000 GROUP BY 1, 2, 3""")
def stream_watermark(spark, folder):
    """Windows that the watermark, an hour behind the last row, has passed; their state is let go."""
    path, out = new_path(spark, "edge-files"), new_path(spark, "stream")
    network(spark, folder).edges.select("doc_id", "ts", "source", "target", "weight").write.parquet(path)
    s = streams.read_edges(spark, path, SCHEMA)
    streams.run_to_table(streams.tumbling_sums(s, MONTH, 5 * DAY), out, new_path(spark, "progress"))
    return r6(spark.read.schema("window_start bigint, source bigint, target bigint, weight double").parquet(out))


@query(BASE + f"SELECT source, target, max(ts) AS ts, round(sum(weight * exp({LOG_BETA!r} * (m - ts))), 6) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY source, target) AS m FROM e) GROUP BY 1, 2")
def stream_decayed_state(spark, folder):
    """Decayed sums kept in Spark's state store."""
    path, out = new_path(spark, "edge-files"), new_path(spark, "stream")
    network(spark, folder).edges.select("doc_id", "ts", "source", "target", "weight").write.parquet(path)
    s = streams.decayed_sums(streams.read_edges(spark, path, SCHEMA), LOG_BETA)
    streams.run_to_table(s, out, new_path(spark, "progress"), "update")
    return r6(streams.latest_batch(spark, out, ["source", "target"]), "value")
