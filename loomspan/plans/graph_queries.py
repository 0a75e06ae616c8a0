"""Named queries for temporal graphs, on co-occurrences of suppliers in orders, and the same in SQL.

An order is a document, a line its sentence, a supplier (or part) the entity
mentioned.  All results are rounded to 6 digits, as sums run in another order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import ids
from loomspan.functions.dates import publishing_date
from loomspan.operators import graph as g
from loomspan.operators import lookup, metrics, timeline, traversal
from loomspan.plans import dashboards
from loomspan.plans.rollup import Rollup
from loomspan.plans.runtime import new_path, staged
from loomspan.sources import cooccurrence, filters, news
from loomspan.sources.tables import table
from loomspan.streaming import streams
from loomspan.temporal import TemporalGraph

#: Ranges of the queries, in milliseconds: January 1995, the year 1995, all data.
JAN = (788918400000, 791596799999)
YEAR = (788918400000, 820454399999)
ALL = (788918400000, 996710399999)
DAY, MONTH = 86_400_000, 30 * 86_400_000
STEPS = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- inputs --------------------------------------------------------------------
def documents(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.documents_of(table(spark, folder, "orders"), "o_orderkey", "o_orderdate")


def mentions(spark: SparkSession, folder: str, entity: str = "l_suppkey") -> DataFrame:
    return cooccurrence.occurrences_of(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", entity)


def network(spark: SparkSession, folder: str, how: str = "sum", normalize: bool = False, entity: str = "l_suppkey", directed: bool = False) -> TemporalGraph:
    return TemporalGraph.from_tables(table(spark, folder, "orders"), "o_orderkey", "o_orderdate", mentions(spark, folder, entity), max_distance=5, how=how, normalize=normalize, directed=directed)


def whole(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of all time, on which the operators for a single graph run."""
    return network(spark, folder).sum_edges().df


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ("weight",)})


def base(entity: str = "l_suppkey", agg: str = "sum") -> str:
    return f"""WITH o AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS sen, {entity} AS ent FROM lineitem),
d AS (SELECT o_orderkey AS doc, epoch_ms(o_orderdate) AS ts FROM orders),
e AS (SELECT a.doc, d.ts, a.ent AS source, b.ent AS target, {agg}(exp(CAST(-abs(a.sen - b.sen) AS DOUBLE))) AS weight
  FROM o a JOIN o b ON a.doc = b.doc AND a.ent < b.ent AND abs(a.sen - b.sen) <= 5 JOIN d ON d.doc = a.doc GROUP BY a.doc, d.ts, a.ent, b.ent),
n AS (SELECT o.doc, d.ts, o.ent AS node, count(*) AS freq FROM o JOIN d ON d.doc = o.doc GROUP BY ALL),
g AS (SELECT source, target, sum(weight) AS weight FROM e GROUP BY 1, 2),
b AS (SELECT source, target, weight FROM g UNION ALL SELECT target, source, weight FROM g WHERE source <> target),
deg AS (SELECT source AS node, count(*) AS dg, sum(weight) AS ow FROM b GROUP BY 1)
"""


BASE = base()
EDGE_OUT = "SELECT source, target, round(weight, 6) AS weight FROM "


def between(r: tuple[int, int]) -> str:
    return f"ts BETWEEN {r[0]} AND {r[1]}"


# ---- sources -------------------------------------------------------------------
@query(BASE + EDGE_OUT + "(SELECT source, target, sum(weight) AS weight FROM e GROUP BY 1, 2)")
def cooc_edges_sum(spark, folder):
    return r6(network(spark, folder).sum_edges().df)


@query(base(agg="max") + EDGE_OUT + "(SELECT source, target, sum(weight) AS weight FROM e GROUP BY 1, 2)")
def cooc_edges_max(spark, folder):
    return r6(network(spark, folder, "max").sum_edges().df)


@query(BASE + EDGE_OUT + "(SELECT source, target, sum(weight / t) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY doc) AS t FROM e) GROUP BY 1, 2)")
def cooc_edges_norm(spark, folder):
    return r6(network(spark, folder, normalize=True).sum_edges().df)


@query(base("l_partkey") + EDGE_OUT + "(SELECT source, target, sum(weight) AS weight FROM e GROUP BY 1, 2)")
def cooc_parts_sum(spark, folder):
    return r6(network(spark, folder, entity="l_partkey").sum_edges().df)


@query("""WITH o AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS sen, l_suppkey AS ent FROM lineitem)
SELECT a.ent AS source, b.ent AS target, round(sum(exp(CAST(-(b.sen - a.sen) AS DOUBLE))), 6) AS weight FROM o a JOIN o b ON a.doc = b.doc AND a.ent <> b.ent
  AND b.sen - a.sen BETWEEN 0 AND 5 AND (b.sen > a.sen OR a.ent < b.ent) JOIN orders d ON d.o_orderkey = a.doc GROUP BY 1, 2""")
def cooc_edges_directed(spark, folder):
    return r6(network(spark, folder, directed=True).sum_edges().df)


@query(BASE + "SELECT node, CAST(sum(freq) AS DOUBLE) AS freq, count(*) AS n_docs FROM n GROUP BY 1")
def cooc_nodes(spark, folder):
    return cooccurrence.doc_nodes(documents(spark, folder), mentions(spark, folder)).groupBy("node").agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("n_docs"))


@query("SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) AS ts FROM orders WHERE o_orderpriority = '1-URGENT'")
def scan_filtered(spark, folder):
    d = cooccurrence.documents_of(table(spark, folder, "orders"), "o_orderkey", "o_orderdate", o_orderpriority="1-URGENT")
    return d.select("doc_id", "ts")


def _raw(spark, folder):
    """Raw co-occurrences: an order of a day is an article, its lines' parts and suppliers the ends."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(cooccurrence.as_milliseconds(F.col("o_orderdate")).alias("ts"), F.col("o_orderkey").alias("article"), F.col("l_suppkey").alias("id1"), (F.col("l_partkey") % 100).alias("id2"), F.col("l_linenumber").alias("dist"))


RAW = """WITH r AS (SELECT epoch_ms(o_orderdate) AS ts, o_orderkey AS article, l_suppkey AS source, l_partkey % 100 AS target, exp(CAST(-l_linenumber AS DOUBLE)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT ts, article, source, target, {a} AS weight FROM r GROUP BY 1, 2, 3, 4) """
RAW_OUT = "SELECT ts, source, target, round(sum(weight), 6) AS weight FROM p GROUP BY 1, 2, 3"


@query(RAW.format(a="sum(w)") + RAW_OUT)
def edgelist_sum_variant(spark, folder):
    return r6(cooccurrence.edge_variants(_raw(spark, folder), "sum"))


@query(RAW.format(a="avg(w)") + RAW_OUT)
def edgelist_mean_variant(spark, folder):
    return r6(cooccurrence.edge_variants(_raw(spark, folder), "mean"))


@query(RAW.format(a="max(w)") + RAW_OUT)
def edgelist_max_variant(spark, folder):
    return r6(cooccurrence.edge_variants(_raw(spark, folder), "max"))


@query(RAW.format(a="sum(w)") + ", q AS (SELECT *, sum(weight) OVER (PARTITION BY ts, article) AS t FROM p) SELECT ts, source, target, round(sum(weight / t), 6) AS weight FROM q GROUP BY 1, 2, 3")
def edgelist_norm_variant(spark, folder):
    return r6(cooccurrence.edge_variants(_raw(spark, folder), "norm"))


@query("""WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, row_number() OVER (ORDER BY k) - 1 AS node FROM f""")
def entity_dense_ids(spark, folder):
    return cooccurrence.dense_entities(table(spark, folder, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", "node")


@query("""WITH m AS (SELECT max(extracttime) AS t FROM article_processed), f AS (SELECT a.*, row_number() OVER (PARTITION BY a.url ORDER BY a.extracttime, a.extract_id) AS i
  FROM article_extract a, m WHERE a.extracttime >= m.t AND a.url NOT IN (SELECT url FROM article_processed)) SELECT url, extract_id, epoch_ms(extracttime) AS extract_ms FROM f WHERE i = 1""")
def news_increment(spark, folder):
    f = news.new_articles(table(spark, folder, "article_extract").select("url", "extracttime", "extract_id"), table(spark, folder, "article_processed").select("url", "extracttime"))
    return f.select("url", "extract_id", F.unix_millis("extracttime").alias("extract_ms"))


@query("""WITH t AS (SELECT article_id, regexp_replace(regexp_replace(publishing_date, 'Z$', '+0000'), '([-+]\\d{2}):?(\\d{2})(?:\\[.*\\])?$', '\\1\\2') AS s FROM article_processed)
SELECT article_id, CASE WHEN regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN epoch_ms(CAST(s AS TIMESTAMP))
  WHEN regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,6})?[-+]\\d{4}') THEN epoch_us(CAST(substr(s, 1, length(s) - 5) AS TIMESTAMP)) // 1000
   - (CASE WHEN substr(s, length(s) - 4, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(s, length(s) - 3, 2) AS BIGINT) * 60 + CAST(substr(s, length(s) - 1, 2) AS BIGINT)) * 60000 END AS ms FROM t""")
def news_dates(spark, folder):
    a = table(spark, folder, "article_processed")
    return a.select("article_id", F.unix_millis(publishing_date(F.col("publishing_date"), F.lit(None).cast("timestamp"))).alias("ms"))


# ---- range aggregations ----------------------------------------------------------
@query(BASE + EDGE_OUT + f"(SELECT source, target, sum(weight) AS weight FROM e WHERE {between(YEAR)} GROUP BY 1, 2)")
def sum_edges_range(spark, folder):
    return r6(network(spark, folder).sum_edges(*YEAR).df)


@query(BASE + EDGE_OUT + f"(SELECT source, target, sum(weight) AS weight FROM e WHERE {between(YEAR)} GROUP BY 1, 2) WHERE weight > 0.5")
def sum_edges_eps(spark, folder):
    return r6(network(spark, folder).sum_edges(*YEAR, eps=0.5).df)


@query(BASE + f"SELECT node, CAST(sum(freq) AS DOUBLE) AS weight FROM n WHERE {between(YEAR)} GROUP BY 1")
def sum_nodes(spark, folder):
    return network(spark, folder).sum_nodes(*YEAR).df


@query(BASE + f"SELECT node, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT source AS node FROM e WHERE {between(YEAR)} UNION ALL SELECT target FROM e WHERE {between(YEAR)}) GROUP BY 1")
def sum_nodes_of_edges(spark, folder):
    return timeline.sum_nodes(network(spark, folder).edges, None, *YEAR)


LOG_BETA = -1.0 / (30 * DAY)


@query(BASE + f"SELECT source, target, round(sum(weight * exp({LOG_BETA!r} * ({JAN[1]} - ts))), 6) AS weight FROM e WHERE {between(JAN)} GROUP BY 1, 2")
def sum_edges_exp(spark, folder):
    return r6(network(spark, folder).sum_edges_exp(*JAN, log_beta=LOG_BETA).df)


@query(BASE + f"SELECT source, target, round(1e9 * sum(weight * {-math.expm1(LOG_BETA)!r} * exp({LOG_BETA!r} * ({YEAR[1]} - ts))), 6) AS weight FROM e WHERE {between(YEAR)} GROUP BY 1, 2")
def sum_edges_exp_norm(spark, folder):
    """A mean over milliseconds is small: shown in billionths."""
    return r6(g.scale(network(spark, folder).sum_edges_exp_norm(*YEAR, log_beta=LOG_BETA).df, 1e9))


@query(BASE + f"SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM e WHERE {between(YEAR)} GROUP BY 1, 2")
def count_edges(spark, folder):
    return network(spark, folder).count_edges(*YEAR).df


@query(BASE + f"SELECT node, CAST(count(*) AS DOUBLE) AS weight FROM n WHERE {between(YEAR)} GROUP BY 1")
def count_nodes(spark, folder):
    return network(spark, folder).count_nodes(*YEAR).df


@query(BASE + f"SELECT node, CAST(count(DISTINCT doc) AS DOUBLE) AS weight FROM (SELECT doc, source AS node FROM e WHERE {between(YEAR)} UNION ALL SELECT doc, target FROM e WHERE {between(YEAR)}) GROUP BY 1")
def count_nodes_of_edges(spark, folder):
    return timeline.count_nodes(network(spark, folder).edges, None, *YEAR)


@query(f"SELECT count(*) AS n FROM orders WHERE epoch_ms(o_orderdate) BETWEEN {YEAR[0]} AND {YEAR[1]}")
def count_graphs(spark, folder):
    return timeline.count_graphs(network(spark, folder).within_time(*YEAR).documents, *YEAR)


@query("SELECT epoch_ms(date_trunc('month', o_orderdate)) AS win_min, count(*) AS n FROM orders GROUP BY 1")
def count_graphs_monthly(spark, folder):
    return documents(spark, folder).groupBy(timeline.calendar_start(F.col("ts"), "M").alias("win_min")).agg(F.count(F.lit(1)).alias("n"))


TOPICS = """, se AS (SELECT source, target, sum(weight) AS s, CAST(count(*) AS DOUBLE) AS d {more} FROM e WHERE {r} GROUP BY 1, 2),
c AS (SELECT node, CAST(count(*) AS DOUBLE) AS c FROM n WHERE {r} GROUP BY 1) """
TOPIC_OUT = "SELECT source, target, round({score}, 6) AS weight FROM se JOIN c x ON x.node = source JOIN c y ON y.node = target"


@query(BASE + TOPICS.format(more="", r=between(YEAR)) + TOPIC_OUT.format(score="2.0 / ((x.c + y.c - d) / d + d / s)"))
def topics(spark, folder):
    return r6(network(spark, folder).topics(*YEAR).df)


#: Windows of 30 days from the fifth day of 1970 on that touch 1995 (days 9131 to 9495): those with numbers 304 to 316.
WINDOWS = 13
OFF = 432_000_000


@query(BASE + TOPICS.format(more=f", CAST(count(DISTINCT ts - (ts - {OFF}) % {MONTH}) AS DOUBLE) AS t", r=between(YEAR)) + TOPIC_OUT.format(score=f"3.0 / ((x.c + y.c - d) / d + d / s + {WINDOWS}.0 / t)"))
def topics_samples(spark, folder):
    return r6(network(spark, folder).topics(*YEAR, step=MONTH, offset=5 * DAY).df)


@query(BASE + f"SELECT source, target, round(sum(weight * (ts - {JAN[0]}) / {float(DAY)}), 6) AS weight FROM e WHERE {between(JAN)} AND ts <> {JAN[0]} GROUP BY 1, 2")
def extract_linear_weight(spark, folder):
    t = network(spark, folder)
    return r6(t.extract(lambda ts: F.when(ts.between(*JAN), (ts - JAN[0]) / F.lit(float(DAY))).otherwise(0.0)).df)


@query(BASE + "SELECT epoch_ms(date_trunc('month', make_timestamp(ts * 1000))) AS ts, source, target, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2, 3")
def compress_month(spark, folder):
    return r6(timeline.compress(network(spark, folder).edges, lambda ts: timeline.calendar_start(ts, "M")))


@query(BASE + f"SELECT ts - (ts - {OFF}) % {MONTH} AS ts, source, target, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2, 3")
def compress_offset_step(spark, folder):
    return r6(network(spark, folder).compress(MONTH, 5 * DAY).edges.select("ts", "source", "target", "weight"))


HOPS = timeline.hopping(*ALL, width=(ALL[1] - ALL[0]) // 3, steps=STEPS)


def _hops_sql(steps: int) -> str:
    """Windows of a third of all time, evenly spread, by arithmetic in SQL."""
    return f"""w AS (SELECT CAST(i AS INT) AS step, CAST(trunc(lo + (hi - width + 1 - lo) * i / {float(steps - 1)}) AS BIGINT) AS lo, CAST(trunc(lo + (hi - width + 1 - lo) * i / {float(steps - 1)}) AS BIGINT) + width - 1 AS hi
  FROM range({steps}) r(i), (SELECT CAST({ALL[0]} AS BIGINT) AS lo, CAST({ALL[1]} AS BIGINT) AS hi, CAST(({ALL[1]} - {ALL[0]}) // 3 AS BIGINT) AS width)), """


HOP_SQL = _hops_sql(STEPS)
SAMPLED = BASE + ", " + HOP_SQL + "se AS (SELECT step, source, target, sum(weight) AS s, CAST(count(*) AS DOUBLE) AS d FROM e JOIN w ON ts BETWEEN lo AND hi GROUP BY 1, 2, 3)"


def _sampled(spark, folder, method="sum_edges"):
    t = network(spark, folder)
    return timeline.sample_graphs(t.edges, HOPS, method, t.doc_nodes)


@query(SAMPLED + " SELECT step, source, target, round(s, 6) AS weight FROM se")
def sample_graphs_sum(spark, folder):
    return r6(_sampled(spark, folder))


@query(SAMPLED + " SELECT step, source, target, d AS weight FROM se")
def sample_graphs_count(spark, folder):
    return _sampled(spark, folder, "count_edges")


@query(SAMPLED + """, c AS (SELECT step, node, CAST(count(*) AS DOUBLE) AS c FROM n JOIN w ON ts BETWEEN lo AND hi GROUP BY 1, 2)
SELECT se.step, source, target, round(2.0 / ((x.c + y.c - d) / d + d / s), 6) AS weight FROM se JOIN c x ON x.node = source AND x.step = se.step JOIN c y ON y.node = target AND y.step = se.step""")
def sample_graphs_topics(spark, folder):
    return r6(_sampled(spark, folder, "topics"))


# ---- lookups -----------------------------------------------------------------------
AT = 850_000_000_000


@query(f"""WITH d AS (SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) AS ts FROM orders),
ge AS (SELECT * FROM d WHERE ts >= {AT} ORDER BY ts, doc_id LIMIT 1), le AS (SELECT * FROM d WHERE ts <= {AT} ORDER BY ts DESC, doc_id DESC LIMIT 1)
SELECT 'ge' AS kind, * FROM ge UNION ALL SELECT 'le', * FROM le UNION ALL SELECT 'near', * FROM (SELECT * FROM (SELECT * FROM ge UNION ALL SELECT * FROM le) ORDER BY abs(ts - {AT}), ts DESC LIMIT 1)""")
def lookup_ge_le_near(spark, folder):
    d = documents(spark, folder).select("doc_id", "ts")
    parts = [f(d, AT).select(F.lit(k).alias("kind"), "doc_id", "ts") for k, f in (("ge", lookup.at_or_after), ("le", lookup.at_or_before), ("near", lookup.nearest))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) AS ts, lag(o_orderkey) OVER w AS prev_doc, lead(o_orderkey) OVER w AS next_doc FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def doc_next_prev(spark, folder):
    return lookup.neighbours_in_time(documents(spark, folder))


@query(f"SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) AS ts FROM orders WHERE epoch_ms(o_orderdate) BETWEEN {JAN[0]} AND {JAN[1]} ORDER BY 2, 1 LIMIT 50")
def documents_range_limit(spark, folder):
    return lookup.listing(documents(spark, folder), *JAN, limit=50).select("doc_id", "ts")


@query(f"SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) AS ts FROM orders WHERE epoch_ms(o_orderdate) > {AT} OR (epoch_ms(o_orderdate) = {AT} AND o_orderkey > 100) ORDER BY 2, 1 LIMIT 256")
def documents_page(spark, folder):
    return lookup.page(documents(spark, folder), AT, 100, "next").select("doc_id", "ts")


@query("""SELECT o_orderkey AS doc_id, epoch_ms(o_orderdate) AS ts FROM orders WHERE (epoch_ms(o_orderdate) > 850000000000 AND epoch_ms(o_orderdate) <= 860000000000) OR o_orderkey < 20""")
def documents_by_filter(spark, folder):
    q = {"$or": [{"time": {"$gt": 850_000_000_000, "$lte": 860_000_000_000}}, {"id": {"$lt": 20}}]}
    return documents(spark, folder).where(filters.condition(q, {"time": "ts", "id": "doc_id"})).select("doc_id", "ts")


@query("SELECT o_orderkey AS doc_id, lower(lpad(to_hex(o_custkey), 8, '0') || lpad(to_hex(o_orderkey), 16, '0')) AS ext_id FROM orders")
def object_ids(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), ids.oid_text(F.col("o_custkey"), F.col("o_orderkey")).alias("ext_id"))


# ---- one graph -----------------------------------------------------------------------
@query(BASE + "SELECT CAST(count(*) AS BIGINT) AS num_edges, round(sum(weight), 6) AS total, (SELECT count(*) FROM deg) AS num_nodes FROM g")
def graph_counts(spark, folder):
    j = whole(spark, folder)
    ends = g.nodes(j).agg(F.count(F.lit(1)).alias("num_nodes"))
    return j.agg(F.count(F.lit(1)).alias("num_edges"), F.round(F.sum("weight"), 6).alias("total")).withColumn("num_nodes", F.lit(ends.first()[0]))


@query(BASE + "SELECT round(coalesce(sum(weight), 0), 6) AS weight, count(*) > 0 AS present FROM g WHERE source = 1 AND target = 2")
def get_edge(spark, folder):
    return r6(g.weight_of(whole(spark, folder), source=1, target=2))


@query(BASE + "SELECT target AS node, round(weight, 6) AS weight FROM b WHERE source = 5")
def adjacent_edges(spark, folder):
    return r6(g.neighbours(whole(spark, folder), 5))


@query(BASE + "SELECT node, CAST(dg AS DOUBLE) AS weight FROM deg")
def in_out_degrees(spark, folder):
    return g.degrees(whole(spark, folder))


@query(BASE + "SELECT node, round(ow, 6) AS weight FROM deg")
def in_out_weights(spark, folder):
    return r6(g.degrees(whole(spark, folder), weighted=True))


@query(BASE + "SELECT source AS node, 'out' AS kind, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY 1 UNION ALL SELECT target, 'in', count(*) FROM g GROUP BY 1")
def directed_degrees(spark, folder):
    j = whole(spark, folder)
    return g.degrees(j, True).withColumn("kind", F.lit("out")).unionByName(g.degrees(j, True, incoming=True).withColumn("kind", F.lit("in")))


@query(BASE + "SELECT node, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT source AS node FROM g UNION ALL SELECT target FROM g) GROUP BY 1")
def graph_nodes(spark, folder):
    return g.nodes(whole(spark, folder))


@query(BASE + "SELECT b.source AS node, round(any_value(o.dg) - CAST(sum(p.dg) AS DOUBLE) / any_value(o.dg), 6) AS weight FROM b JOIN deg o ON o.node = b.source JOIN deg p ON p.node = b.target GROUP BY 1")
def degree_anomalies(spark, folder):
    return r6(g.anomalies(whole(spark, folder)))


@query(BASE + "SELECT b.source AS node, round(any_value(o.ow) - sum(b.weight * p.ow) / any_value(o.ow), 6) AS weight FROM b JOIN deg o ON o.node = b.source JOIN deg p ON p.node = b.target GROUP BY 1")
def weight_anomalies(spark, folder):
    return r6(g.anomalies(whole(spark, folder), weighted=True))


@query(BASE + "SELECT source, target, round(weight / (x.ow * y.ow), 6) AS weight FROM g JOIN deg x ON x.node = source JOIN deg y ON y.node = target")
def normalize(spark, folder):
    return r6(g.normalized(whole(spark, folder)))


@query(BASE + "SELECT source, target, round(weight, 6) AS weight FROM g WHERE source IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) AND target IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def filter_nodes(spark, folder):
    chosen = table(spark, folder, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("node"))
    return r6(g.within(whole(spark, folder), chosen))


@query(BASE + "SELECT source, target, round(weight, 6) AS weight FROM g WHERE weight > 0.3")
def del_small(spark, folder):
    return r6(g.without_small(whole(spark, folder), 0.3, positive=True))


#: Two graphs: all documents before 1998, and all from then on.
SPLIT = 883_612_800_000
TWO = BASE.replace("sum(weight) AS weight FROM e GROUP BY 1, 2),\nb AS", f"sum(weight) AS weight FROM e WHERE ts < {SPLIT} GROUP BY 1, 2),\nb AS") + f", h AS (SELECT source, target, sum(weight) AS weight FROM e WHERE ts >= {SPLIT} GROUP BY 1, 2) "


def _before(spark, folder):
    return network(spark, folder).sum_edges(None, SPLIT - 1).df


def _next(spark, folder):
    return network(spark, folder).sum_edges(SPLIT).df


@query(TWO + "SELECT source, target, round(sum(weight), 6) AS weight FROM (SELECT * FROM g UNION ALL SELECT source, target, 0.5 * weight FROM h) GROUP BY 1, 2")
def add_graph_scaled(spark, folder):
    return r6(g.combine(_before(spark, folder), _next(spark, folder), g.EDGE, 0.5))


@query(TWO + "SELECT source, target, round(sum(weight), 6) AS weight FROM (SELECT * FROM g UNION ALL SELECT source, target, -weight FROM h) GROUP BY 1, 2")
def sub_graph(spark, folder):
    return r6(g.combine(_before(spark, folder), _next(spark, folder), g.EDGE, -1.0))


@query(TWO + "SELECT source, target, round(weight * 3, 6) AS weight FROM g")
def mul_const(spark, folder):
    return r6(g.scale(_before(spark, folder), 3.0))


@query(TWO + "SELECT g.source, g.target, round(g.weight, 6) AS weight FROM g ANTI JOIN h ON g.source = h.source AND g.target = h.target")
def del_edges(spark, folder):
    return r6(g.delete(_before(spark, folder), _next(spark, folder), g.EDGE))


@query(TWO + "SELECT source, target, round(coalesce(h.weight, g.weight), 6) AS weight FROM g FULL JOIN h USING (source, target)")
def set_edges(spark, folder):
    return r6(g.set_entries(_before(spark, folder), _next(spark, folder).withColumn("o", F.lit(1)), g.EDGE, "o"))


VEC = TWO + ", v AS (SELECT node, sum(w) AS x FROM (SELECT source AS node, weight AS w FROM g UNION ALL SELECT target, weight FROM g) GROUP BY 1), u AS (SELECT node, sum(w) AS x FROM (SELECT source AS node, weight AS w FROM h UNION ALL SELECT target, weight FROM h) GROUP BY 1) "


def _vectors(spark, folder):
    return g.degrees(_before(spark, folder), weighted=True), g.degrees(_next(spark, folder), weighted=True)


@query(VEC + "SELECT node, round(coalesce(v.x, 0) + 2 * coalesce(u.x, 0), 6) AS weight FROM v FULL JOIN u USING (node)")
def vector_axpy(spark, folder):
    a, b = _vectors(spark, folder)
    return r6(g.combine(a, b, g.NODE, 2.0))


@query(VEC + "SELECT round((SELECT sum(v.x * u.x) FROM v JOIN u USING (node)), 6) AS dot, round((SELECT sqrt(sum(x * x)) FROM v), 6) AS norm")
def vector_dot_norm(spark, folder):
    a, b = _vectors(spark, folder)
    return r6(g.dot(a, b).withColumn("norm", F.lit(g.norm(a).first()[0])), "dot", "norm")


@query(VEC + "SELECT round(sqrt(sum((coalesce(v.x, 0) - coalesce(u.x, 0)) ** 2)), 6) AS distance FROM v FULL JOIN u USING (node)")
def vector_sub_norm(spark, folder):
    return r6(g.distance(*_vectors(spark, folder)), "distance")


@query(VEC + "SELECT b.source AS node, round(sum(b.weight * u.x), 6) AS weight FROM b JOIN u ON u.node = b.target GROUP BY 1")
def spmv(spark, folder):
    return r6(g.multiply(_before(spark, folder), _vectors(spark, folder)[1]))


@query(BASE + "SELECT source, target, round(weight, 6) AS weight FROM (SELECT *, rank() OVER (ORDER BY weight DESC) AS r FROM (SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2)) WHERE r <= 20")
def top_edges_ties(spark, folder):
    return r6(g.top_edges(network(spark, folder).count_edges().df, 20))


@query(BASE + "SELECT source, target, weight FROM (SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2) ORDER BY weight DESC, source, target LIMIT 20")
def top_edges_truncate(spark, folder):
    return g.top_edges(network(spark, folder).count_edges().df, 20, True)


SPARSE = """, bb AS (SELECT source AS s, target AS t, weight AS w FROM q WHERE source <> target UNION ALL SELECT target, source, weight FROM q WHERE source <> target),
 sd AS (SELECT source AS s, target AS t, weight AS w, row_number() OVER (ORDER BY weight DESC, source, target) AS ord FROM (SELECT *, rank() OVER (ORDER BY weight DESC) AS r FROM q WHERE source <> target) x WHERE r <= 8),
 sb AS (SELECT s, t, ord FROM sd UNION ALL SELECT t, s, ord FROM sd),
 tri AS (SELECT sd.s AS i, sd.t AS j, sd.ord, x.t AS k, x.w AS wi, y.w AS wj FROM sd JOIN bb x ON x.s = sd.s JOIN bb y ON y.s = sd.t AND y.t = x.t
   LEFT JOIN sb p ON p.s = sd.s AND p.t = x.t AND p.ord < sd.ord LEFT JOIN sb q2 ON q2.s = sd.t AND q2.t = x.t AND q2.ord < sd.ord WHERE p.ord IS NULL AND q2.ord IS NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY least(wi, wj) DESC, k) AS rn FROM tri),
 oo AS (SELECT s, t, w FROM sd UNION ALL SELECT i, k, wi FROM r WHERE rn <= 3 UNION ALL SELECT j, k, wj FROM r WHERE rn <= 3)
SELECT DISTINCT least(s, t) AS source, greatest(s, t) AS target, round(w, 6) AS weight FROM oo"""


@query(BASE + ", q AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2)" + SPARSE)
def sparse_subgraph(spark, folder):
    return r6(network(spark, folder).count_edges().sparse_subgraph().df)


def _parts_whole(spark, folder):
    return network(spark, folder, entity="l_partkey").sum_edges().df


PARTS = base("l_partkey")
ROOT = "(SELECT min(source) AS n FROM g)"


def _root(j: DataFrame) -> DataFrame:
    return j.agg(F.min("source").alias("node")).where("node is not null")


RPARTS = PARTS.replace("WITH o AS", "WITH RECURSIVE o AS")


@query(RPARTS + f""", near AS (SELECT n AS node, 0 AS c FROM {ROOT} UNION SELECT b.target, near.c + 1 FROM near JOIN b ON b.source = near.node WHERE near.c < 20)
SELECT node, CAST(min(c) AS BIGINT) AS hops FROM near GROUP BY 1""")
def bfs_count(spark, folder):
    """Hops from the least part to each it reaches; no way of the graph has 20."""
    j = _parts_whole(spark, folder)
    return traversal.paths(j, _root(j)).select("node", F.col("count").alias("hops"))


@query(RPARTS + f""", near AS (SELECT n AS node, 0 AS c, CAST(NULL AS BIGINT) AS parent FROM {ROOT} UNION SELECT b.target, near.c + 1, near.node FROM near JOIN b ON b.source = near.node WHERE near.c < 4),
best AS (SELECT node, min(c) AS c FROM near GROUP BY 1), p AS (SELECT near.node, best.c, min(parent) AS parent FROM near JOIN best ON best.node = near.node AND best.c = near.c GROUP BY 1, 2)
SELECT node, CAST(c AS BIGINT) AS hops, parent, row_number() OVER (ORDER BY c, parent NULLS FIRST, node) - 1 AS pos FROM p""")
def bfs_order(spark, folder):
    """Order in which a search up to 4 hops finds the parts."""
    j = _parts_whole(spark, folder)
    return traversal.visit_order(traversal.paths(j, _root(j), limit=4)).select("node", F.col("count").alias("hops"), "parent", "pos")


@query()
def distance_weight(spark, folder):
    """Least weight of a way from the least part to each; compared with a search by a heap in the tests."""
    j = _parts_whole(spark, folder)
    return r6(traversal.paths(j, _root(j), weighted=True).select("node", "weight"))


def _squares_sql(k: int) -> str:
    """Distances of all pairs after ``k`` squarings of the matrix of weights: ways of up to 2 ** k edges."""
    out = ["d0 AS (SELECT source, target, min(weight) AS w FROM b GROUP BY 1, 2)"]
    out += [f"d{i} AS (SELECT source, target, min(w) AS w FROM (SELECT * FROM d{i - 1} UNION ALL SELECT x.source, y.target, x.w + y.w FROM d{i - 1} x JOIN d{i - 1} y ON y.source = x.target WHERE x.source <> y.target) GROUP BY 1, 2)" for i in range(1, k + 1)]
    return ", " + ", ".join(out)


@query(BASE + _squares_sql(5) + " SELECT source, target, round(w, 6) AS weight FROM d5 WHERE source <> target")
def all_distances_weight(spark, folder):
    """Distances by weight between all pairs of suppliers."""
    return r6(traversal.distance_graph(whole(spark, folder), weighted=True))


@query(BASE + _squares_sql(5) + " SELECT round(w, 6) AS weight FROM d5 WHERE source = 1 AND target = 7")
def distance_pair(spark, folder):
    d = traversal.distance(whole(spark, folder), 1, 7, weighted=True)
    return r6(spark.createDataFrame([(d,)], "weight double"))


@query()
def connected_components(spark, folder):
    return traversal.components(_parts_whole(spark, folder))


def _steps_sql(k: int, by: str = "") -> str:
    on = f" AND v.{by} = dd.{by}" if by else ""
    b = f"{by}, " if by else ""
    out = [f"v0 AS (SELECT DISTINCT {b}target AS n, CAST(1 AS DOUBLE) AS x FROM dd)"]
    out += [f"v{i} AS (SELECT {'dd.' + b if by else ''}dd.source AS n, sum(dd.weight * v.x) AS x FROM dd JOIN v{i - 1} v ON v.n = dd.target{on} GROUP BY ALL)" for i in range(1, k + 1)]
    return ", ".join(out)


@query(BASE + ", dd AS (SELECT * FROM b), " + _steps_sql(5) + " SELECT n AS node, round(x / sqrt(sum(x * x) OVER ()), 6) AS weight FROM v5")
def power_iteration_k5(spark, folder):
    return r6(traversal.power_iteration(whole(spark, folder), iterations=5)[0])


@query(BASE + ", dd AS (SELECT * FROM b), " + _steps_sql(40) + " SELECT n AS node, round(x / sqrt(sum(x * x) OVER ()), 6) AS weight FROM v40")
def power_iteration_tolerance(spark, folder):
    """Until a step moves the vector by 1e-10 or less."""
    return r6(traversal.power_iteration(whole(spark, folder), iterations=1000, tolerance=1e-10)[0])


@query(BASE + ", dd AS (SELECT * FROM b), " + _steps_sql(6) + " SELECT round((SELECT sum(a.x * c.x) FROM v6 a JOIN v5 c USING (n)) / (SELECT sum(x * x) FROM v5), 6) AS eigenvalue")
def eigenvalue_k5(spark, folder):
    _, value = traversal.power_iteration(whole(spark, folder), iterations=5)
    return spark.createDataFrame([(round(value, 6),)], "eigenvalue double")


def _warm_sql(windows: int, k: int) -> str:
    """Vectors n0, n1 ... of the windows after ``k`` steps each; a window starts from the vector before where that isn't 0, else from 1."""
    out = []
    for i in range(windows):
        out.append(f"e{i} AS (SELECT source, target, weight FROM dd WHERE step = {i})")
        known = f"LEFT JOIN n{i - 1} q ON q.n = t.n AND q.x <> 0" if i else ""
        out.append(f"s{i}_0 AS (SELECT t.n, {'coalesce(q.x, 1)' if i else 'CAST(1 AS DOUBLE)'} AS x FROM (SELECT DISTINCT target AS n FROM e{i}) t {known})")
        out += [f"s{i}_{j} AS (SELECT e.source AS n, sum(e.weight * v.x) AS x FROM e{i} e JOIN s{i}_{j - 1} v ON v.n = e.target GROUP BY 1)" for j in range(1, k + 1)]
        out.append(f"n{i} AS (SELECT n, x / sqrt(sum(x * x) OVER ()) AS x FROM s{i}_{k})")
    return ", ".join(out)


BOTH_WAYS = ", dd AS (SELECT step, source, target, s AS weight FROM se UNION ALL SELECT step, target, source, s FROM se), "


@query(SAMPLED + BOTH_WAYS + _warm_sql(STEPS, 3) + " " + " UNION ALL ".join(f"SELECT {i} AS step, n AS node, round(x, 6) AS weight FROM n{i}" for i in range(STEPS)))
def sample_eigenvectors(spark, folder):
    """Three steps for each window, started from the window before."""
    return r6(network(spark, folder).sample_eigenvectors(*ALL, width=(ALL[1] - ALL[0]) // 3, steps=STEPS, iterations=3))


# ---- metrics across snapshots ------------------------------------------------------------
COUNTS = SAMPLED.replace("se AS (SELECT", "cnt AS (SELECT") + """, keys AS (SELECT DISTINCT source, target FROM cnt),
z AS (SELECT k.source, k.target, CAST(s.step AS INT) AS step, coalesce(c.d, 0) AS x FROM keys k CROSS JOIN (SELECT DISTINCT step FROM w) s LEFT JOIN cnt c ON c.source = k.source AND c.target = k.target AND c.step = s.step) """
KEY = "SELECT source, target, "


def _counts(spark, folder):
    return _sampled(spark, folder, "count_edges")


@query(COUNTS + KEY + "round(avg(x), 6) AS weight FROM z GROUP BY 1, 2")
def metric_avg(spark, folder):
    return r6(metrics.average(_counts(spark, folder), g.EDGE, STEPS))


@query(COUNTS + KEY + "round(stddev_samp(x), 6) AS weight FROM z GROUP BY 1, 2")
def metric_std(spark, folder):
    return r6(metrics.deviation(_counts(spark, folder), g.EDGE, STEPS))


@query(COUNTS + KEY + "round(regr_slope(x, step), 6) AS weight FROM z GROUP BY 1, 2")
def metric_trend(spark, folder):
    return r6(metrics.trend(_counts(spark, folder), g.EDGE, STEPS))


@query(COUNTS + KEY + "CASE WHEN max(x) > min(x) THEN round(abs(avg(x)) / stddev_pop(x), 6) ELSE CAST('inf' AS DOUBLE) END AS weight FROM z GROUP BY 1, 2")
def metric_stability_ratio(spark, folder):
    m = metrics.stability_ratio(_counts(spark, folder), g.EDGE, STEPS)
    return m.withColumn("weight", F.when(F.col("weight") < F.lit(float("inf")), F.round("weight", 6)).otherwise(F.col("weight")))


def _entropy_sql(src: str, part: str, cols: list[str]) -> str:
    p = f"PARTITION BY {part}" if part else ""
    lim = ", ".join(f"min({c}) OVER ({p}) AS lo_{c}, max({c}) OVER ({p}) AS hi_{c}" for c in cols)
    cb = ", ".join(f"least(9, floor(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0) * 10)) AS b{i}" for i, c in enumerate(cols))
    lb = ", ".join(f"greatest(0, ceil(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0) * 10) - 1) AS b{i}" for i, c in enumerate(cols))
    keys = ", ".join([*([part] if part else []), *[f"b{i}" for i in range(len(cols))]])
    part_ = f"{part}, " if part else ""
    return f""", y AS (SELECT *, {lim}, count(*) OVER ({p}) AS n FROM {src}), cb AS (SELECT {part_}n, {cb} FROM y), h AS (SELECT {keys}, count(*) * 1.0 / any_value(n) AS p FROM cb GROUP BY ALL),
lb AS (SELECT source, target, {part_}{lb} FROM y)
SELECT source, target, round(sum(coalesce(-p * ln(p), 0)), 6) AS weight FROM lb LEFT JOIN h USING ({keys}) GROUP BY 1, 2"""


@query(COUNTS + _entropy_sql("z", "", ["x"]))
def metric_entropy(spark, folder):
    return r6(metrics.entropy(_counts(spark, folder), g.EDGE, STEPS, 10))


@query(COUNTS + _entropy_sql("z", "step", ["x"]))
def metric_entropy_local(spark, folder):
    return r6(metrics.entropy_local(_counts(spark, folder), g.EDGE, STEPS, 10))


@query(COUNTS + ", zz AS (SELECT *, lead(x) OVER (PARTITION BY source, target ORDER BY step) AS nx FROM z), z2 AS (SELECT * FROM zz WHERE nx IS NOT NULL) " + _entropy_sql("z2", "", ["x", "nx"]))
def metric_entropy_2d(spark, folder):
    return r6(metrics.entropy_2d(_counts(spark, folder), g.EDGE, STEPS, 10))


def _fronts_sql(src: str, out: str, keys: str = "source, target") -> str:
    """All fronts of ``src`` (keys, x, y), where less is better, peeled off one after the other; ``out`` uses k, the front."""
    return f""", peel AS (SELECT {keys}, x, y, CAST(1 AS BIGINT) AS k, y = min(y) OVER (PARTITION BY x) AND coalesce(y < min(y) OVER (ORDER BY x GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS o FROM {src}
  UNION ALL SELECT {keys}, x, y, k + 1, y = min(y) OVER (PARTITION BY x) AND coalesce(y < min(y) OVER (ORDER BY x GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) FROM peel WHERE NOT o),
fronts AS (SELECT {keys}, {out} AS weight FROM peel WHERE o) """


PARETO_IN = COUNTS.replace("WITH o AS", "WITH RECURSIVE o AS") + ", pt AS (SELECT source, target, -round(avg(x), 9) AS x, round(stddev_samp(x), 9) AS y FROM z GROUP BY 1, 2)"


@query(PARETO_IN + _fronts_sql("pt", "CAST(k AS DOUBLE)") + "SELECT * FROM fronts")
def metric_pareto(spark, folder):
    c = _counts(spark, folder)
    m = metrics.average(c, g.EDGE, STEPS).withColumnRenamed("weight", "a").join(metrics.deviation(c, g.EDGE, STEPS).withColumnRenamed("weight", "b"), g.EDGE)
    return metrics.pareto(r9(m, "a", "b"), g.EDGE, "a", "b", True, False)


def r9(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(PARETO_IN + _fronts_sql("pt", "CAST(0.5 AS DOUBLE) ** (k - 1)") + "SELECT * FROM fronts")
def metric_stability_pareto(spark, folder):
    return metrics.stability_pareto(_counts(spark, folder), g.EDGE, STEPS, 0.5)


# ---- composites ---------------------------------------------------------------------------
@query(BASE + """, q AS (SELECT epoch_ms(date_trunc('month', make_timestamp(ts * 1000))) AS win_min, source, target, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2, 3)
SELECT win_min, source, target, weight FROM (SELECT *, rank() OVER (PARTITION BY win_min ORDER BY weight DESC) AS r FROM q) WHERE r <= 10""")
def calendar_ranges_importance(spark, folder):
    """The ten most frequent edges of each month, with ties."""
    from pyspark.sql import Window

    e = network(spark, folder).edges
    q = e.groupBy(timeline.calendar_start(F.col("ts"), "M").alias("win_min"), "source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return q.withColumn("r", F.rank().over(Window.partitionBy("win_min").orderBy(F.desc("weight")))).where("r <= 10").drop("r")


@query(BASE + """, t AS (SELECT source, target FROM (SELECT source, target, count(*) AS c FROM e GROUP BY 1, 2) ORDER BY c DESC, source, target LIMIT 10)
SELECT epoch_ms(date_trunc('quarter', make_timestamp(ts * 1000))) AS win_min, source, target, round(sum(weight), 6) AS weight FROM e JOIN t USING (source, target) GROUP BY 1, 2, 3""")
def edge_time_series(spark, folder):
    """Weight per quarter of the ten most frequent edges."""
    t = network(spark, folder)
    top = t.count_edges().top_edges(10, truncate=True).df.select("source", "target")  # ten rows
    q = t.edges.join(F.broadcast(top), g.EDGE).groupBy(timeline.calendar_start(F.col("ts"), "q").alias("win_min"), *g.EDGE).agg(F.sum("weight").alias("weight"))
    return r6(q)


@query("""WITH r AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 3 MONTH)) AS a)
SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INT) AS step, greatest(epoch_ms(a), (SELECT min(epoch_ms(o_orderdate)) FROM orders)) AS win_min, least(epoch_ms(a + INTERVAL 3 MONTH) - 1, (SELECT max(epoch_ms(o_orderdate)) FROM orders)) AS win_max FROM r
WHERE epoch_ms(a) <= (SELECT max(epoch_ms(o_orderdate)) FROM orders)""")
def calendar_ranges_quarters(spark, folder):
    lo, hi = documents(spark, folder).agg(F.min("ts"), F.max("ts")).first()
    return timeline.calendar_ranges(spark, "1q", lo, hi)


def _dashboard(spark, folder) -> TemporalGraph:
    """The network of all time, as a store would have it."""
    t = network(spark, folder)
    edges = staged(timeline.during(t.edges, *ALL), "edges")
    return TemporalGraph(t.documents, edges, staged(t.doc_nodes, "doc-nodes"))


STABLE = BASE.replace("WITH o AS", "WITH RECURSIVE o AS") + ", " + _hops_sql(9) + """win AS (SELECT step, source, target, sum(weight) AS s FROM e JOIN w ON ts BETWEEN lo AND hi GROUP BY 1, 2, 3),
own AS (SELECT step, node, sum(s) AS o FROM (SELECT step, source AS node, s FROM win UNION ALL SELECT step, target, s FROM win) GROUP BY 1, 2),
nz AS (SELECT win.step, source, target, s / (x.o * y.o) AS d FROM win JOIN own x ON x.step = win.step AND x.node = source JOIN own y ON y.step = win.step AND y.node = target),
zz AS (SELECT k.source, k.target, coalesce(nz.d, 0) AS x FROM (SELECT DISTINCT source, target FROM nz) k CROSS JOIN w LEFT JOIN nz ON nz.source = k.source AND nz.target = k.target AND nz.step = w.step),
pt AS (SELECT source, target, -round(avg(x), 9) AS x, round(stddev_samp(x), 9) AS y FROM zz GROUP BY 1, 2)"""


@query(STABLE + _fronts_sql("pt", "CAST(0.5 AS DOUBLE) ** (k - 1)") + ", q AS (SELECT * FROM fronts)" + SPARSE.replace("round(w, 6)", "w"))
def dashboard_stable_edges(spark, folder):
    """Windows, each normalised; Pareto fronts of mean and deviation; then the sparse subgraph."""
    return dashboards.subgraph(_dashboard(spark, folder), "stable_edges", *ALL)[0]


@query()
def dashboard_stable_topics(spark, folder):
    """Topics that are high and steady are the seeds of the subgraph of topics."""
    return dashboards.subgraph(_dashboard(spark, folder), "stable_topics", *ALL)[0]


@query(BASE + TOPICS.format(more="", r=between(ALL)) + ", q AS (SELECT source, target, 2.0 / ((x.c + y.c - d) / d + d / s) AS weight FROM se JOIN c x ON x.node = source JOIN c y ON y.node = target)" + SPARSE)
def dashboard_topics(spark, folder):
    return r6(dashboards.subgraph(_dashboard(spark, folder), "topics", *ALL)[0])


@query(BASE + f""", y AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM e WHERE {between(ALL)} GROUP BY 1, 2), yb AS (SELECT source, weight FROM y UNION ALL SELECT target, weight FROM y),
yo AS (SELECT source AS node, sum(weight) AS o FROM yb GROUP BY 1), q AS (SELECT source, target, weight / (a.o * z.o) AS weight FROM y JOIN yo a ON a.node = source JOIN yo z ON z.node = target)""" + SPARSE.replace("round(w, 6)", "round(w, 9)"))
def dashboard_count_edges_norm(spark, folder):
    return dashboards.subgraph(_dashboard(spark, folder), "count_edges_norm", *ALL)[0].withColumn("weight", F.round("weight", 9))


@query()
def dashboard_stable_nodes(spark, folder):
    """Fronts of a high and steady place in the windows' eigenvectors."""
    return dashboards.node_sizes(_dashboard(spark, folder), "stable_nodes", *ALL)


@query()
def dashboard_trend_converged(spark, folder):
    """Trend of each node's place in the eigenvectors of nine windows, and its colour."""
    return dashboards.node_sizes(_dashboard(spark, folder), "trend", *ALL)


@query()
def dashboard_network_set(spark, folder):
    """JSON rows of a whole dashboard."""
    return dashboards.network_set(_dashboard(spark, folder), "topics", "eigenvector", *ALL)


@query(SAMPLED + ", dd AS (SELECT step, source, target, s AS weight FROM se UNION ALL SELECT step, target, source, s FROM se), " + _steps_sql(3, "step") + """, v AS (SELECT step, n AS node, x / sqrt(sum(x * x) OVER (PARTITION BY step)) AS x FROM v3)
, k AS (SELECT DISTINCT node FROM v), z AS (SELECT k.node, s.step, coalesce(v.x, 0) AS x FROM k CROSS JOIN (SELECT DISTINCT step FROM w) s LEFT JOIN v ON v.node = k.node AND v.step = s.step)
SELECT node, round(abs(regr_slope(x, step)), 6) AS weight, regr_slope(x, step) >= 0 AS rising FROM z GROUP BY 1""")
def dashboard_trend(spark, folder):
    v = traversal.power_steps(_sampled(spark, folder), 3, ["step"])
    t = metrics.trend(v, ["node"], STEPS)
    return t.select("node", F.round(F.abs("weight"), 6).alias("weight"), (F.col("weight") >= 0).alias("rising"))


@query(BASE + """, q AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2), t AS (SELECT * FROM q ORDER BY weight DESC, source, target LIMIT 20)
SELECT source, target, weight, x.s_name AS source_label, y.s_name AS target_label, CASE WHEN weight > 0 THEN round(greatest(ln(weight) + 10, 1), 6) ELSE 1 END AS width FROM t JOIN supplier x ON x.s_suppkey = source JOIN supplier y ON y.s_suppkey = target""")
def network_set_rows(spark, folder):
    """Edges of a dashboard with labels and drawn width."""
    s = table(spark, folder, "supplier")
    t = TemporalGraph(documents(spark, folder), network(spark, folder).edges, None, s.select(F.col("s_suppkey").alias("node"), F.create_map(F.lit("label"), F.col("s_name")).alias("attrs")))
    top = t.count_edges().top_edges(20, truncate=True).df
    out = t.labelled(t.labelled(top, "source", "source_label"), "target", "target_label")
    return out.withColumn("width", F.when(F.col("weight") > 0, F.round(F.greatest(F.ln("weight") + 10, F.lit(1.0)), 6)).otherwise(1.0)).select("source", "target", "weight", "source_label", "target_label", "width")


@query("SELECT s_suppkey AS node, CASE WHEN s_nationkey < 5 THEN s_name ELSE 'Node ' || s_suppkey END AS label FROM supplier")
def node_labels(spark, folder):
    s = table(spark, folder, "supplier")
    name = F.when(F.col("s_nationkey") < 5, F.create_map(F.lit("norm"), F.col("s_name"))).otherwise(F.create_map().cast("map<string,string>"))
    t = TemporalGraph(documents(spark, folder), None, None, s.select(F.col("s_suppkey").alias("node"), name.alias("attrs")))
    return t.labelled(s.select(F.col("s_suppkey").alias("node")))


# ---- rollups and streams -------------------------------------------------------------------
ODD = (JAN[0] + 5 * 3_600_000, YEAR[1] - 17 * DAY)


@query(BASE + f"SELECT source, target, round(sum(weight), 6) AS weight, count(*) AS n_docs FROM e WHERE {between(ODD)} GROUP BY 1, 2")
def rollup_sum_edges(spark, folder):
    t = network(spark, folder)
    edges = staged(t.edges, "edges")  # a table of edges, as a store would have it
    r = Rollup(spark, new_path(spark, "rollup"), MONTH)
    r.build(edges, t.doc_nodes)
    return r6(r.edges_between(edges, *ODD))


def _edge_files(spark, folder) -> str:
    path = new_path(spark, "edge-files")
    network(spark, folder).edges.select("doc_id", "ts", "source", "target", "weight").write.parquet(path)
    return path


SCHEMA = "doc_id bigint, ts bigint, source bigint, target bigint, weight double"


@query(BASE + f"SELECT ts - (ts - {OFF}) % {MONTH} AS window_start, source, target, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2, 3")
def stream_tumbling_sum(spark, folder):
    s = streams.read_edges(spark, _edge_files(spark, folder), SCHEMA)
    out = new_path(spark, "stream")
    streams.run_to_table(streams.tumbling_sums(s, MONTH, 5 * DAY, drop_late=False), out, new_path(spark, "progress"), "complete")
    return r6(streams.latest_batch(spark, out, ["window_start", "source", "target"]))


@query(BASE + f"SELECT source, target, max(ts) AS ts, round(sum(weight * exp({LOG_BETA!r} * (m - ts))), 6) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY source, target) AS m FROM e) GROUP BY 1, 2")
def stream_ewma(spark, folder):
    s = streams.read_edges(spark, _edge_files(spark, folder), SCHEMA)
    return r6(streams.run_decayed(s, LOG_BETA, new_path(spark, "stream"), new_path(spark, "progress")), "value")
