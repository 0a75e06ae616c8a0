"""Named queries p1, p4, p6 and p7: data preparation on the news tables."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.instants import instant_parts, parts_to_utc_millis
from loomspan.operators import hot_keys, increments, rolling
from loomspan.plans.runtime import new_path
from loomspan.sources.tables import table

EPOCH = dt.date(1970, 1, 1)
FIRST_DAY, LAST_DAY = (dt.date(2023, 1, 1) - EPOCH).days, (dt.date(2023, 12, 31) - EPOCH).days


# ---- p1: rolling totals ------------------------------------------------------
def _current_edges(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.latest_rows(table(spark, folder, "edge"), "edge_id", "loaded_at", ["edge_ts", "edge_from", "edge_to", "edge_value"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which the trailing week is at 0 and the trailing 30 days are not."""
    daily = rolling.daily_amounts(_current_edges(spark, folder), ["edge_from", "edge_to"], "edge_ts", "edge_value")
    runs = rolling.trailing_runs(daily, [7, 30], FIRST_DAY, LAST_DAY)
    return rolling.spread(runs.where((F.col("total_7") == 0) & (F.col("total_30") > 0))).select("node", "day_no")


def p1_trailing_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of each node on each day of 2023."""
    out = rolling.trailing_totals(_current_edges(spark, folder), ["edge_from", "edge_to"], "edge_ts", "edge_value", [7, 30], FIRST_DAY, LAST_DAY)
    return out.select("node", "day_no", *[F.round(c, 9).alias(c) for c in ("total_7", "avg_7", "total_30", "avg_30")])


P1_BASE = f"""
WITH best AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC) rn FROM edge),
ends AS (SELECT edge_from AS node, edge_ts, edge_value FROM best WHERE rn = 1
         UNION ALL SELECT edge_to, edge_ts, edge_value FROM best WHERE rn = 1 AND edge_to IS DISTINCT FROM edge_from),
daily AS (SELECT node, CAST(floor(epoch(edge_ts) / 86400) AS INT) AS d, sum(CAST(coalesce(edge_value, 0) AS DECIMAL(26,12))) AS v
          FROM ends WHERE node IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT node, CAST(t.day_no AS INT) AS day_no FROM (SELECT DISTINCT node FROM daily) x, range({FIRST_DAY}, {LAST_DAY + 1}) t(day_no)),
dense AS (SELECT g.node, g.day_no, coalesce(v, 0) AS v FROM grid g LEFT JOIN daily d ON d.node = g.node AND d.d = g.day_no),
tot AS (SELECT node, day_no,
  sum(v) OVER (PARTITION BY node ORDER BY day_no ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7,
  sum(v) OVER (PARTITION BY node ORDER BY day_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30 FROM dense)
"""

# ---- p4: a few keys holding most rows ----------------------------------------
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with at least 1 % of all rows, over both tables."""
    parts = []
    for name, key in (("entity", "entity_name"), ("edge", "edge_from")):
        parts.append(hot_keys.heavy_keys(table(spark, folder, name), key, 0.01).select(F.lit(key).alias("field_name"), "key_text"))
    return parts[0].unionByName(parts[1])


def p4_key_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and sums of every entity_name and every edge_from."""
    names = hot_keys.key_totals(table(spark, folder, "entity"), "entity_name", "sentence_index")
    ends = hot_keys.key_totals(table(spark, folder, "edge"), "edge_from", "edge_value")
    out = names.withColumn("field_name", F.lit("entity_name")).unionByName(ends.withColumn("field_name", F.lit("edge_from")))
    return out.select("field_name", "key_text", "n_rows", "n_values", F.round("total", 6).alias("total"))


def p4_key_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 90 % quantile of edge_value of every edge_from."""
    return hot_keys.key_quantiles(table(spark, folder, "edge"), "edge_from", "edge_value", [0.5, 0.9])


# ---- p6: timestamps in mixed writings ----------------------------------------
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the three text columns that names an instant, as UTC milliseconds."""
    outlet = table(spark, folder, "outlet").groupBy("outlet").agg(F.min(F.struct("zone_name", "date_order")).alias("o")).select("outlet", "o.zone_name", "o.date_order")

    def read(name: str, key: str, fields: dict) -> DataFrame:
        # The parts are made once, before the zone joins: nothing wide is shuffled.
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw"), F.lit(utc).alias("in_utc")) for f, utc in fields.items()]))
        rows = table(spark, folder, name).select(F.col(key).alias("record_id"), "outlet", cells.alias("c")).where(F.col("c.raw").isNotNull())
        rows = rows.select("record_id", "outlet", "c.field_name", "c.in_utc", instant_parts(F.col("c.raw")).alias("parts"))
        zoned = rows.join(outlet, "outlet", "left")
        zoned = zoned.withColumn("zone_name", F.when(F.col("in_utc"), F.lit("UTC")).otherwise(F.col("zone_name")))
        return parts_to_utc_millis(zoned, "parts", "zone_name", "date_order", "utc_ms").select("record_id", "field_name", "utc_ms").where(F.col("utc_ms").isNotNull())

    extract = read("article_extract", "extract_id", {"date_text": False, "crawltime": True})
    return extract.unionByName(read("article_processed", "article_id", {"publishing_date": False}))


# ---- p7: new or changed records only -----------------------------------------
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Latest rows of each url that no succeeded run has taken over with this body."""
    extract = table(spark, folder, "article_extract")
    runs = table(spark, folder, "pipeline_run").where(F.col("run_status") == "succeeded").select("run_id").distinct()
    taken = table(spark, folder, "article_processed").join(runs, "run_id", "left_semi").select("url", "extracttime")
    ledger = increments.Ledger(spark, new_path(spark, "ledger"))
    return increments.changed_rows(extract, taken, "extract_id", "url", "extracttime", "body", ledger).select("extract_id")


def p7_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Which run of a ledger takes each article, and what a run that fails leaves behind.

    The first run finds the articles extracted before the first half of the
    pipeline's runs had started; the second finds all and fails when its rows
    are made; the third finds all; the fourth finds nothing new.
    """
    extract = table(spark, folder, "article_extract").select("extract_id", "extracttime")
    half = table(spark, folder, "pipeline_run").select("started_at", F.ntile(2).over(Window.orderBy("run_id")).alias("half")).where("half = 1").agg(F.max("started_at")).first()[0]  # a row per run of the pipeline
    ledger = increments.Ledger(spark, new_path(spark, "ledger"))
    numbered = lambda n: lambda d: d.select("extract_id", F.lit(n).alias("run_no"))
    ledger.run(extract.where(F.col("extracttime") < F.lit(half)), "extract_id", numbered(1))
    try:
        ledger.run(extract, "extract_id", lambda d: d.select("extract_id", F.raise_error(F.lit("the machine is lost")).cast("int").alias("run_no")))
    except PySparkException:
        pass
    ledger.run(extract, "extract_id", numbered(3))
    ledger.run(extract, "extract_id", numbered(4))
    return ledger.output().select("extract_id", "run_no")


P7_SQL = """
WITH ok AS (SELECT p.url, max(p.extracttime) AS t FROM article_processed p JOIN pipeline_run r USING (run_id) WHERE r.run_status = 'succeeded' GROUP BY 1),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY extracttime DESC, extract_id) rn FROM article_extract WHERE url IS NOT NULL) WHERE rn = 1),
taken AS (SELECT o.url, min_by(struct_pack(b := e.body), e.extract_id) AS s FROM ok o JOIN article_extract e ON e.url = o.url AND e.extracttime = o.t GROUP BY 1)
SELECT l.extract_id FROM last l LEFT JOIN taken t ON t.url = l.url
WHERE t.url IS NULL OR (t.s).b IS DISTINCT FROM l.body
"""
P7_RUNS = """
WITH h AS (SELECT max(started_at) AS t FROM (SELECT started_at, ntile(2) OVER (ORDER BY run_id) AS half FROM pipeline_run) WHERE half = 1)
SELECT extract_id, CASE WHEN extracttime < h.t THEN 1 ELSE 3 END AS run_no FROM article_extract, h
"""
P4_PART = """SELECT '{f}' AS field_name, CAST({f} AS VARCHAR) AS key_text, count(*) AS n_rows, count({v}) AS n_values,
  round(CAST(coalesce(sum(CAST({v} AS DECIMAL(26,12))), 0) AS DOUBLE), 6) AS total FROM {t} WHERE {f} IS NOT NULL GROUP BY 2"""
P4_FOUND = """SELECT '{f}' AS field_name, CAST({f} AS VARCHAR) AS key_text FROM {t} WHERE {f} IS NOT NULL
  GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM {t})"""

QUERIES = {"p1_found": p1_found, "p1_trailing_totals": p1_trailing_totals,
    "p4_found": p4_found, "p4_key_totals": p4_key_totals, "p4_key_quantiles": p4_key_quantiles,
    "p6_found": p6_found, "p7_found": p7_found, "p7_runs": p7_runs,
}
ORACLES = {
    "p1_found": P1_BASE + "SELECT node, day_no FROM tot WHERE t7 = 0 AND t30 > 0",
    "p1_trailing_totals": P1_BASE + """SELECT node, day_no, round(CAST(t7 AS DOUBLE), 9) AS total_7, round(CAST(t7 AS DOUBLE) / 7, 9) AS avg_7,
        round(CAST(t30 AS DOUBLE), 9) AS total_30, round(CAST(t30 AS DOUBLE) / 30, 9) AS avg_30 FROM tot""",
    "p4_found": P4_FOUND.format(f="entity_name", t="entity") + " UNION ALL " + P4_FOUND.format(f="edge_from", t="edge"),
    "p4_key_totals": P4_PART.format(f="entity_name", t="entity", v="sentence_index") + " UNION ALL " + P4_PART.format(f="edge_from", t="edge", v="edge_value"),
    "p4_key_quantiles": """WITH r AS (SELECT edge_from, edge_value, row_number() OVER (PARTITION BY edge_from ORDER BY edge_value) AS i, count(*) OVER (PARTITION BY edge_from) AS n
        FROM edge WHERE edge_from IS NOT NULL AND edge_value IS NOT NULL)
        SELECT CAST(edge_from AS VARCHAR) AS key_text, p.prob, edge_value AS quantile FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) p(prob)
        WHERE i = greatest(1, CAST(ceil(p.prob * n) AS BIGINT))""",
    "p7_found": P7_SQL,
    "p7_runs": P7_RUNS,
}
