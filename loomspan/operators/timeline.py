"""Aggregations over ranges of time, and the windows that cut time up.

A temporal graph is a set of tables: ``documents`` (doc_id, ts), ``edges``
(doc_id, ts, source, target, weight; each edge once in a document) and, where
it was built from mentions, ``doc_nodes`` (doc_id, ts, node, freq).  ``ts`` is a
whole number, milliseconds by convention; ranges include both ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import graph

INT64 = (1 << 63) - 1


def bounds(ts_min: float | None, ts_max: float | None) -> tuple[int, int]:
    """Range as whole numbers from 0; None and infinity are open ends.  ValueError if the end is before the start."""
    lo = 0 if ts_min is None or ts_min == -math.inf else int(ts_min)
    hi = (1 << 64) - 1 if ts_max is None or ts_max == math.inf else int(ts_max)
    lo, hi = max(0, lo), max(0, hi)
    if hi < lo:
        raise ValueError("the range ends before it starts")
    return lo, min(hi, INT64)  # a start beyond INT64 leaves nothing


def during(df: DataFrame, ts_min=None, ts_max=None) -> DataFrame:
    """Rows with ts in the range; a comparison that reaches the scan."""
    lo, hi = bounds(ts_min, ts_max)
    if lo > INT64:
        return df.where(F.lit(False))
    if (lo, hi) == (0, INT64):
        return df.where(F.col("ts") >= 0)
    return df.where((F.col("ts") >= lo) & (F.col("ts") <= hi))


def sum_edges(edges: DataFrame, ts_min=None, ts_max=None, eps: float = 0.0, positive: bool = False) -> DataFrame:
    """Total weight per edge, without what comes to eps or less."""
    s = during(edges, ts_min, ts_max).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    return graph.without_small(s, eps, positive)


def sum_edges_exp(edges: DataFrame, ts_min, ts_max, weight: float = 1.0, log_beta: float = 0.0, eps: float = 0.0, positive: bool = False) -> DataFrame:
    """Total weight per edge, each decayed by exp(log_beta * (ts_max - ts)) and scaled by ``weight``."""
    lo, hi = bounds(ts_min, ts_max)
    decay = F.exp(F.lit(float(log_beta)) * (F.lit(hi) - F.col("ts")).cast("double"))
    s = during(edges, lo, hi).groupBy("source", "target").agg(F.sum(F.col("weight") * F.lit(float(weight)) * decay).alias("weight"))
    return graph.without_small(s, eps, positive)


def sum_edges_exp_norm(edges: DataFrame, ts_min, ts_max, beta: float | None = None, log_beta: float | None = None, **kw) -> DataFrame:
    """``sum_edges_exp`` scaled by 1 - beta: a running mean at whole ticks."""
    log_beta = math.log(beta) if log_beta is None else log_beta
    return sum_edges_exp(edges, ts_min, ts_max, -math.expm1(log_beta), log_beta, **kw)


def count_edges(edges: DataFrame, ts_min=None, ts_max=None) -> DataFrame:
    """In how many documents each edge is, whatever it weighs."""
    return during(edges, ts_min, ts_max).groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def node_rows(edges: DataFrame, doc_nodes: DataFrame | None) -> DataFrame:
    """(doc_id, ts, node, freq): mentions where there are any, else one per edge end."""
    if doc_nodes is not None:
        return doc_nodes.select("doc_id", "ts", "node", "freq")
    return edges.select("doc_id", "ts", F.explode(F.array("source", "target")).alias("node")).withColumn("freq", F.lit(1.0))


def sum_nodes(edges: DataFrame, doc_nodes: DataFrame | None = None, ts_min=None, ts_max=None) -> DataFrame:
    """How often each node is mentioned, or is an end of an edge."""
    n = during(node_rows(edges, doc_nodes), ts_min, ts_max).groupBy("node").agg(F.sum("freq").alias("weight"))
    return n.where("weight > 0.5")


def count_nodes(edges: DataFrame, doc_nodes: DataFrame | None = None, ts_min=None, ts_max=None) -> DataFrame:
    """In how many documents each node is."""
    if doc_nodes is None:
        per_doc = during(edges, ts_min, ts_max).select("doc_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    else:
        per_doc = during(doc_nodes, ts_min, ts_max).select("doc_id", "node")
    return per_doc.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def count_graphs(documents: DataFrame, ts_min=None, ts_max=None) -> DataFrame:
    """Number of documents, empty ones too."""
    return during(documents, ts_min, ts_max).agg(F.count(F.lit(1)).alias("n"))


def window_start(ts: Column, step: int, offset: int = 0) -> Column:
    """Start of the window of a time: windows of ``step`` from ``offset``, and what lies before it in one of its own."""
    if not step or step == math.inf:
        return F.lit(0).cast("bigint")
    off = int(offset) % int(step)
    return F.when(ts < off, F.lit(0)).otherwise(ts - F.pmod(ts - off, F.lit(int(step)))).cast("bigint")


def window_end(ts: Column, step: int, offset: int = 0) -> Column:
    """Last time of the window of a time."""
    if not step or step == math.inf:
        return F.lit(INT64)
    off = int(offset) % int(step)
    return F.when(ts < off, F.lit(off - 1)).otherwise(window_start(ts, step, offset) + (int(step) - 1)).cast("bigint")


def count_windows(ts_min: int, ts_max: int, step: int, offset: int = 0) -> int:
    """How many windows touch the range, empty ones too."""
    lo, hi = bounds(ts_min, ts_max)
    if not step or step == math.inf:
        return 1
    off = int(offset) % int(step)
    n = int(lo < off)
    if hi >= off:
        n += max(0, (hi - off) // step - (max(lo, off) - off) // step + 1)
    return n


def topics(edges: DataFrame, doc_nodes: DataFrame | None, ts_min, ts_max, step: int | None = None, offset: int = 0, windows: list[tuple[int, int]] | None = None) -> DataFrame:
    """Score of each edge by how exclusive, steady and close its co-occurrence is.

    2 / ((D(u) + D(v) - D(e)) / D(e) + D(e) / S(e)) with documents D and total
    weight S; with windows 3 / (... + N / T(e)), N windows in all and T(e) with
    the edge.  0 where S(e) is 0.  One pass over the edges gives S, D and T.
    The windows are those of ``step`` and ``offset``, or any ``windows`` (first,
    last) that cover the range and don't overlap.
    """
    lo, hi = bounds(ts_min, ts_max)
    if windows is not None:
        cut = sorted((max(a, lo), min(b, hi)) for a, b in windows if b >= lo and a <= hi)
        if not cut or cut[0][0] > lo or cut[-1][1] < hi or any(q[0] != p[1] + 1 for p, q in zip(cut, cut[1:])):
            raise ValueError("the windows must cover the range, each time once")
    if step is not None and hi == INT64:
        raise ValueError("windows need a last time")
    aggs = [F.sum("weight").alias("s"), F.count(F.lit(1)).cast("double").alias("d")]
    if windows is not None:
        starts = F.array(*[F.lit(a).cast("bigint") for a, _ in cut])
        aggs.append(F.count_distinct(F.array_max(F.filter(starts, lambda a: a <= F.col("ts")))).cast("double").alias("t"))
    elif step is not None:
        aggs.append(F.count_distinct(window_start(F.col("ts"), step, offset)).cast("double").alias("t"))
    e = during(edges, lo, hi).groupBy("source", "target").agg(*aggs)
    n = count_nodes(edges, doc_nodes, lo, hi)
    e = e.join(n.select(F.col("node").alias("source"), F.col("weight").alias("du")), "source").join(n.select(F.col("node").alias("target"), F.col("weight").alias("dv")), "target")
    w = (F.col("du") + F.col("dv") - F.col("d")) / F.col("d") + F.try_divide(F.col("d"), F.col("s"))
    top = 2.0
    if step is not None or windows is not None:
        n_windows = len(cut) if windows is not None else count_windows(lo, hi, step, offset)
        w, top = w + F.lit(float(n_windows)) / F.col("t"), 3.0
    return e.select("source", "target", F.coalesce(F.try_divide(F.lit(top), w), F.lit(0.0)).alias("weight"))


def extract(edges: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """Sum of all edges, each times a function of its time; times with 0 are left out."""
    f = weight(F.col("ts")).cast("double")
    return edges.withColumn("_f", f).where("_f <> 0").groupBy("source", "target").agg(F.sum(F.col("weight") * F.col("_f")).alias("weight"))


def compress(edges: DataFrame, start: Callable[[Column], Column]) -> DataFrame:
    """One graph per window, at the window's start; sums of 0 stay.  ``start`` maps a time to it."""
    return edges.groupBy(start(F.col("ts")).alias("ts"), "source", "target").agg(F.sum("weight").alias("weight"))


def hopping(ts_min: int, ts_max: int, width: int, steps: int = 9) -> list[tuple[int, int, int]]:
    """(step, first, last) of ``steps`` windows of ``width``, evenly spread so that the last one ends at ts_max."""
    if width < 1:
        raise ValueError("width must be at least 1")
    last = ts_max - width + 1
    starts = [ts_min + (last - ts_min) * i / (steps - 1) for i in range(steps)] if steps > 1 else [float(ts_min)]
    return [(i, int(t), int(t + width - 1)) for i, t in enumerate(starts)]


def in_windows(df: DataFrame, windows: list[tuple[int, int, int]]) -> DataFrame:
    """Each row once for each window it lies in, with ``step``.

    The windows are constants of the plan: the rows are exploded in place, and
    only those between the first start and the last end are read.
    """
    if not windows:
        return df.withColumn("step", F.lit(0)).where(F.lit(False))
    lo, hi = min(w[1] for w in windows), max(w[2] for w in windows)
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for i, a, b in windows])
    hits = F.transform(F.filter(every, lambda x: (F.col("ts") >= x["a"]) & (F.col("ts") <= x["b"])), lambda x: x["i"])
    return during(df, lo, hi).withColumn("step", F.explode(hits))


def sample_graphs(edges: DataFrame, windows: list[tuple[int, int, int]], method: str = "sum_edges", doc_nodes: DataFrame | None = None) -> DataFrame:
    """(step, source, target, weight) of each window, by sum_edges, count_edges or topics; one pass for all windows."""
    w = in_windows(edges, windows)
    by = w.groupBy("step", "source", "target")
    if method == "sum_edges":
        return graph.without_small(by.agg(F.sum("weight").alias("weight")))
    if method == "count_edges":
        return by.agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if method != "topics":
        raise ValueError(f"no such method: {method}")
    e = by.agg(F.sum("weight").alias("s"), F.count(F.lit(1)).cast("double").alias("d"))
    rows = in_windows(node_rows(edges, doc_nodes), windows).select("step", "doc_id", "node").distinct()
    n = rows.groupBy("step", "node").agg(F.count(F.lit(1)).cast("double").alias("n"))
    e = e.join(n.select("step", F.col("node").alias("source"), F.col("n").alias("du")), ["step", "source"]).join(n.select("step", F.col("node").alias("target"), F.col("n").alias("dv")), ["step", "target"])
    x = (F.col("du") + F.col("dv") - F.col("d")) / F.col("d") + F.try_divide(F.col("d"), F.col("s"))
    return e.select("step", "source", "target", F.coalesce(F.try_divide(F.lit(2.0), x), F.lit(0.0)).alias("weight"))


# ---- calendar ranges -----------------------------------------------------------
_UNITS = {"": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 7 * 86_400_000}


def calendar_ranges(spark: SparkSession, period: str, first: int, last: int) -> DataFrame:
    """(step, win_min, win_max): consecutive ranges from ``first`` to ``last``, both included.

    ``period`` is a count and a unit: none for milliseconds, s, m (minutes), h,
    d, w (from Mondays), M (months), q, y.  Fixed units end at multiples of the
    whole period; months and years are counted from that of ``first``, quarters
    from its quarter.  The first range starts at ``first`` itself.
    """
    count = int(period.rstrip("smhdwMqy") or 1)
    unit = period.lstrip("0123456789")
    if last < first:
        raise ValueError("the range ends before it starts")
    if unit in _UNITS:
        size = _UNITS[unit] * count
        off = 4 * 86_400_000 if unit == "w" else 0  # 1970-01-01 was a Thursday
        start = first - (first - off) % size
        n = (last - start) // size + 1
        r = spark.range(n).select(F.col("id").cast("int").alias("step"), (F.lit(start) + F.col("id") * size).alias("win_min"), (F.lit(start - 1) + (F.col("id") + 1) * size).alias("win_max"))
    elif unit in ("M", "q", "y"):
        months = count * {"M": 1, "q": 3, "y": 12}[unit]
        at = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
        one = spark.range(1).select(F.trunc(at(first), {"M": "month", "q": "quarter", "y": "year"}[unit]).alias("d0"), at(last).alias("d1"))
        every = one.select("d0", F.explode(F.sequence(F.lit(0), F.ceil(F.months_between("d1", "d0") / months).cast("int"))).alias("step"))
        ms = lambda d: F.unix_millis(d.cast("timestamp"))
        r = every.select("step", ms(F.add_months("d0", F.col("step") * months)).alias("win_min"), (ms(F.add_months("d0", (F.col("step") + 1) * months)) - 1).alias("win_max")).where(F.col("win_min") <= last)
    else:
        raise ValueError(f"no such unit: {unit}")
    return r.withColumns({"win_min": F.greatest("win_min", F.lit(first).cast("bigint")), "win_max": F.least("win_max", F.lit(last).cast("bigint"))})


def calendar_start(ts: Column, unit: str) -> Column:
    """Start of the calendar unit (M, q, y, w or a fixed one) of a time; for windows without a list of ranges."""
    if unit in ("M", "q", "y"):
        return F.unix_millis(F.date_trunc({"M": "month", "q": "quarter", "y": "year"}[unit], F.timestamp_millis(ts)))
    return window_start(ts, _UNITS[unit], 4 * 86_400_000 if unit == "w" else 0)
