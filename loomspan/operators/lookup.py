"""Finding documents by time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.numbering import bucketed


def at_or_after(documents: DataFrame, ts: float) -> DataFrame:
    """The first document at or after a time; fractions are rounded up."""
    return documents.where(F.col("ts") >= math.ceil(ts)).orderBy("ts", "doc_id").limit(1)


def at_or_before(documents: DataFrame, ts: float) -> DataFrame:
    """The last document at or before a time; fractions are cut off."""
    return documents.where(F.col("ts") <= math.trunc(ts)).orderBy(F.desc("ts"), F.desc("doc_id")).limit(1)


def nearest(documents: DataFrame, ts: float) -> DataFrame:
    """The nearest document; the later one if two are equally near."""
    t = round(ts)
    both = at_or_after(documents, t).unionByName(at_or_before(documents, t))
    return both.orderBy(F.abs(F.col("ts") - t), F.desc("ts"), "doc_id").limit(1)


def listing(documents: DataFrame, ts_min=None, ts_max=None, limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Documents of a range in order."""
    from loomspan.operators.timeline import during

    d = during(documents, ts_min, ts_max)
    d = d.orderBy(F.desc("ts"), F.desc("doc_id")) if newest_first else d.orderBy("ts", "doc_id")
    return d if limit is None else d.limit(limit)


def neighbours_in_time(documents: DataFrame) -> DataFrame:
    """(doc_id, ts, prev_doc, next_doc) by (ts, doc_id).

    Buckets that follow each other in time are worked on apart; only the first
    and last document of each is passed on to its neighbours.
    """
    b = bucketed(documents.select("doc_id", "ts"), "ts", "doc_id")
    w = Window.partitionBy("_bucket").orderBy("ts", "doc_id")
    inside = b.withColumns({"prev_doc": F.lag("doc_id").over(w), "next_doc": F.lead("doc_id").over(w)})
    ends = b.groupBy("_bucket").agg(F.min_by("doc_id", F.struct("ts", "doc_id")).alias("first"), F.max_by("doc_id", F.struct("ts", "doc_id")).alias("last"))  # a row per bucket
    o = Window.orderBy("_bucket")
    ends = ends.select("_bucket", F.lag("last").over(o).alias("before"), F.lead("first").over(o).alias("after"))
    j = inside.join(F.broadcast(ends), "_bucket")
    return j.select("doc_id", "ts", F.coalesce("prev_doc", "before").alias("prev_doc"), F.coalesce("next_doc", "after").alias("next_doc"))


def keyset(ts: int, doc_id: int | None, direction: str) -> Column:
    """Condition for the page after or before (ts, doc_id), strictly; or from it on ('ge', 'le').

    Without an id, 'next' is all later times and 'prev' all up to this time.
    """
    t, d = F.col("ts"), F.col("doc_id")
    if direction == "ge":
        return t >= ts
    if direction == "le":
        return t <= ts
    if direction == "next":
        return t > ts if doc_id is None else (t > ts) | ((t == ts) & (d > doc_id))
    if direction == "prev":
        return t <= ts if doc_id is None else (t < ts) | ((t == ts) & (d < doc_id))
    raise ValueError(f"no such direction: {direction}")


def page(documents: DataFrame, ts: int, doc_id: int | None, direction: str, size: int = 256) -> DataFrame:
    """One page of documents after or before a place, at most 4096."""
    size = size if 0 < size <= 4096 else 4096
    back = direction in ("prev", "le")
    order = [F.desc("ts"), F.desc("doc_id")] if back else [F.col("ts"), F.col("doc_id")]
    return documents.where(keyset(ts, doc_id, direction)).orderBy(*order).limit(size)


def pages(documents: DataFrame, ts: int = 0, doc_id: int | None = None, size: int = 256, back: bool = False):
    """Pages of documents one after the other, as lists of (ts, doc_id); each page is a bounded top-k from where the last one ended."""
    direction = "le" if back else "ge"
    while True:
        rows = [(r["ts"], r["doc_id"]) for r in page(documents, ts, doc_id, direction, size).collect()]  # at most 4096 rows
        if not rows:
            return
        yield rows
        (ts, doc_id), direction = rows[-1], "prev" if back else "next"
