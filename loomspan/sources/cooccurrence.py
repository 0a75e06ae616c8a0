"""Temporal graphs from mentions of entities in sentences of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.plans.numbering import numbered


def as_milliseconds(c: Column) -> Column:
    """A timestamp as milliseconds since 1970 in UTC."""
    return F.unix_millis(c.cast("timestamp"))


def in_time(df: DataFrame, time: str, lo: int, hi: int) -> DataFrame:
    """Rows with the raw ``time`` in a range of milliseconds, by a comparison of the column itself, which reaches the scan."""
    kind = df.schema[time].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        at = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
        return df.where((F.col(time) >= at(lo)) & (F.col(time) < at(hi + 1)))
    if kind == "date":
        return df.where((F.col(time) >= F.timestamp_millis(F.lit(lo)).cast("date")) & (F.col(time) <= F.timestamp_millis(F.lit(hi)).cast("date")))
    return df.where((F.col(time) >= lo) & (F.col(time) <= hi))


#: Times that a timestamp can hold, in milliseconds: the year 9999 and no later.
LAST_TIME = 253_402_300_799_999


def documents_of(df: DataFrame, doc_id: str, time: str, ext_id: str | None = None, **equal: object) -> DataFrame:
    """(doc_id, ts, ext_id): rows with an id and a time from 0 on; ``equal`` are filters that reach the scan."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    t = F.col(time)
    if df.schema[time].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        t = as_milliseconds(t)
    out = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), t.cast("bigint").alias("ts"), (F.lower(F.col(ext_id)) if ext_id else F.lit(None)).cast("string").alias("ext_id"))
    return out.where("doc_id is not null and ts >= 0")


def occurrences_of(df: DataFrame, doc_id: str, sentence: str, entity: str) -> DataFrame:
    """(doc_id, sen, ent): rows with all three, none negative."""
    out = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(sentence).cast("bigint").alias("sen"), F.col(entity).cast("bigint").alias("ent"))
    return out.where("doc_id is not null and sen >= 0 and ent >= 0")


def dense_entities(df: DataFrame, attributes: list[str], order: list[str]) -> DataFrame:
    """(node, attributes ...): a number from 0 for each distinct value of the attributes, in the order first seen.

    ``order`` are the columns that say what comes first.  A missing attribute
    is a value like others.
    """
    first = df.groupBy(*attributes).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(first, [*[F.col(f"first.{o}") for o in order], *[F.col(a) for a in attributes]], "node").select("node", *attributes)


def doc_nodes(documents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(doc_id, ts, node, freq): how often each document mentions each entity; mentions of other documents are dropped first."""
    n = occurrences.join(documents.select("doc_id", "ts"), "doc_id")
    return n.groupBy("doc_id", "ts", F.col("ent").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("freq"))


#: Mentions of a part of a document, about, where the distance is not limited.
PART = 4096


def cooccurrences(documents: DataFrame, occurrences: DataFrame, max_distance: int | None = None, how: str = "sum", normalize: bool = False, directed: bool = False) -> DataFrame:
    """(doc_id, ts, source, target, weight): pairs of different entities of a document within ``max_distance`` sentences.

    Each pair of mentions weighs exp(-distance); an edge is the ``sum`` or
    ``max`` of its pairs, and with ``normalize`` its part of the document's
    total.  Directed edges go from the earlier mention to the later, within a
    sentence from the lesser entity.  Repeated mentions in a sentence are
    counted first and multiplied, not paired.

    Mentions of other documents are dropped first.  Then a band join: each
    mention is sent to its own band of sentences and the one before, so pairs in
    reach meet on (document, band), and a long document is spread over many
    tasks.  Both sides are the same rows, told apart by a condition on both, so
    that they are read and shuffled once.  Without a limit a document's mentions
    are cut into parts, and each pair of parts is a key.
    """
    if how not in ("sum", "max"):
        raise ValueError("how is 'sum' or 'max'")
    known = occurrences.join(documents.select("doc_id", "ts"), "doc_id")
    m = known.groupBy("doc_id", "ts", "sen", "ent").agg(F.count(F.lit(1)).alias("m"))
    x, y = F.col("x.sen"), F.col("y.sen")
    gap = y - x
    if max_distance is not None:
        band = F.expr(f"sen div {int(max_distance) + 1}")
        sides = m.select("*", F.posexplode(F.array(band, band - 1)).alias("off", "band")).where("band >= 0")  # sentences count from 0
        left, right, on = sides.alias("x"), sides.alias("y"), ["doc_id", "band"]
        # x is in its own band (off 0), y in its own or the one before; ``reach`` is null for other pairs of rows.
        reach = F.when(F.col("x.off") * 2 + F.col("y.off") < 2, gap)
        cond = reach.between(0, int(max_distance))
    else:
        parts = m.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        m = m.join(parts, "doc_id").withColumn("part", F.pmod(F.xxhash64("sen", "ent"), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        left = m.select("doc_id", "ts", "sen", "ent", "m", F.col("part").alias("px"), every.alias("py")).alias("x")
        right = m.select("doc_id", "ts", "sen", "ent", "m", every.alias("px"), F.col("part").alias("py")).alias("y")
        on, cond = ["doc_id", "px", "py"], gap >= 0
    same = F.lit(True)
    for k in on:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    e1, e2 = F.col("x.ent"), F.col("y.ent")
    p = left.join(right, same & cond & (e1 != e2) & ((gap > 0) | (e1 < e2)))
    ends = (e1, e2) if directed else (F.least(e1, e2), F.greatest(e1, e2))
    w = F.exp(-gap.cast("double"))
    agg = F.sum(w * F.col("x.m") * F.col("y.m")) if how == "sum" else F.max(F.when(F.col("x.m") + F.col("y.m") > 0, w))
    # The time is the same on both sides; taking it from both keeps the sides alike.
    e = p.groupBy(F.col("x.doc_id").alias("doc_id"), F.greatest("x.ts", "y.ts").alias("ts"), ends[0].alias("source"), ends[1].alias("target")).agg(agg.alias("weight"))
    if normalize:
        t = e.groupBy("doc_id").agg(F.sum("weight").alias("_t"))
        e = e.join(t, "doc_id").select("doc_id", "ts", "source", "target", F.coalesce(F.try_divide("weight", "_t"), F.lit(0.0)).alias("weight"))
    return e


def edge_variants(raw: DataFrame, how: str) -> DataFrame:
    """(ts, source, target, weight) of raw co-occurrences (ts, article, id1, id2, dist): weights exp(-dist).

    Per article and pair their 'sum', 'mean' or 'max'; 'norm' is the sum over
    the article's total.  Then summed up over the articles of a time.
    """
    w = F.exp(-F.col("dist").cast("double"))
    agg = {"sum": F.sum(w), "mean": F.avg(w), "max": F.max(w), "norm": F.sum(w)}[how]
    per = raw.groupBy("ts", "article", F.col("id1").alias("source"), F.col("id2").alias("target")).agg(agg.alias("weight"))
    if how == "norm":
        t = per.groupBy("ts", "article").agg(F.sum("weight").alias("_t"))
        per = per.join(t, ["ts", "article"]).withColumn("weight", F.col("weight") / F.col("_t"))
    return per.groupBy("ts", "source", "target").agg(F.sum("weight").alias("weight"))
