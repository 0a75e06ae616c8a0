"""The time-range aggregations as Structured Streaming queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.timeline import window_start


def read_edges(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of edge files (doc_id, ts, source, target, weight) as they arrive in a folder."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def tumbling_sums(stream: DataFrame, step: int, offset: int = 0, lateness: str = "1 hour", drop_late: bool = True) -> DataFrame:
    """(window_start, source, target, weight): total weight per edge and window.

    With ``drop_late`` the watermark lets finished windows go, and rows later
    than ``lateness`` are dropped; without it all late rows are taken up.
    """
    timed = stream.withColumn("_t", F.timestamp_millis("ts"))
    if drop_late:
        timed = timed.withWatermark("_t", lateness)
        off = f"{int(offset) % int(step)} milliseconds"
        w = F.window("_t", f"{int(step)} milliseconds", startTime=off)
        agg = timed.groupBy(w.alias("w"), "source", "target").agg(F.sum("weight").alias("weight"))
        return agg.select(F.unix_millis("w.start").alias("window_start"), "source", "target", "weight")
    return timed.groupBy(window_start(F.col("ts"), step, offset).alias("window_start"), "source", "target").agg(F.sum("weight").alias("weight"))


def hopping_sums(stream: DataFrame, width: int, slide: int, lateness: str = "1 hour") -> DataFrame:
    """(window_start, source, target, weight) of windows of ``width`` that start every ``slide``."""
    timed = stream.withColumn("_t", F.timestamp_millis("ts")).withWatermark("_t", lateness)
    w = F.window("_t", f"{int(width)} milliseconds", f"{int(slide)} milliseconds")
    agg = timed.groupBy(w.alias("w"), "source", "target").agg(F.sum("weight").alias("weight"))
    return agg.select(F.unix_millis("w.start").alias("window_start"), "source", "target", "weight")


#: States that the edges of a stream are spread over; each is one call into Python per batch that touches it.
STATES = 256


def decayed_sums(stream: DataFrame, log_beta: float, weight: float = 1.0) -> DataFrame:
    """(source, target, ts, value): sum of weights decayed by exp(log_beta * age), as of each edge's last time.

    The state of an edge is its last time and value.  A row that comes late is
    decayed to the last time, so the order of arrival doesn't matter.  Edges
    share ``STATES`` states by a hash, each a packed table, so that a batch
    costs one call per state and not one per edge; only edges that a batch has
    rows of are given out.  Rows without an end or a time are no edges.
    """
    packed = [("source", "<i8"), ("target", "<i8"), ("ts", "<i8"), ("value", "<f8")]

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(state.get[0], packed) if state.exists else np.empty(0, packed)
        fresh = np.zeros(len(known), bool)
        for b in batches:
            rows = np.empty(len(b), packed)
            rows["source"], rows["target"], rows["ts"], rows["value"] = b.source, b.target, b.ts, b.weight.fillna(0.0) * weight
            both, fresh = np.concatenate([known, rows]), np.concatenate([fresh, np.ones(len(rows), bool)])
            order = np.lexsort((both["target"], both["source"]))
            both, fresh = both[order], fresh[order]
            s, t = both["source"], both["target"]
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])])[: len(both)])
            if not len(first):
                continue
            last = np.maximum.reduceat(both["ts"], first)
            age = np.repeat(last, np.diff(np.append(first, len(both)))) - both["ts"]
            known = both[first]
            known["ts"], known["value"] = last, np.add.reduceat(both["value"] * np.exp(log_beta * age), first)
            fresh = np.logical_or.reduceat(fresh, first)
        state.update((known.tobytes(),))
        yield pd.DataFrame({c: known[c][fresh] for c, _ in packed})

    rows = stream.select("source", "target", "ts", "weight").where("source is not null and target is not null and ts is not null")
    return rows.withColumn("part", F.pmod(F.xxhash64("source", "target"), F.lit(STATES))).groupBy("part").applyInPandasWithState(
        update, "source bigint, target bigint, ts bigint, value double", "edges binary", "update", GroupStateTimeout.NoTimeout
    )


def fold_decayed(rows: DataFrame, log_beta: float, state: DataFrame | None = None) -> DataFrame:
    """(source, target, ts, value): ``state`` of the same form with ``rows`` (ts, weight) taken in, all in the JVM.

    A value is as of its edge's own last time, so nothing ever overflows, and a
    value that is decayed away can't come back.
    """
    part = rows.select("source", "target", "ts", F.col("weight").alias("value"))
    if state is not None:
        part = part.unionByName(state.select("source", "target", "ts", "value"))
    last = part.groupBy("source", "target").agg(F.max("ts").alias("last"))
    aged = part.join(last, ["source", "target"]).withColumn("value", F.col("value") * F.exp(F.lit(float(log_beta)) * (F.col("last") - F.col("ts"))))
    return aged.groupBy("source", "target").agg(F.max("last").alias("ts"), F.sum("value").alias("value"))


def run_decayed(stream: DataFrame, log_beta: float, path: str, checkpoint: str) -> DataFrame:
    """``decayed_sums`` by micro-batches: each folds its rows into the state of the batch before, in bulk.

    The state of batch n is a table of its own, worked out from that of the last
    batch before n only: a batch that is repeated after a failure replaces
    itself.  Returns the last state.  For few large batches; ``decayed_sums``
    keeps its state in Spark's store and suits many small ones.
    """
    spark = stream.sparkSession

    def versions(below: float = math.inf) -> list[int]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        ready = [int(q.getName().split("=")[1]) for q in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))]
        return sorted(n for n in ready if n < below)

    def fold(df: DataFrame, n: int) -> None:
        before = versions(n)
        state = spark.read.parquet(f"{path}/batch={before[-1]}") if before else None
        fold_decayed(df, log_beta, state).write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start().awaitTermination()
    return spark.read.parquet(f"{path}/batch={versions()[-1]}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a run after a failure goes on where it stopped.

    Modes other than append write the state of each batch into a folder of its
    own, named by the batch, so a batch that is repeated replaces itself.
    """
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").start(path)
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    q.awaitTermination()


def latest_batch(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last value of each key written by ``run_to_table`` in update or complete mode."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*keys, "batch")]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, *[f"v.{c}" for c in rest])
