"""Answers over ranges of time from sums per bucket of time.

The tables hold, unfiltered, the total weight and number of documents of each
edge in each bucket, and mentions and documents of each node.  A range is the
full buckets inside it plus the rows at its two ends, or everything less what
lies outside, whichever reads less: counts are exact either way.  Small values
are left out last, so no part of a sum is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import graph
from loomspan.operators.timeline import INT64, bounds, node_rows


#: Tasks that write a bucket, at most.
PARTS = 16


class Intervals:
    """Whole numbers covered with a weight: the sum of weighted ranges, as a step function."""

    def __init__(self):
        self.steps: dict[int, int] = {}

    def add(self, lo: int, hi: int, weight: int = 1) -> None:
        """Add ``weight`` from lo to hi, both included."""
        if hi < lo:
            raise ValueError("the range ends before it starts")
        for at, w in ((lo, weight), (hi + 1, -weight)):
            self.steps[at] = self.steps.get(at, 0) + w
            if not self.steps[at]:
                del self.steps[at]

    def weight(self, at: int) -> int:
        return sum(w for k, w in self.steps.items() if k <= at)

    def pieces(self) -> list[tuple[int, int, int]]:
        """(lo, hi, weight) of the ranges with a weight."""
        out, level, last = [], 0, None
        for k in sorted(self.steps):
            if level:
                out.append((last, k - 1, level))
            level, last = level + self.steps[k], k
        return out

    def length(self) -> int:
        """How many numbers have a weight."""
        return sum(hi - lo + 1 for lo, hi, _ in self.pieces())

    def change_of_length(self, lo: int, hi: int, weight: int = 1) -> int:
        """What ``add`` would add to the length."""
        other = Intervals()
        other.steps = dict(self.steps)
        other.add(lo, hi, weight)
        return other.length() - self.length()


class Rollup:
    """Bucket tables of a temporal graph, in a folder partitioned by bucket."""

    def __init__(self, spark, folder: str, width: int):
        self.spark, self.folder, self.width = spark, folder.rstrip("/"), int(width)

    def _edges(self, edges: DataFrame) -> DataFrame:
        b = F.floor(F.col("ts") / self.width).cast("bigint").alias("bucket")
        return edges.groupBy(b, "source", "target").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_docs"))

    def _nodes(self, rows: DataFrame) -> DataFrame:
        b = F.floor(F.col("ts") / self.width).cast("bigint").alias("bucket")
        per = rows.groupBy(b, "doc_id", "node").agg(F.sum("freq").alias("freq"))
        return per.groupBy("bucket", "node").agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("n_docs"))

    def _write(self, df: DataFrame, name: str) -> None:
        # A bucket is written by up to PARTS tasks, however many rows it has.
        first = "source" if "source" in df.columns else "node"
        df.repartition("bucket", F.pmod(F.xxhash64(first), F.lit(PARTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def build(self, edges: DataFrame, doc_nodes: DataFrame | None = None) -> None:
        self._write(self._edges(edges), "edges")
        self._write(self._nodes(node_rows(edges, doc_nodes)), "nodes")

    def refresh(self, edges: DataFrame, doc_nodes: DataFrame | None, ts: list[int]) -> None:
        """Work out anew the buckets that hold these times, after late data; all others stay as they are."""
        touched = sorted({int(t) // self.width for t in ts})
        here = F.floor(F.col("ts") / self.width).isin(touched)
        self._write(self._edges(edges.where(here)), "edges")
        self._write(self._nodes(node_rows(edges, doc_nodes).where(here)), "nodes")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def plan(self, ts_min, ts_max, data: tuple[int, int]) -> list[tuple[str, int, int, int]]:
        """(table, lo, hi, sign): what to read; 'bucket' ranges are numbers of buckets, 'rows' ranges are times."""
        lo, hi = bounds(ts_min, ts_max)
        lo, hi = max(lo, data[0]), min(hi, data[1])
        if hi < lo:
            return []
        first, last = -(-lo // self.width), (hi + 1) // self.width - 1
        if last < first:
            return [("rows", lo, hi, 1)]
        all_first, all_last = data[0] // self.width, data[1] // self.width
        parts = []
        if last - first + 1 > (all_last - all_first + 1) / 2:  # all, less what is outside
            parts.append(("bucket", all_first, all_last, 1))
            if all_first < lo // self.width:
                parts.append(("bucket", all_first, lo // self.width - 1, -1))
            if hi // self.width < all_last:
                parts.append(("bucket", hi // self.width + 1, all_last, -1))
            if lo // self.width * self.width < lo:
                parts.append(("rows", lo // self.width * self.width, lo - 1, -1))
            if hi + 1 < (hi // self.width + 1) * self.width:
                parts.append(("rows", hi + 1, (hi // self.width + 1) * self.width - 1, -1))
            return parts
        parts.append(("bucket", first, last, 1))
        if lo < first * self.width:
            parts.append(("rows", lo, first * self.width - 1, 1))
        if (last + 1) * self.width <= hi:
            parts.append(("rows", (last + 1) * self.width, hi, 1))
        return parts

    def edges_between(self, edges: DataFrame, ts_min, ts_max, data: tuple[int, int] | None = None) -> DataFrame:
        """(source, target, weight, n_docs) of a range; ``data`` are the first and last time there are."""
        if data is None:
            data = tuple(edges.agg(F.min("ts"), F.max("ts")).first())
        if data[0] is None:
            return edges.select("source", "target", "weight", F.lit(0).cast("bigint").alias("n_docs")).limit(0)
        out = None
        for kind, lo, hi, sign in self.plan(ts_min, ts_max, data):
            if kind == "bucket":
                part = self.read("edges").where(F.col("bucket").between(lo, hi)).select("source", "target", (F.col("weight") * sign).alias("weight"), (F.col("n_docs") * sign).alias("n_docs"))
            else:
                part = edges.where((F.col("ts") >= lo) & (F.col("ts") <= min(hi, INT64))).select("source", "target", (F.col("weight") * sign).alias("weight"), F.lit(sign).cast("bigint").alias("n_docs"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return edges.select("source", "target", "weight", F.lit(0).cast("bigint").alias("n_docs")).limit(0)
        return out.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")

    def sum_edges(self, edges: DataFrame, ts_min, ts_max, eps: float = 0.0, positive: bool = False, data=None) -> DataFrame:
        return graph.without_small(self.edges_between(edges, ts_min, ts_max, data).select("source", "target", "weight"), eps, positive)

    def count_edges(self, edges: DataFrame, ts_min, ts_max, data=None) -> DataFrame:
        return self.edges_between(edges, ts_min, ts_max, data).select("source", "target", F.col("n_docs").cast("double").alias("weight"))
