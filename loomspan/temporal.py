"""The three objects users work with: TemporalGraph, Graph and Vector.

They hold DataFrames and never change: each method gives a new object, and
nothing is computed before a result is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import graph as g
from loomspan.operators import lookup, metrics, timeline, traversal
from loomspan.plans.numbering import numbered
from loomspan.sources import cooccurrence, textfiles

EDGES = "doc_id bigint, ts bigint, source bigint, target bigint, weight double"
DOCUMENTS = "doc_id bigint, ts bigint, ext_id string"


@dataclass(frozen=True)
class Vector:
    """Sparse vector: ``df`` has node and weight."""

    df: DataFrame
    positive: bool = False

    @classmethod
    def from_dict(cls, spark: SparkSession, entries: dict[int, float], **kw) -> Vector:
        return cls(spark.createDataFrame([(int(k), float(v)) for k, v in entries.items()], "node bigint, weight double"), **kw)

    def as_dict(self) -> dict[int, float]:
        """All entries on the driver; for results known to be small."""
        return {r["node"]: r["weight"] for r in self.df.select("node", "weight").collect()}

    def __getitem__(self, node: int) -> float:
        return g.weight_of(self.df, node=node).first()["weight"]

    def __contains__(self, node: int) -> bool:
        return g.weight_of(self.df, node=node).first()["present"]

    def __len__(self) -> int:
        return self.df.count()

    def _rows(self, entries: dict[int, float]) -> DataFrame:
        return self.from_dict(self.df.sparkSession, entries).df

    def set(self, entries: dict[int, float]) -> Vector:
        rows = self._rows(entries).withColumn("o", F.lit(0))
        return replace(self, df=g.set_entries(self.df, rows, g.NODE, "o"))

    def add(self, entries: dict[int, float], factor: float = 1.0) -> Vector:
        return replace(self, df=g.combine(self.df, self._rows(entries), g.NODE, factor))

    def delete(self, nodes: Iterable[int]) -> Vector:
        return replace(self, df=g.delete(self.df, self._rows(dict.fromkeys(nodes, 0.0)), g.NODE))

    def __add__(self, other: Vector) -> Vector:
        return replace(self, df=g.combine(self.df, other.df, g.NODE))

    def __sub__(self, other: Vector) -> Vector:
        return replace(self, df=g.combine(self.df, other.df, g.NODE, -1.0))

    def __mul__(self, factor: float) -> Vector:
        return replace(self, df=g.scale(self.df, factor))

    def dot(self, other: Vector) -> float:
        return g.dot(self.df, other.df).first()[0]

    def norm(self) -> float:
        return g.norm(self.df).first()[0]

    def sum_weights(self) -> float:
        return g.total(self.df).first()[0]

    def distance(self, other: Vector) -> float:
        return g.distance(self.df, other.df).first()[0]

    def without_small(self, eps: float = 0.0) -> Vector:
        return replace(self, df=g.without_small(self.df, eps, self.positive))

    def clear(self) -> Vector:
        return replace(self, df=self.df.limit(0))


@dataclass(frozen=True)
class Graph:
    """One snapshot: ``df`` has source, target and weight, each undirected edge once with source <= target."""

    df: DataFrame
    directed: bool = False
    positive: bool = False
    mentions: DataFrame | None = None

    @classmethod
    def from_dict(cls, spark: SparkSession, edges: dict[tuple[int, int], float], directed: bool = False, **kw) -> Graph:
        df = spark.createDataFrame([(int(s), int(t), float(w)) for (s, t), w in edges.items()], "source bigint, target bigint, weight double")
        return cls(g.canonical(df, directed), directed, **kw)

    def as_dict(self) -> dict[tuple[int, int], float]:
        """All edges on the driver; for results known to be small."""
        return {(r["source"], r["target"]): r["weight"] for r in self.df.select("source", "target", "weight").collect()}

    def _key(self, s: int, t: int) -> dict[str, int]:
        return {"source": s, "target": t} if self.directed else {"source": min(s, t), "target": max(s, t)}

    def __getitem__(self, edge: tuple[int, int]) -> float:
        return g.weight_of(self.df, **self._key(*edge)).first()["weight"]

    def __contains__(self, edge: tuple[int, int]) -> bool:
        return g.weight_of(self.df, **self._key(*edge)).first()["present"]

    def _rows(self, edges: dict[tuple[int, int], float]) -> DataFrame:
        return self.from_dict(self.df.sparkSession, edges, self.directed).df

    def _with(self, df: DataFrame) -> Graph:
        return replace(self, df=df, mentions=None)  # once changed, nodes come from the edges

    def num_edges(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    def set(self, edges: dict[tuple[int, int], float]) -> Graph:
        rows = self.df.sparkSession.createDataFrame([(i, *e, float(w)) for i, (e, w) in enumerate(edges.items())], "o int, source bigint, target bigint, weight double")
        if not self.directed:
            rows = rows.select("o", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
        return self._with(g.set_entries(self.df, rows, g.EDGE, "o"))

    def add(self, edges: dict[tuple[int, int], float], factor: float = 1.0) -> Graph:
        return self._with(g.combine(self.df, self._rows(edges), g.EDGE, factor))

    def delete(self, edges: Iterable[tuple[int, int]]) -> Graph:
        return self._with(g.delete(self.df, self._rows(dict.fromkeys(edges, 0.0)), g.EDGE))

    def plus(self, other: Graph, factor: float = 1.0) -> Graph:
        if other.directed != self.directed:
            raise ValueError("one graph is directed, the other isn't")
        return self._with(g.combine(self.df, other.df, g.EDGE, factor))

    def __add__(self, other: Graph) -> Graph:
        return self.plus(other)

    def __sub__(self, other: Graph) -> Graph:
        return self.plus(other, -1.0)

    def __mul__(self, factor: float) -> Graph:
        return self._with(g.scale(self.df, factor))

    def clear(self) -> Graph:
        return self._with(self.df.limit(0))

    def without_small(self, eps: float = 0.0) -> Graph:
        return self._with(g.without_small(self.df, eps, self.positive))

    def within(self, nodes: Vector) -> Graph:
        return self._with(g.within(self.df, nodes.df))

    def nodes(self) -> Vector:
        return Vector(self.mentions if self.mentions is not None else g.nodes(self.df))

    def num_nodes(self) -> int:
        return len(self.nodes())

    def neighbours(self, node: int) -> Vector:
        return Vector(g.neighbours(self.df, node, self.directed))

    def degree(self, node: int) -> int:
        return len(self.neighbours(node))

    def multiply(self, v: Vector) -> Vector:
        return Vector(g.multiply(self.df, v.df, self.directed))

    def in_degrees(self) -> Vector:
        return Vector(g.degrees(self.df, self.directed, incoming=True))

    def out_degrees(self) -> Vector:
        return Vector(g.degrees(self.df, self.directed))

    def in_weights(self) -> Vector:
        return Vector(g.degrees(self.df, self.directed, incoming=True, weighted=True))

    def out_weights(self) -> Vector:
        return Vector(g.degrees(self.df, self.directed, weighted=True))

    def degree_anomalies(self) -> Vector:
        return Vector(g.anomalies(self.df, self.directed))

    def weight_anomalies(self) -> Vector:
        return Vector(g.anomalies(self.df, self.directed, weighted=True))

    def normalized(self) -> Graph:
        return self._with(g.normalized(self.df, self.directed))

    def sum_weights(self) -> float:
        return g.total(self.df).first()[0]

    def top_edges(self, k: int, truncate: bool = False) -> Graph:
        return self._with(g.top_edges(self.df, k, truncate))

    def _undirected(self) -> None:
        if self.directed:
            raise ValueError("only for undirected graphs")

    def sparse_subgraph(self, seeds: Graph | None = None, num_seeds: int = 8, num_neighbors: int = 3, truncate: bool = False) -> Graph:
        self._undirected()
        return self._with(g.sparse_subgraph(self.df, seeds.df if seeds else None, num_seeds, num_neighbors, truncate))

    def power_iteration(self, init: Vector | None = None, iterations: int = 100, tolerance: float = 0.0) -> tuple[Vector, float]:
        v, value = traversal.power_iteration(self.df, self.directed, init.df if init else None, iterations, tolerance)
        return Vector(v), value

    def paths(self, source: int, weighted: bool = False, limit: float = math.inf) -> DataFrame:
        root = self.df.sparkSession.createDataFrame([(int(source),)], "node bigint")
        return traversal.paths(self.df, root, self.directed, weighted, limit)

    def distance(self, source: int, target: int, weighted: bool = False) -> float:
        return traversal.distance(self.df, source, target, self.directed, weighted)

    def all_distances(self, source: int, weighted: bool = False, limit: float = math.inf) -> Vector:
        return Vector(traversal.all_distances(self.df, source, self.directed, weighted, limit))

    def distance_graph(self, weighted: bool = False, limit: float = math.inf) -> Graph:
        return Graph(traversal.distance_graph(self.df, self.directed, weighted, limit), True)

    def connected_components(self) -> Vector:
        self._undirected()
        c = traversal.components(self.df, self.mentions)
        return Vector(c.select("node", F.col("component").cast("double").alias("weight")))


@dataclass(frozen=True)
class TemporalGraph:
    """Snapshots in time: ``documents``, their ``edges``, and if known ``doc_nodes`` and ``nodes`` (node, attrs).

    ``restrict`` gives the same object for a range of time only, where the range
    can be taken to the source; without it ranges filter the edges.
    """

    documents: DataFrame
    edges: DataFrame
    doc_nodes: DataFrame | None = None
    nodes: DataFrame | None = None
    directed: bool = False
    positive: bool = False
    primary_key: tuple[str, ...] = ()
    restrict: Callable[[int, int], TemporalGraph] | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, nodes: str | None = None, directed: bool = False, positive: bool = False, key: str = "text", check_order: bool = False) -> TemporalGraph:
        """From text files of edges and, if given, nodes."""
        docs, edges = textfiles.as_documents(textfiles.edge_list(spark, path, directed, check_order))
        return cls(docs, edges, None, textfiles.node_list(spark, nodes, key) if nodes else None, directed, positive, tuple(sorted(set(filter(None, key.split(";"))))))

    @classmethod
    def from_mentions(cls, documents: DataFrame, occurrences: DataFrame, max_distance: int | None = None, how: str = "sum", normalize: bool = False, directed: bool = False, positive: bool = False, nodes: DataFrame | None = None) -> TemporalGraph:
        """From (doc_id, ts) and (doc_id, sen, ent)."""
        edges = cooccurrence.cooccurrences(documents, occurrences, max_distance, how, normalize, directed)
        return cls(documents, edges, cooccurrence.doc_nodes(documents, occurrences), nodes, directed, positive)

    @classmethod
    def from_tables(cls, documents: DataFrame, doc_id: str, time: str, occurrences: DataFrame, ext_id: str | None = None, **kw) -> TemporalGraph:
        """From a table of documents as stored, and (doc_id, sen, ent); ranges of time reach the scan of the documents."""

        def of(df: DataFrame) -> TemporalGraph:
            return cls.from_mentions(cooccurrence.documents_of(df, doc_id, time, ext_id), occurrences, **kw)

        return replace(of(documents), restrict=lambda lo, hi: of(cooccurrence.in_time(documents, time, lo, hi)))

    def within_time(self, ts_min=None, ts_max=None) -> TemporalGraph:
        """The same for a range of time, as far as the source can tell; what is outside may still be there."""
        lo, hi = timeline.bounds(ts_min, ts_max)
        if self.restrict is None or (lo, hi) == (0, timeline.INT64) or hi > cooccurrence.LAST_TIME:
            return self
        return replace(self.restrict(lo, hi), nodes=self.nodes, primary_key=self.primary_key)

    @classmethod
    def from_graphs(cls, spark: SparkSession, snapshots: list[tuple[int, dict[tuple[int, int], float]]], directed: bool = False, positive: bool = False) -> TemporalGraph:
        """From (ts, edges) pairs, empty ones too; ValueError for a time below 0."""
        if any(ts < 0 or ts > timeline.INT64 for ts, _ in snapshots):
            raise ValueError("times are from 0 to 2**63 - 1")
        docs = spark.createDataFrame([(i, ts, None) for i, (ts, _) in enumerate(snapshots)], DOCUMENTS)
        rows = [(i, ts, s if directed else min(s, t), t if directed else max(s, t), float(w)) for i, (ts, e) in enumerate(snapshots) for (s, t), w in e.items()]
        return cls(docs, spark.createDataFrame(rows, EDGES), None, None, directed, positive)

    def link(self, other: TemporalGraph) -> TemporalGraph:
        """With the snapshots of another; both must agree on direction, and ids must differ."""
        if other.directed != self.directed:
            raise ValueError("one is directed, the other isn't")
        same = self.documents.select("doc_id").join(other.documents.select("doc_id"), "doc_id", "left_semi")
        if not same.isEmpty():
            raise ValueError("a document is linked already")
        n = self.doc_nodes.unionByName(other.doc_nodes) if self.doc_nodes is not None and other.doc_nodes is not None else None
        return replace(self, documents=self.documents.unionByName(other.documents), edges=self.edges.unionByName(other.edges), doc_nodes=n, restrict=None)

    def unlink(self, doc_ids: DataFrame) -> TemporalGraph:
        """Without the documents of (doc_id)."""
        gone = doc_ids.select("doc_id").distinct()
        drop = lambda df: None if df is None else df.join(gone, "doc_id", "left_anti")
        return replace(self, documents=drop(self.documents), edges=drop(self.edges), doc_nodes=drop(self.doc_nodes), restrict=None)

    def with_nodes(self, rows: DataFrame, first_wins: bool = True) -> TemporalGraph:
        """With more nodes (node, attrs); of several rows for a node the first (or the last) is kept."""
        if self.nodes is None:
            return replace(self, nodes=rows)
        old, new = self.nodes.withColumn("_o", F.lit(0)), rows.withColumn("_o", F.lit(1))
        pick = F.min_by if first_wins else F.max_by
        return replace(self, nodes=old.unionByName(new).groupBy("node").agg(pick("attrs", "_o").alias("attrs")))

    def without_nodes(self, gone: DataFrame) -> TemporalGraph:
        return replace(self, nodes=self.nodes.join(gone.select("node"), "node", "left_anti"))

    def with_attributes(self, node: int, **attrs: str) -> TemporalGraph:
        """With attributes of a node set; those of the primary key can't change."""
        for k in attrs:
            if not k or ";" in k:
                raise ValueError("a name may not be empty or hold a semicolon")
            if k in self.primary_key:
                raise ValueError("attributes of the primary key can't change")
        new = F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv])
        old = F.map_filter("attrs", lambda k, v: ~k.isin(list(attrs)))
        return replace(self, nodes=self.nodes.withColumn("attrs", F.when(F.col("node") == node, F.map_concat(old, new)).otherwise(F.col("attrs"))))

    def keyed_by(self, *key: str) -> TemporalGraph:
        """With another primary key; of nodes that share it, the one with the least id stays."""
        names = tuple(sorted({k for part in key for k in part.split(";") if k}))
        pk = F.array(*[F.try_element_at("attrs", F.lit(k)) for k in names])
        n = self.nodes.groupBy(pk.alias("_k")).agg(F.min_by(F.struct("node", "attrs"), "node").alias("n")).select("n.*")
        return replace(self, nodes=n, primary_key=names)

    def get_or_create(self, rows: DataFrame) -> TemporalGraph:
        """With a node for each primary key in ``rows`` (attrs) that has none yet; the others keep theirs.

        New nodes get the next free numbers in the order of their keys; of
        several rows for a key one is taken.  Attributes that are missing are
        part of the key as such.
        """
        if not self.primary_key:
            raise ValueError("set a primary key first")
        key = F.to_json(F.array(*[F.try_element_at("attrs", F.lit(k)) for k in self.primary_key]))
        have = self.nodes if self.nodes is not None else rows.sparkSession.createDataFrame([], "node bigint, attrs map<string,string>")
        known = have.select(key.alias("_k"))
        entries = F.array_sort(F.map_entries("attrs"))
        fresh = rows.select(key.alias("_k"), entries.alias("e")).join(known, "_k", "left_anti").groupBy("_k").agg(F.min("e").alias("e"))
        last = have.agg(F.max("node")).first()[0]  # one number
        free = 0 if last is None else last + 1
        made = numbered(fresh, [F.col("_k")]).select((F.col("number") + free).alias("node"), F.map_from_entries("e").alias("attrs"))
        return replace(self, nodes=have.select("node", "attrs").unionByName(made))

    def find_nodes(self, **attrs: str) -> DataFrame:
        n = self.nodes
        for k, v in attrs.items():
            n = n.where(F.try_element_at("attrs", F.lit(k)) == v)
        return n

    def labelled(self, df: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
        """``df`` with a label per node: the first of label, norm, text, entity_name, else ``Node <id>``."""
        named = F.coalesce(*[F.try_element_at("attrs", F.lit(k)) for k in ("label", "norm", "text", "entity_name")])
        n = self.nodes.select(F.col("node").alias(node), named.alias(label))
        return df.join(n, node, "left").withColumn(label, F.coalesce(label, F.format_string("Node %d", F.col(node))))

    def graph(self, doc_id: int | None = None, ext_id: str | None = None) -> Graph:
        """One document's graph, by number or by external id."""
        if ext_id is not None:
            row = self.documents.where(F.lower("ext_id") == ext_id.lower()).first()
            if row is None:
                raise KeyError(ext_id)
            doc_id = row["doc_id"]
        e = self.edges.where(F.col("doc_id") == doc_id).select("source", "target", "weight")
        m = None if self.doc_nodes is None else self.doc_nodes.where(F.col("doc_id") == doc_id).select("node", F.col("freq").alias("weight"))
        return Graph(e, self.directed, self.positive, m)

    def _graph(self, df: DataFrame) -> Graph:
        return Graph(df, self.directed, self.positive)

    def sum_edges(self, ts_min=None, ts_max=None, eps: float = 0.0) -> Graph:
        return self._graph(timeline.sum_edges(self.within_time(ts_min, ts_max).edges, ts_min, ts_max, eps, self.positive))

    def sum_edges_exp(self, ts_min, ts_max, beta: float | None = None, log_beta: float | None = None, weight: float = 1.0, eps: float = 0.0) -> Graph:
        log_beta = math.log(beta) if log_beta is None else log_beta
        return self._graph(timeline.sum_edges_exp(self.within_time(ts_min, ts_max).edges, ts_min, ts_max, weight, log_beta, eps, self.positive))

    def sum_edges_exp_norm(self, ts_min, ts_max, beta: float | None = None, log_beta: float | None = None, eps: float = 0.0) -> Graph:
        return self._graph(timeline.sum_edges_exp_norm(self.within_time(ts_min, ts_max).edges, ts_min, ts_max, beta, log_beta, eps=eps, positive=self.positive))

    def count_edges(self, ts_min=None, ts_max=None) -> Graph:
        return self._graph(timeline.count_edges(self.within_time(ts_min, ts_max).edges, ts_min, ts_max))

    def sum_nodes(self, ts_min=None, ts_max=None) -> Vector:
        t = self.within_time(ts_min, ts_max)
        return Vector(timeline.sum_nodes(t.edges, t.doc_nodes, ts_min, ts_max))

    def count_nodes(self, ts_min=None, ts_max=None) -> Vector:
        t = self.within_time(ts_min, ts_max)
        return Vector(timeline.count_nodes(t.edges, t.doc_nodes, ts_min, ts_max))

    def count_graphs(self, ts_min=None, ts_max=None) -> int:
        return timeline.count_graphs(self.within_time(ts_min, ts_max).documents, ts_min, ts_max).first()[0]

    def data_bounds(self) -> tuple[int, int]:
        r = self.documents.agg(F.min("ts"), F.max("ts")).first()
        return (r[0] or 0, r[1] or 0)

    def topics(self, ts_min=None, ts_max=None, step: int | None = None, offset: int = 0, windows: list[tuple[int, int]] | None = None) -> Graph:
        if (step is not None or windows is not None) and (ts_min is None or ts_max is None):
            lo, hi = self.data_bounds()
            ts_min, ts_max = lo if ts_min is None else ts_min, hi if ts_max is None else ts_max
        t = self.within_time(ts_min, ts_max)
        return self._graph(timeline.topics(t.edges, t.doc_nodes, ts_min, ts_max, step, offset, windows))

    def extract(self, weight: Callable[[Column], Column]) -> Graph:
        return self._graph(timeline.extract(self.edges, weight))

    def compress(self, step: float | None = None, offset: int = 0, start: Callable[[Column], Column] | None = None) -> TemporalGraph:
        """One snapshot per window, dated and named by the window's start."""
        at = start or (lambda ts: timeline.window_start(ts, step, offset))
        e = timeline.compress(self.edges, at)
        docs = self.documents.select(at(F.col("ts")).alias("ts")).distinct().select(F.col("ts").alias("doc_id"), "ts", F.lit(None).cast("string").alias("ext_id"))
        return replace(self, documents=docs, edges=e.select(F.col("ts").alias("doc_id"), "ts", "source", "target", "weight"), doc_nodes=None, restrict=None)

    def sample_graphs(self, ts_min: int, ts_max: int, width: int, steps: int = 9, method: str = "sum_edges") -> DataFrame:
        hops = timeline.hopping(ts_min, ts_max, width, steps)
        t = self.within_time(min(h[1] for h in hops), max(h[2] for h in hops)) if all(h[1] >= 0 for h in hops) else self
        return timeline.sample_graphs(t.edges, hops, method, t.doc_nodes)

    def sample_eigenvectors(self, ts_min: int, ts_max: int, width: int, steps: int = 9, tolerance: float | None = None, iterations: int = 100) -> DataFrame:
        """(step, node, weight): each window's eigenvector, started from the one before."""
        out, last = None, None
        for i, lo, hi in timeline.hopping(ts_min, ts_max, width, steps):
            v, _ = self.sum_edges(lo, hi).power_iteration(last, iterations, tolerance or 0.0)
            last = v
            part = v.df.select(F.lit(i).alias("step"), "node", "weight")
            out = part if out is None else out.unionByName(part)
        return out

    def stable_edges(self, sampled: DataFrame, steps: int, base: float = 0.5) -> Graph:
        return self._graph(metrics.stability_pareto(sampled, g.EDGE, steps, base))

    def lookup_ge(self, ts: float = 0) -> DataFrame:
        return lookup.at_or_after(self.documents, ts)

    def lookup_le(self, ts: float = timeline.INT64) -> DataFrame:
        return lookup.at_or_before(self.documents, ts)

    def lookup_near(self, ts: float) -> DataFrame:
        return lookup.nearest(self.documents, ts)

    def listing(self, ts_min=None, ts_max=None, limit: int | None = None, newest_first: bool = False) -> DataFrame:
        return lookup.listing(self.documents, ts_min, ts_max, limit, newest_first)
