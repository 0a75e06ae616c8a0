"""What a dashboard shows of a range of time: a small graph of the chosen edge weight, with sizes for its nodes.

Windows are ``steps`` stretches of a third of the range, evenly spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import graph as g
from loomspan.operators import metrics, timeline
from loomspan.plans.runtime import staged
from loomspan.temporal import TemporalGraph

STEPS = 9


def width_of(ts_min: int, ts_max: int) -> int:
    return max(1, (ts_max - ts_min) // 3)


def windows_of(ts_min: int, ts_max: int, steps: int = STEPS) -> list[tuple[int, int, int]]:
    return timeline.hopping(ts_min, ts_max, width_of(ts_min, ts_max), steps)


def normalized_samples(sampled: DataFrame) -> DataFrame:
    """(step, source, target, weight): each window's undirected graph normalised as by ``graph.normalized``."""
    ends = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    own = sampled.select("step", F.explode(ends).alias("node"), "weight").groupBy("step", "node").agg(F.sum("weight").alias("own"))
    j = sampled.join(own.select("step", F.col("node").alias("source"), F.col("own").alias("_s")), ["step", "source"]).join(own.select("step", F.col("node").alias("target"), F.col("own").alias("_t")), ["step", "target"])
    return j.select("step", "source", "target", F.try_divide(F.col("weight"), F.col("_s") * F.col("_t")).alias("weight"))


def edge_weights(t: TemporalGraph, kind: str, ts_min: int, ts_max: int, steps: int = STEPS) -> DataFrame:
    """(source, target, weight) of the whole graph, by kind: sum_edges, count_edges, topics, each also with _norm, and stable_edges."""
    plain = {"sum_edges": t.sum_edges, "count_edges": t.count_edges, "topics": t.topics}
    if kind in plain:
        return plain[kind](ts_min, ts_max).df
    if kind.removesuffix("_norm") in plain:
        return plain[kind.removesuffix("_norm")](ts_min, ts_max).normalized().df
    if kind == "stable_edges":
        s = normalized_samples(timeline.sample_graphs(t.edges, windows_of(ts_min, ts_max, steps)))
        return metrics.stability_pareto(s, g.EDGE, steps, 0.5)
    raise ValueError(f"no such edge weight: {kind}")


def subgraph(t: TemporalGraph, kind: str, ts_min: int, ts_max: int, steps: int = STEPS) -> tuple[DataFrame, DataFrame | None]:
    """The edges to show, and for stable_topics the seeds to mark."""
    if kind != "stable_topics":
        return g.sparse_subgraph(edge_weights(t, kind, ts_min, ts_max, steps)), None
    rated = staged(_rated(t, ts_min, ts_max, steps), "topics")
    rounded = rated.select(*g.EDGE, F.round("weight", 9).alias("topic"), F.round("dev", 12).alias("dev"))
    high = staged(metrics.in_first_fronts(rounded, "topic", "dev", True, False, 8), "high")  # the first 8 fronts have 8 edges at least, if there are 8
    seeds = staged(g.top_edges(metrics.pareto(high, g.EDGE, "topic", "dev", True, False, 0.5), 8), "seeds")
    score = rated.select(*g.EDGE, "weight")
    return g.sparse_subgraph(score, score.join(seeds.select(*g.EDGE, (-F.col("weight")).alias("rank")), g.EDGE), written=True), seeds


#: Nodes whose sums are sent to all tasks, at most.
SENT = 100_000


def _rated(t: TemporalGraph, ts_min: int, ts_max: int, steps: int) -> DataFrame:
    """(source, target, weight, dev): score as a topic, and deviation of the weights in the windows, each normalised.

    An edge is one row with its sums of all windows side by side, and a node is
    too, so that no row is repeated for the windows it lies in.
    """
    if steps < 2:
        raise ValueError("a deviation needs two steps")
    t = t.within_time(ts_min, ts_max)
    w = [f"w{i}" for i in range(steps)]
    inside = [F.coalesce(F.sum(F.when(F.col("ts").between(a, b), F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, a, b in windows_of(ts_min, ts_max, steps)]
    e = timeline.during(t.edges, ts_min, ts_max).groupBy(*g.EDGE).agg(F.sum("weight").alias("s"), F.count(F.lit(1)).cast("double").alias("d"), *inside)
    e = staged(e, "sums")
    ends = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    own = e.select(F.explode(ends).alias("node"), *w).groupBy("node").agg(*[F.sum(c).alias(c) for c in w])
    nodes = staged(timeline.count_nodes(t.edges, t.doc_nodes, ts_min, ts_max).join(own, "node").select("node", F.col("weight").alias("n"), *w), "nodes")
    few = nodes.count() <= SENT
    for end in g.EDGE:
        side = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("n", *w)])
        e = e.join(F.broadcast(side) if few else side, end)
    parts = [F.coalesce(F.try_divide(F.col(c), F.col(f"source_{c}") * F.col(f"target_{c}")), F.lit(0.0)) for c in w]
    e = e.select(*g.EDGE, "s", "d", (F.col("source_n") + F.col("target_n")).alias("n"), *[p.alias(c) for p, c in zip(parts, w)])
    mean = sum((F.col(c) for c in w), F.lit(0.0)) / steps
    e = e.withColumn("mean", mean)
    squares = sum(((F.col(c) - F.col("mean")) * (F.col(c) - F.col("mean")) for c in w), F.lit(0.0))
    x = (F.col("n") - F.col("d")) / F.col("d") + F.try_divide(F.col("d"), F.col("s"))
    return e.select(*g.EDGE, F.coalesce(F.try_divide(F.lit(2.0), x), F.lit(0.0)).alias("weight"), F.sqrt(squares / (steps - 1)).alias("dev"))


def node_sizes(t: TemporalGraph, kind: str, ts_min: int, ts_max: int, steps: int = STEPS, tolerance: float = 1e-3) -> DataFrame:
    """(node, weight, colour), by kind; degrees, weights, anomalies and eigenvectors on a logarithmic scale.

    The eigenvectors of windows each start from the one before and end when a step moves them by ``tolerance`` or less.
    """
    one = {
        "in_degrees": dict(incoming=True), "out_degrees": {}, "in_weights": dict(incoming=True, weighted=True), "out_weights": dict(weighted=True),
    }
    grey = F.lit(None).cast("string").alias("colour")
    if kind in one or kind in ("degree_anomalies", "weight_anomalies", "eigenvector"):
        s = t.sum_edges(ts_min, ts_max)
        if kind in one:
            v = g.degrees(s.df, t.directed, **one[kind])
        elif kind == "eigenvector":
            v = s.power_iteration(tolerance=tolerance)[0].df
        else:
            v = g.anomalies(s.df, t.directed, weighted=kind == "weight_anomalies")
        return v.select("node", F.when(F.col("weight") > 0, F.greatest(F.ln("weight") + 10, F.lit(1.0))).otherwise(1.0).alias("weight"), grey)
    v = staged(t.sample_eigenvectors(ts_min, ts_max, width_of(ts_min, ts_max), steps, tolerance), "eigenvectors")
    if kind == "stable_nodes":
        return metrics.stability_pareto(v, g.NODE, steps).select("node", (-F.col("weight")).alias("weight"), grey)
    if kind == "trend":
        m = metrics.trend(v, g.NODE, steps)
        return m.select("node", F.abs("weight").alias("weight"), F.when(F.col("weight") >= 0, "green").otherwise("red").alias("colour"))
    entropies = {"entropy": metrics.entropy, "entropy_local": metrics.entropy_local, "entropy_2d": metrics.entropy_2d}
    if kind in entropies:
        return entropies[kind](v, g.NODE, steps).select("node", "weight", grey)
    raise ValueError(f"no such node size: {kind}")


def network_set(t: TemporalGraph, edge_kind: str, node_kind: str, ts_min: int, ts_max: int, steps: int = STEPS) -> DataFrame:
    """(kind, payload): one JSON row per node and edge of the dashboard."""
    shown, seeds = subgraph(t, edge_kind, ts_min, ts_max, steps)
    shown = staged(shown, "shown")
    red = shown.withColumn("colour", F.lit(None).cast("string")) if seeds is None else shown.join(seeds.select(*g.EDGE, F.lit("red").alias("colour")), g.EDGE, "left")
    edges = red.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "weight", "colour")).alias("payload"))
    ends = shown.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    n = ends.join(node_sizes(t, node_kind, ts_min, ts_max, steps), "node", "left")
    n = t.labelled(n) if t.nodes is not None else n.withColumn("label", F.format_string("Node %d", F.col("node")))
    return edges.unionByName(n.select(F.lit("node").alias("kind"), F.to_json(F.struct("node", "label", "weight", "colour")).alias("payload")))
