"""Walks over one graph: distances and components.

Each round is one join of a frontier with the edges; lineage is cut by writing
the state of the round into the shared folder.  Only counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.graph import both_directions
from loomspan.plans.numbering import numbered
from loomspan.plans.runtime import staged


def paths(g: DataFrame, roots: DataFrame, directed: bool = False, weighted: bool = False, limit: float = math.inf) -> DataFrame:
    """(root, node, weight, count, parent): the shortest way from each root to each node it reaches within ``limit``.

    Shortest by hops, or by weight with ``weighted`` (weights may not be
    negative).  ``weight`` and ``count`` are the weight and hops of the way;
    ``parent`` is the node before, null for the root.  Of equal ways the one
    with fewer hops, then with the least parent, is taken; by hops, the one with
    the least parent.  A root is reached by itself even if no edge has it.  A
    round relaxes only what changed in the round before, so a way of k edges
    takes k rounds.
    """
    e = staged(both_directions(g, directed).select("source", "target", F.col("weight").alias("w")).where("source <> target"), "edges")
    cost = "weight" if weighted else "count"
    best = staged(
        roots.select(F.col("node").cast("bigint").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("count"), F.lit(None).cast("bigint").alias("parent"), F.lit(True).alias("fresh")), "paths"
    )
    rank = ["weight", "count", "parent"] if weighted else ["count", "parent", "weight"]
    while True:
        front = best.where("fresh")
        if front.isEmpty():
            return best.drop("fresh")
        step = front.join(e, front.node == e.source).select("root", F.col("target").alias("node"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("count") + 1).alias("count"), F.col("source").alias("parent"))
        if limit < math.inf:
            step = step.where(F.col(cost) <= limit)
        old = best.withColumn("fresh", F.lit(False))
        new = step.withColumn("fresh", F.lit(True))
        # The least struct is the best way; one that isn't fresh wins ties, so nothing goes round again.
        least = F.min(F.struct(*[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in rank], F.col("fresh"), *[F.col(c).alias(f"_{c}") for c in ("weight", "count", "parent")]))
        merged = old.unionByName(new).groupBy("root", "node").agg(least.alias("b"))
        best = staged(merged.select("root", "node", F.col("b._weight").alias("weight"), F.col("b._count").alias("count"), F.col("b._parent").alias("parent"), F.col("b.fresh").alias("fresh")), "paths")


def visit_order(ways: DataFrame, weighted: bool = False) -> DataFrame:
    """``paths`` of one root with ``pos``, the order of a search: by distance, then parent, then node."""
    first = "weight" if weighted else "count"
    return numbered(ways, [F.col(first), F.col("parent").asc_nulls_first(), F.col("node")], "pos")


def distance(g: DataFrame, source: int, target: int, directed: bool = False, weighted: bool = False) -> float:
    """Distance between two nodes; 0 to itself, infinite if there is no way."""
    if source == target:
        return 0.0
    root = g.sparkSession.createDataFrame([(int(source),)], "node bigint")
    row = paths(g, root, directed, weighted).where(F.col("node") == target).first()
    return math.inf if row is None else float(row["weight"] if weighted else row["count"])


def all_distances(g: DataFrame, source: int, directed: bool = False, weighted: bool = False, limit: float = math.inf) -> DataFrame:
    """(node, weight): distances from one node, itself at 0."""
    root = g.sparkSession.createDataFrame([(int(source),)], "node bigint")
    return paths(g, root, directed, weighted, limit).select("node", F.col("weight" if weighted else "count").cast("double").alias("weight"))


#: Edges of a component whose distances are worked out in tasks, at most, and roots of a task.
IN_TASK, ROOTS = 2_000_000, 512
#: Numbers of one step within a task, about; lightest edges into a node that are tried first.
CELLS, LIGHT = 2_000_000, 16


def distance_graph(g: DataFrame, directed: bool = False, weighted: bool = False, limit: float = math.inf) -> DataFrame:
    """Directed graph of the distances between all pairs of nodes with a way, without the diagonal.

    Its size is that of the answer, up to nodes squared; ``limit`` bounds it.
    Without a limit, components of up to ``IN_TASK`` edges go to a task per
    ``ROOTS`` roots, which holds its component's edges and gives the distances
    out as they are found; so nothing is kept between rounds.  Larger ones, and
    weights that are no plain numbers, go by rounds of ``paths``.
    """
    if limit < math.inf:
        return _by_rounds(g, directed, weighted, limit)
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = staged(g.where("source <> target").select("source", "target", w.alias("weight")), "edges")
    odd = ~F.coalesce((F.col("weight") >= 0) & (F.col("weight") < math.inf), F.lit(False))
    n, any_odd = e.agg(F.count(F.lit(1)), F.max(odd)).first()
    if n <= IN_TASK and not any_odd:
        nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().count()
        return _in_tasks(e.withColumns({"component": F.lit(0).cast("bigint"), "blocks": F.lit(-(-nodes // ROOTS))}), directed)
    c = staged(components(e), "components")
    e = e.join(c.withColumnRenamed("node", "source"), "source")
    sizes = e.groupBy("component").agg(((F.count(F.lit(1)) <= IN_TASK) & ~F.max(odd)).alias("fits"))
    blocks = c.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / ROOTS).cast("int").alias("blocks"))
    e = staged(e.join(sizes.join(blocks, "component"), "component"), "parts")
    large = e.where("not fits").select("source", "target", "weight")
    small = _in_tasks(e.where("fits"), directed)
    return small if large.isEmpty() else small.unionByName(_by_rounds(large, directed, weighted))


def _by_rounds(g: DataFrame, directed: bool, weighted: bool, limit: float = math.inf) -> DataFrame:
    roots = g.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    p = paths(g, roots, directed, weighted, limit).where("root <> node")
    return p.select(F.col("root").alias("source"), F.col("node").alias("target"), F.col("weight" if weighted else "count").cast("double").alias("weight"))


def _in_tasks(e: DataFrame, directed: bool) -> DataFrame:
    """(source, target, weight): distances, of edges with component and the number of blocks that its roots are in."""
    import numpy as np
    import pyarrow as pa

    names = ["component", "block", "blocks", "source", "target", "weight"]
    rows = e.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*names)
    cells, few = CELLS, LIGHT

    def distances(held: list[pa.RecordBatch]):
        block, blocks = held[0]["block"][0].as_py(), held[0]["blocks"][0].as_py()
        x, y, w = (np.concatenate([b[c].to_numpy() for b in held]) for c in names[3:])
        ids, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
        s, t = ends[: len(x)], ends[len(x) :]
        if not directed:
            s, t, w = np.concatenate([s, t]), np.concatenate([t, s]), np.concatenate([w, w])
        order = np.lexsort((w, t))
        s, t, w = s[order], t[order], w[order]
        light = np.arange(len(t)) - np.searchsorted(t, t) < few
        roots = np.arange(block, len(ids), blocks)
        width = max(1, min(64, cells // len(ids)))
        for k in range(0, len(roots), width):
            mine = roots[k : k + width]
            own = np.arange(len(mine))
            d = np.full((len(ids), len(mine)), np.inf)
            d[mine, own] = 0.0

            def relax(use: np.ndarray, d=d) -> np.ndarray:
                """Takes these edges into the distances; the nodes that come nearer."""
                moved, use = np.zeros(len(d), bool), np.flatnonzero(use)
                step = max(1, cells // d.shape[1])
                for i in range(0, len(use), step):
                    at = use[i : i + step]
                    into = t[at]
                    first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
                    best, into = np.minimum.reduceat(d[s[at]] + w[at, None], first, axis=0), into[first]
                    nearer = (best < d[into]).any(axis=1)
                    d[into[nearer]] = np.minimum(best[nearer], d[into[nearer]])
                    moved[into[nearer]] = True
                return moved

            moved = np.zeros(len(ids), bool)
            moved[mine] = True
            while moved.any():
                while moved.any():  # by light edges first, from what has moved
                    moved = relax(light & moved[s])
                moved = relax(w < d.max())  # then by all that aren't longer than the farthest way
            there = np.isfinite(d)
            there[mine, own] = False
            node, root = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([pa.array(ids[mine[root]]), pa.array(ids[node]), pa.array(d[there])], names=names[3:])

    def tasks(batches):
        at, held = None, []
        for b in batches:
            component, block = b["component"].to_numpy(), b["block"].to_numpy()
            cuts = np.flatnonzero((component[1:] != component[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
                if lo == hi:
                    continue
                key = (component[lo], block[lo])
                if held and key != at:
                    yield from distances(held)
                    held = []
                at = key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from distances(held)

    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "component", "block").sortWithinPartitions("component", "block").mapInArrow(tasks, "source bigint, target bigint, weight double")


def components(g: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of an undirected graph; nodes without edges are components of their own.

    Components are numbered from 0 in the order of their least nodes.  In each
    round a node, and the node that is its label, take the least label of a
    label among its neighbours: trees of labels are hooked onto each other and
    flattened at once, so that the rounds grow with the logarithm of the size.
    """
    e = staged(both_directions(g).where("source <> target").select("source", "target"), "edges")
    n = g.select(F.explode(F.array("source", "target")).alias("node"))
    if nodes is not None:
        n = n.unionByName(nodes.select("node"))
    labels = staged(n.where("node is not null").distinct().select("node", F.col("node").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        far = labels.select("node", "label").join(up, "label")
        near = e.join(far.select(F.col("node").alias("target"), "grand"), "target").groupBy("source").agg(F.min("grand").alias("near"))
        hooks = far.join(near, F.col("node") == F.col("source"), "left").select(
            F.explode(F.array(F.struct("node", F.least("label", "grand", "near").alias("low")), F.struct(F.col("label").alias("node"), F.least("grand", "near").alias("low")))).alias("x")
        )
        low = hooks.select("x.node", "x.low").groupBy("node").agg(F.min("low").alias("low"))
        labels = staged(labels.join(low, "node").select("node", F.col("low").alias("label"), (F.col("low") < F.col("label")).alias("moved")), "labels")
    ids = numbered(labels.select("label").distinct(), [F.col("label")], "component")
    return labels.join(ids, "label").select("node", "component")


def power_iteration(g: DataFrame, directed: bool = False, init: DataFrame | None = None, iterations: int = 100, tolerance: float = 0.0) -> tuple[DataFrame, float]:
    """Vector (node, weight) after repeated v <- A v / |A v|, and its eigenvalue v * A v.

    v starts at 1 on every node with an edge into it, or at the non-zero values
    of ``init``; it ends after ``iterations``, or after the step that moves it
    by ``tolerance`` or less.  Each step is one join and one sum; the norm is
    taken along.
    """
    e = staged(both_directions(g, directed), "edges")
    start = e.select(F.col("target").alias("node")).distinct()
    if init is None:
        v = start.withColumn("weight", F.lit(1.0))
    else:
        i = init.where("weight <> 0").select("node", F.col("weight").alias("i"))
        v = start.join(i, "node", "left").select("node", F.coalesce("i", F.lit(1.0)).alias("weight"))
    v = staged(v, "vector")
    size = v.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).first()[0] or 1.0
    v = v.select("node", (F.col("weight") / size).alias("weight"))
    step = lambda x: e.join(x.select(F.col("node").alias("target"), F.col("weight").alias("x")), "target").groupBy(F.col("source").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("weight"))
    for _ in range(iterations or 100):
        new = staged(step(v), "vector")
        size = new.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).first()[0]
        if not size:
            v = new
            break
        new = new.select("node", (F.col("weight") / size).alias("weight"))
        if tolerance > 0:
            moved = new.unionByName(v.select("node", (-F.col("weight")).alias("weight"))).groupBy("node").agg(F.sum("weight").alias("d")).agg(F.sqrt(F.sum(F.col("d") * F.col("d")))).first()[0]
            v = new
            if moved is not None and moved <= tolerance:
                break
        else:
            v = new
    value = step(v).withColumnRenamed("weight", "y").join(v, "node").agg(F.coalesce(F.sum(F.col("y") * F.col("weight")), F.lit(0.0))).first()[0]
    return v, float(value)


def power_steps(g: DataFrame, steps: int, by: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(by ..., node, weight) after a fixed number of steps from all ones, normalised once at the end.

    Scaling commutes with the steps, so this is one plan without any action, and
    ``by`` takes many graphs (say one per window) through it at once.
    """
    by = by or []
    e = g
    ways = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    if not directed:
        e = g.select(*by, F.explode(F.when(F.col("source") == F.col("target"), F.array(F.struct("source", "target"))).otherwise(ways)).alias("e"), "weight").select(*by, "e.source", "e.target", "weight")
    e = staged(e, "edges")
    v = e.select(*by, F.col("target").alias("node")).distinct().withColumn("x", F.lit(1.0))
    for _ in range(steps):
        v = e.join(v.withColumnRenamed("node", "target"), [*by, "target"]).groupBy(*by, F.col("source").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    v = staged(v, "vector")
    square = F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size")
    joined = v.join(v.groupBy(*by).agg(square), by) if by else v.withColumn("size", F.lit(v.agg(square).first()[0]))
    return joined.select(*by, "node", F.try_divide("x", "size").alias("weight"))

