"""One snapshot: a sparse weighted graph (source, target, weight), and vectors (node, weight).

An undirected graph holds each edge once, source <= target.  An edge that isn't
there weighs 0, but an edge of weight 0 is there.  All functions map DataFrames
to DataFrames; nothing is collected.  Rows with a null end are no edges; a null
weight counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.numbering import numbered
from loomspan.plans.runtime import staged

EDGE, NODE = ["source", "target"], ["node"]


def canonical(df: DataFrame, directed: bool = False) -> DataFrame:
    """(source, target, weight) with undirected edges turned to source <= target."""
    g = df.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    s, t = F.col("source").cast("bigint"), F.col("target").cast("bigint")
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")
    if directed:
        return g.select(s.alias("source"), t.alias("target"), w)
    return g.select(F.least(s, t).alias("source"), F.greatest(s, t).alias("target"), w)


def both_directions(g: DataFrame, directed: bool = False) -> DataFrame:
    """Every edge in each direction it has; self-loops once.  One scan, no union."""
    if directed:
        return g.select("source", "target", "weight")
    ways = F.when(F.col("source") == F.col("target"), F.array(F.struct("source", "target"))).otherwise(
        F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    )
    return g.select(F.explode(ways).alias("e"), "weight").select("e.source", "e.target", "weight")


# ---- algebra, for graphs (keys = EDGE) and vectors (keys = NODE) ---------------
def set_entries(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Put ``rows`` in; of several for one key the last by ``order`` wins, over what was there too."""
    b = base.select(*keys, "weight", F.lit(None).cast(rows.schema[order].dataType).alias("_o"))
    r = rows.select(*keys, "weight", F.col(order).alias("_o"))
    return b.unionByName(r).groupBy(*keys).agg(F.max_by("weight", F.struct(F.col("_o").isNotNull(), "_o", "weight")).alias("weight"))


def combine(a: DataFrame, b: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """a + factor * b; entries that come to 0 stay."""
    scaled = b.select(*keys, (F.col("weight") * F.lit(float(factor))).alias("weight"))
    return a.select(*keys, "weight").unionByName(scaled).groupBy(*keys).agg(F.sum("weight").alias("weight"))


def delete(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Without the keys of ``rows``; keys that aren't there change nothing."""
    return base.join(rows.select(*keys).distinct(), keys, "left_anti")


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("weight", F.col("weight") * F.lit(float(factor)))


def without_small(a: DataFrame, eps: float = 0.0, positive: bool = False) -> DataFrame:
    """Entries above eps: by weight where only positive ones count, else by size.  Those equal to eps go."""
    w = F.col("weight") if positive else F.abs("weight")
    return a.where(w > abs(float(eps)))


def weight_of(a: DataFrame, **key: int) -> DataFrame:
    """(weight, present) of one entry; 0 and false if it isn't there."""
    x = a
    for k, v in key.items():
        x = x.where(F.col(k) == v)
    return x.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), (F.count(F.lit(1)) > 0).alias("present"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("node", F.col("weight").alias("x")).join(b.select("node", F.col("weight").alias("y")), "node")
    return j.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("norm"))


def total(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Euclidean distance of two vectors over the union of their nodes."""
    return norm(combine(a, b, NODE, -1.0)).withColumnRenamed("norm", "distance")


def multiply(g: DataFrame, v: DataFrame, directed: bool = False) -> DataFrame:
    """Matrix times vector: out[s] = sum of w(s, t) * v[t]; nodes without a partner in v are left out."""
    e = both_directions(g, directed)
    x = v.select(F.col("node").alias("target"), F.col("weight").alias("x"))
    return e.join(x, "target").groupBy(F.col("source").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("weight"))


# ---- per-graph analytics -------------------------------------------------------
def nodes(g: DataFrame) -> DataFrame:
    """(node, weight): how many edge ends a node is; a self-loop is two."""
    return g.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def neighbours(g: DataFrame, node: int, directed: bool = False) -> DataFrame:
    """(node, weight) of the edges that leave ``node``; only they are read, in either order of ends."""
    if directed:
        return g.where(F.col("source") == node).select(F.col("target").alias("node"), "weight")
    hit = g.where((F.col("source") == node) | (F.col("target") == node))
    return hit.select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("node"), "weight")


def degrees(g: DataFrame, directed: bool = False, incoming: bool = False, weighted: bool = False) -> DataFrame:
    """(node, weight): number, or total weight, of the edges out of (or into) each node."""
    end = "target" if incoming else "source"
    agg = F.sum("weight") if weighted else F.count(F.lit(1)).cast("double")
    return both_directions(g, directed).groupBy(F.col(end).alias("node")).agg(agg.alias("weight"))


def anomalies(g: DataFrame, directed: bool = False, weighted: bool = False) -> DataFrame:
    """(node, weight): own degree less the mean degree of the neighbours.

    With ``weighted``, own weight less the neighbours' weights, each by its
    edge's share of the own weight.  Null where the own value is 0.
    """
    e = both_directions(g, directed)
    own = degrees(g, directed, weighted=weighted)
    other = own.select(F.col("node").alias("target"), F.col("weight").alias("other"))
    share = F.col("weight") if weighted else F.lit(1.0)
    near = e.join(other, "target", "left").groupBy(F.col("source").alias("node")).agg(F.sum(share * F.coalesce("other", F.lit(0.0))).alias("near"))
    return own.join(near, "node").select("node", (F.col("weight") - F.try_divide("near", "weight")).alias("weight"))


def normalized(g: DataFrame, directed: bool = False) -> DataFrame:
    """Each weight divided by the weight out of its source and that into its target; null where one is 0."""
    out = degrees(g, directed, weighted=True).select(F.col("node").alias("source"), F.col("weight").alias("_o"))
    into = degrees(g, directed, incoming=True, weighted=True).select(F.col("node").alias("target"), F.col("weight").alias("_i"))
    j = g.join(out, "source").join(into, "target")
    return j.select("source", "target", F.try_divide(F.col("weight"), F.col("_o") * F.col("_i")).alias("weight"))


def within(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges with both ends among ``chosen`` (node)."""
    c = chosen.select("node").distinct()
    g = g.join(c.withColumnRenamed("node", "source"), "source", "left_semi")
    return g.join(c.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target", "weight")


def top_edges(g: DataFrame, k: int, truncate: bool = False) -> DataFrame:
    """The k heaviest edges, and all that tie with the last unless ``truncate``.

    The k-th weight is found by a bounded top-k, not by ranking the whole graph;
    for the ties the graph is written down, so that it is worked out once.
    """
    if k <= 0:
        return g.limit(0)
    heaviest = [F.desc("weight"), F.col("source"), F.col("target")]
    if truncate:
        return g.orderBy(*heaviest).limit(k)
    g = staged(g.select("source", "target", "weight"), "graph")
    least = g.orderBy(*heaviest).limit(k).agg(F.min("weight")).first()[0]  # one number
    return g.where(F.col("weight") >= F.lit(least)) if least is not None else g.limit(0)


def sparse_subgraph(g: DataFrame, seeds: DataFrame | None = None, num_seeds: int = 8, num_neighbors: int = 3, truncate: bool = False, written: bool = False) -> DataFrame:
    """The heaviest edges, each with the nodes most strongly linked to both its ends.  Undirected graphs only.

    Seeds are the heaviest edges, or those of ``seeds`` (source, target, weight
    and, if they are not to come in the order of their weight, rank).
    Of the common neighbours k of a seed (i, j), those with the greatest
    min(w_ik, w_jk) add the edges (i, k) and (j, k).  An edge that is an earlier
    seed is no side of a later triangle.  Self-loops are left out.  Only edges
    that touch a seed's end are joined.  A graph that is a table already
    (``written``) isn't written down again.
    """
    plain = g.where("source <> target")
    plain = plain if written else staged(plain, "graph")  # read three times below
    s = seeds.where("source <> target") if seeds is not None else top_edges(plain, num_seeds, truncate)
    # Ties can make any number of seeds, so they are numbered without one big task and no join is told to broadcast them.
    first = F.col("rank") if "rank" in s.columns else -F.col("weight")
    ranked = staged(numbered(s.withColumn("_first", first), [F.col("_first"), F.col("source"), F.col("target")], "ord").select("source", "target", "weight", "ord"), "seeds")
    s = ranked.select("source", "target", "weight")
    ends = ranked.select("ord", F.explode(F.array("source", "target")).alias("node"))
    touch = both_directions(plain).join(ends.select(F.col("node").alias("source")).distinct(), "source", "left_semi")
    # Earlier seeds that meet an end of this one.
    seed_ways = both_directions(ranked.select("source", "target", F.col("ord").cast("double").alias("weight")))
    sides = touch.join(ends.withColumnRenamed("node", "source"), "source")
    blocked = seed_ways.select("source", "target", F.col("weight").alias("earlier"))
    sides = sides.join(blocked, ["source", "target"], "left").where(F.col("earlier").isNull() | (F.col("earlier") > F.col("ord")))
    both = sides.groupBy("ord", F.col("target").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"), F.collect_list(F.struct("source", "weight")).alias("side")).where("n = 2")  # two rows each
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("least"), "k"))).where(F.col("rn") <= num_neighbors)
    extra = best.select("k", F.explode("side").alias("x")).select(F.least("k", "x.source").alias("source"), F.greatest("k", "x.source").alias("target"), "x.weight")
    return s.unionByName(extra).distinct()
