"""Metrics across snapshots, on long tables (step, keys ..., weight).

A key that isn't in a snapshot weighs 0 there.  Sums over steps are taken from
the rows that exist, with the number of zeros worked out, so nothing is filled
up with zeros unless a metric looks at single values in order.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.numbering import bucketed
from loomspan.plans.runtime import new_path, staged


def dense(sampled: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """(step, keys ..., weight) with a row for every key and step; the zeros are made where the key's rows are."""
    by = sampled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", "weight"))).alias("m"))  # at most ``steps`` rows each
    every = by.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "m")
    return every.select("step", *keys, F.coalesce(F.try_element_at("m", F.col("step")), F.lit(0.0)).alias("weight"))


def _moments(sampled: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Mean and sum of squared deviations per key, zeros included."""
    p = sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("m"), F.var_pop("weight").alias("v"), F.sum("weight").alias("s"))
    mean = F.col("s") / steps
    squares = F.col("n") * (F.col("v") + (F.col("m") - mean) * (F.col("m") - mean)) + (F.lit(steps) - F.col("n")) * mean * mean
    # A constant key has no deviation; rounding must not make one.
    flat = (F.col("v") == 0) & (F.col("n") == steps)
    return p.select(*keys, mean.alias("mean"), F.when(flat | ((F.col("v") == 0) & (F.col("m") == 0)), 0.0).otherwise(squares).alias("squares"))


def average(sampled: DataFrame, keys: list[str], steps: int) -> DataFrame:
    return sampled.groupBy(*keys).agg((F.sum("weight") / steps).alias("weight"))


def deviation(sampled: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Sample standard deviation; ValueError for fewer than two steps."""
    if steps < 2:
        raise ValueError("a deviation needs two steps")
    return _moments(sampled, keys, steps).select(*keys, F.sqrt(F.col("squares") / (steps - 1)).alias("weight"))


def trend(sampled: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Slope of the least-squares line over steps 0, 1, 2 ...; 0 for a single step."""
    middle = (steps - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(steps))
    lean = F.sum((F.col("step") - F.lit(middle)) * F.col("weight"))
    return sampled.groupBy(*keys).agg((lean / spread if spread else F.lit(0.0)).alias("weight"))


def stability_ratio(sampled: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Mean, without its sign, over the population deviation; infinite where nothing varies."""
    m = _moments(sampled, keys, steps)
    sd = F.sqrt(F.col("squares") / steps)
    return m.select(*keys, F.when(sd > 0, F.abs("mean") / sd).otherwise(F.lit(float("inf"))).alias("weight"))


def _bins(x: Column, lo: Column, hi: Column, bins: int, lookup: bool) -> Column:
    """Bin of a value.  For counting, bins include their lower edge (the last one both); for looking up, the upper."""
    at = (x - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins
    return F.greatest(F.lit(0), F.ceil(at) - 1) if lookup else F.least(F.lit(bins - 1), F.floor(at))


def _entropy(values: DataFrame, keys: list[str], parts: list[str], cols: list[str], bins: int) -> DataFrame:
    """Per key the sum over its values of -p ln p, with p the share of all values (of a part) in the bin it looks up."""
    limits = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))] + [F.count(F.lit(1)).alias("all")]
    if parts:
        v = values.join(values.groupBy(*parts).agg(*limits), parts)
    else:
        one = values.agg(*limits).first()
        v = values.withColumns({k: F.lit(x) for k, x in one.asDict().items()})
    count_bins = [_bins(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins, False).alias(f"b_{c}") for c in cols]
    flat = F.lit(False)
    for c in cols:
        flat = flat | (F.col(f"lo_{c}") == F.col(f"hi_{c}"))
    hist = v.select(*parts, "all", *count_bins).groupBy(*parts, *[f"b_{c}" for c in cols]).agg((F.count(F.lit(1)) / F.first("all")).alias("p"))
    looked = v.select(*parts, *keys, flat.alias("flat"), *[_bins(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins, True).alias(f"b_{c}") for c in cols])
    j = looked.join(hist, [*parts, *[f"b_{c}" for c in cols]], "left")
    return j.groupBy(*keys).agg(F.sum(F.when(F.col("flat") | F.col("p").isNull(), 0.0).otherwise(-F.col("p") * F.ln("p"))).alias("weight"))


def entropy(sampled: DataFrame, keys: list[str], steps: int, bins: int = 50) -> DataFrame:
    """How unusual the values of a key are among those of all keys and steps."""
    return _entropy(dense(sampled, keys, steps), keys, [], ["weight"], bins)


def entropy_local(sampled: DataFrame, keys: list[str], steps: int, bins: int = 50) -> DataFrame:
    """As ``entropy``, within each step."""
    return _entropy(dense(sampled, keys, steps), keys, ["step"], ["weight"], bins)


def entropy_2d(sampled: DataFrame, keys: list[str], steps: int, bins: int = 50) -> DataFrame:
    """As ``entropy``, for pairs of values of consecutive steps."""
    d = dense(sampled, keys, steps).withColumn("next", F.lead("weight").over(Window.partitionBy(*keys).orderBy("step")))
    return _entropy(d.where("next is not null"), keys, [], ["weight", "next"], bins)


def _weights(done: DataFrame, keys: list[str], base: float) -> DataFrame:
    """(keys ..., weight) of (keys ..., front)."""
    return done.select(*keys, (F.pow(F.lit(float(base)), F.col("front") - 1) if base else F.col("front").cast("double")).alias("weight"))


def pareto(values: DataFrame, keys: list[str], a: str, b: str, max_a: bool = True, max_b: bool = True, base: float = 0.0) -> DataFrame:
    """(keys ..., weight): number of the Pareto front, from 1, of two values; with a base, base ** (front - 1).

    Every key with both values gets its front, however many there are.  Equal
    points share a front; null values have none.
    """
    x = (-F.col(a) if max_a else F.col(a)).cast("double").alias("x")
    y = (-F.col(b) if max_b else F.col(b)).cast("double").alias("y")
    points = staged(values.select(*keys, x, y).where("x is not null and y is not null"), "points")
    return _weights(points.join(_fronts(points.select("x", "y").distinct()), ["x", "y"]), keys, base)


#: Points that a task holds the following ones against, at most.
HELD = 100_000


def in_first_fronts(values: DataFrame, a: str, b: str, max_a: bool, max_b: bool, fronts: int) -> DataFrame:
    """The rows of the first Pareto fronts of two values, and maybe some more.

    A row is left out where the rows of its own task put it behind so many
    fronts: then all rows do.  So ``pareto`` of what is left gives the first
    ``fronts`` fronts as it does of all.  Null values have no front.
    """
    import numpy as np
    import pyarrow as pa

    held_most = HELD

    def front_of(p: np.ndarray) -> np.ndarray:
        """Fronts, up to ``fronts`` + 1, of different points in the order of x, then y."""
        out, left = np.full(len(p), fronts + 1), np.arange(len(p))
        for f in range(1, fronts + 1):
            if not len(left):
                break
            y = p[left, 1]
            on = np.concatenate([[True], y[1:] < np.minimum.accumulate(y)[:-1]])
            out[left[on]] = f
            left = left[~on]
        return out

    def keep(batches):
        held = np.empty((0, 2))
        for batch in batches:
            x, y = batch[a].to_numpy(zero_copy_only=False).astype(float), batch[b].to_numpy(zero_copy_only=False).astype(float)
            own = np.column_stack([-x if max_a else x, -y if max_b else y])
            odd = np.isnan(own).any(axis=1)
            points, at = np.unique(np.concatenate([held, np.where(odd[:, None], np.inf, own)]), axis=0, return_inverse=True)
            front = front_of(points)
            yield batch.filter(pa.array(odd | (front[at.ravel()[len(held) :]] <= fronts)))
            good = np.flatnonzero(front <= fronts)
            held = points[good[np.argsort(front[good], kind="stable")[:held_most]]]

    return values.where(F.col(a).isNotNull() & F.col(b).isNotNull()).mapInArrow(keep, values.schema)


#: Points of one cell of the grid, about.
CELL = 1_000_000


def _fronts(points: DataFrame) -> DataFrame:
    """(x, y, front) of different points, less being better.

    The front of a point is one more than the last front below and left of it.
    The plane is cut into a grid, about evenly along both axes.  What a cell
    needs of the others is at its left and lower edge: the last front up to each
    height, and up to each place, as steps.  So the cells of a diagonal are
    independent of each other: each round works on one, all its cells at once,
    and hands the steps at the right and upper edges on to the next.  A cell is
    streamed in the order of x with one number per front that passes through it.
    There are as many rounds as cells along both sides: about 2 sqrt(n / CELL).
    """
    n = points.count()
    side = max(1, math.ceil(math.sqrt(n / CELL)))
    cells = bucketed(points, "x", buckets=side, out="i")
    cells = bucketed(cells, "y", buckets=side, out="j") if side > 1 else cells.withColumn("j", F.lit(0))
    flat = "i int, j int, kind int, x double, y double, front int"
    rows = cells.select("i", "j", F.lit(1).alias("kind"), "x", "y", F.lit(0).alias("front"), (F.col("i") + F.col("j")).alias("round"))
    path = new_path(points.sparkSession, "grid")
    rows.write.partitionBy("round").parquet(path)
    rows = points.sparkSession.read.schema(flat + ", round int").parquet(path)
    edges, done = None, None
    for k in range(2 * side - 1):
        mine = rows.where(F.col("round") == k).drop("round")
        if edges is not None:
            mine = mine.unionByName(edges)
        # Left steps come first, then lower steps and points along x, a step before the points of its place.
        order = [F.col("kind") != LEFT, F.when(F.col("kind") != LEFT, F.col("x")), F.col("kind") == POINT, "y", "front"]
        placed = (mine.repartition("i", "j") if side > 1 else mine.coalesce(1)).sortWithinPartitions("i", "j", *order)
        out = staged(placed.mapInPandas(_cell_fronts, flat), "fronts")
        part = out.where(F.col("kind") == POINT).select("x", "y", "front")
        done = part if done is None else done.unionByName(part)
        edges = out.where(F.col("kind") != POINT).where((F.col("i") < side) & (F.col("j") < side))
    return done


#: Rows of a cell: a step of its left edge (y, front), a point, a step of its lower edge (x, front).
LEFT, POINT, LOWER = 0, 1, 2


def _cell_fronts(batches):
    """Points of cells with their fronts, and the steps of the right and upper edges as those of the next cells."""
    import pandas as pd

    cell, tops, level, seen = None, [], 0, 0  # tops[f - 1]: least y of front f in the cell, or from its left edge; fronts up to level cover all of it

    def right() -> list[tuple]:
        i, j = cell
        steps = [(i + 1, j, LEFT, None, float("-inf"), level)] if level else []
        return steps + [(i + 1, j, LEFT, None, y, f + 1) for f, y in enumerate(tops) if f >= level]

    names = ["i", "j", "kind", "x", "y", "front"]
    for b in batches:
        out = []
        for i, j, kind, x, y, front in zip(*(b[c].tolist() for c in names)):
            if cell != (i, j):
                if cell is not None:
                    out += right()
                cell, tops, level, seen = (i, j), [], 0, 0
            if kind == LEFT:
                # Steps come by height; a front is at or below the first step that reaches it.
                tops += [y] * (front - len(tops))
                if y == float("-inf"):
                    level = max(level, front)
                continue
            if kind == LOWER:
                if front > level:
                    level = front
                    tops[: len(tops)] = [float("-inf")] * min(level, len(tops)) + tops[level:]
                    tops += [float("-inf")] * (level - len(tops))
                if level > seen:
                    seen = level
                    out.append((i, j + 1, LOWER, x, None, seen))
                continue
            f = bisect_right(tops, y)
            if f == len(tops):
                tops.append(y)
            else:
                tops[f] = y
            out.append((i, j, POINT, x, y, f + 1))
            if f + 1 > seen:
                seen = f + 1
                out.append((i, j + 1, LOWER, x, None, seen))
        yield pd.DataFrame(out, columns=names)
    if cell is not None:
        yield pd.DataFrame(right(), columns=names)


def pareto_many(values: DataFrame, keys: list[str], dims: dict[str, bool], base: float = 0.0, block: int = 5000) -> DataFrame:
    """As ``pareto`` for any number of values; ``dims`` says of each whether more is better.

    Front after front is peeled off.  Points that are equal are one.  The rest
    are put in the order of the sum of their values, which no point beaten by
    another comes before: so points are held against blocks of ``block`` points
    in that order, block by block, by all tasks; of a block only points that no
    point before has beaten are sent, and what is beaten is dropped at once.
    """
    import numpy as np

    names = list(dims)
    signed = [(-F.col(c) if up else F.col(c)).cast("double").alias(f"_d{i}") for i, (c, up) in enumerate(dims.items())]
    d = [f"_d{i}" for i in range(len(names))]
    every = staged(values.select(*keys, *signed).dropna(subset=d), "points")
    left = bucketed(every.select(*d).distinct().withColumn("_sum", sum((F.col(c) for c in d), F.lit(0.0))), "_sum", *d)
    schema = left.schema

    def beaten(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), dtype=bool)
        for k in range(0, len(p), 256):
            c = p[k : k + 256, None, :]
            out[k : k + 256] = ((q[None] <= c).all(axis=2) & (q[None] < c).any(axis=2)).any(axis=1)
        return out

    done, front = None, 0
    while not left.isEmpty():
        front += 1
        candidates, here = left, None
        while True:
            first = candidates.orderBy("_sum", *d).limit(block).select(*d).collect()  # at most ``block`` rows
            if not first:
                break
            q = np.array([tuple(r) for r in first], dtype=float)
            q = q[~beaten(q, q)]

            def against(batches, q=q):
                for b in batches:
                    p = b[d].to_numpy(float)
                    own = (p[:, None, :] == q[None]).all(axis=2).any(axis=1) if len(p) else np.zeros(0, bool)
                    keep = ~beaten(p, q) if len(p) else np.zeros(0, bool)
                    yield b[keep].assign(_on=own[keep])

            split = staged(candidates.mapInPandas(against, schema.simpleString()[7:-1].replace(":", " ") + ", _on boolean"), "candidates")
            mine = split.where("_on").select(*d)
            here = mine if here is None else here.unionByName(mine)
            candidates = split.where("not _on").drop("_on")
        part = staged(here.withColumn("front", F.lit(front)), "front")
        done = part if done is None else done.unionByName(part)
        left = staged(left.join(part.select(*d), d, "left_anti"), "left")
    if done is None:
        return values.select(*keys, F.lit(0.0).alias("weight")).limit(0)
    return _weights(every.join(done, d), keys, base)


def stability_pareto(sampled: DataFrame, keys: list[str], steps: int, base: float = 0.0) -> DataFrame:
    """Pareto fronts of a high mean and a low deviation."""
    m = _moments(sampled, keys, steps).select(*keys, "mean", F.sqrt(F.col("squares") / (steps - 1)).alias("dev"))
    # Values that differ by rounding only are the same.
    m = m.select(*keys, F.round("mean", 9).alias("mean"), F.round("dev", 9).alias("dev"))
    return pareto(m, keys, "mean", "dev", True, False, base)
