"""Per-key results on tables in which a few keys hold most rows.

Nothing here sends the rows of a key to one task.  Counts and sums merge before
they are shuffled; heavy keys are selected, and quantiles of hot keys found, by
histograms that are refined round by round until the ranks resolve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.runtime import staged

#: Bins of one round of refinement.
BINS = 1024
#: A key with more rows than this is hot: its values are never brought together.
HOT_ROWS = 10_000
#: Digits after the point of exact sums, and the amount from which a sum is no longer kept in them.
SCALE, MOST = 12, 1e12


def exact_sum(value: Column) -> Column:
    """Sum as a double, which doesn't depend on the order of rows while amounts are below MOST: those are added in fixed point.

    Amounts from MOST on, which fixed point can't hold, are added as doubles.
    """
    small = F.abs(value) < MOST
    fixed = F.coalesce(F.sum(F.when(small, value).cast(f"decimal(26,{SCALE})")).cast("double"), F.lit(0.0))
    return fixed + F.coalesce(F.sum(F.when(~small, value)), F.lit(0.0))


def key_totals(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(key_text, n_rows[, n_values, total]) for each non-null key.

    Every map task sends one partial row for each key it saw, however many rows
    the key has.  Null (and NaN) values count as rows and add nothing; a key
    without values has total 0; values of any size are added, see ``exact_sum``.
    An empty table gives no rows.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if value is not None:
        v = F.col(value).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias("n_values"), exact_sum(v).alias("total")]
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key_text")).agg(*aggs)


def heavy_keys(df: DataFrame, key: str, share: float, bits: int = 16) -> DataFrame:
    """(key_text, n_rows) of the keys with at least ``share`` of all rows, nulls counting among the rows.

    Exact selection by ranks: with the rows in the order of their keys' hashes
    (64 bits, read as a number), a key with m rows covers one of the ranks m,
    2m, 3m ...  These ranks are found by histograms of the hash, refined round
    by round: of the bins of a round those that hold such a rank are cut into
    2 ** ``bits`` finer ones, until a bin holds one hash only.  A bin with fewer
    than m rows needs no finer look, as no key in it has m.  Counts merge before
    the shuffle, at most (1 / share) * 2 ** ``bits`` of them leave a task, and
    at most 1 / share bins are known to the driver.  The keys of the hashes that
    are left are counted exactly last.  An empty table gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    text = F.col(key).cast("string")
    code = F.xxhash64(text)
    total, least, used, inside, found = None, None, 0, F.lit(True), []
    while used < 64:
        bits_here = min(bits, 64 - used)
        used += bits_here
        here = F.shiftrightunsigned(code, 64 - used) if used < 64 else code
        hist = df.where(inside).groupBy(F.when(text.isNotNull(), here).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("lo"), F.max(code).alias("hi"))
        if total is None:
            hist = staged(hist, "histogram")
            total = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            least = max(1, math.ceil(total * Decimal(repr(float(share)))))  # 7 of 100 is 7 %, which in floating numbers it isn't
        bins = hist.where(F.col("bin").isNotNull() & (F.col("n") >= F.lit(least))).select("bin", "lo", "hi").collect()  # at most 1 / share rows
        found += [r["lo"] for r in bins if r["lo"] == r["hi"]]
        open_bins = [r["bin"] for r in bins if r["lo"] != r["hi"]]
        if not open_bins:
            break
        inside = text.isNotNull() & here.isin(open_bins)
    mine = df.where(text.isNotNull() & code.isin(found)) if found else df.where(F.lit(False))
    return mine.groupBy(text.alias("key_text")).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= F.lit(least or 1))


def key_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float], hot_rows: int = HOT_ROWS, bins: int = BINS) -> DataFrame:
    """(key_text, prob, quantile): for each key the smallest value with at least ceil(prob * n) values up to it.

    Exact for every key.  Rows are merged to (key, value, count) first.  Keys
    with at most ``hot_rows`` rows are ranked in a window.  Those with more are
    never gathered, however many there are: their counts are written down once,
    spread over parts by a hash of the value; each round counts the values
    between the current limits of each rank in ``bins`` bins, with minimum and
    maximum of each, and the bin that holds the rank gives the next limits,
    until they coincide.  Null keys and null or NaN values are passed over; ties
    count as often as they occur; a key without values gives no row; infinite
    values are less and greater than all others, and come out as such.
    """
    probs = sorted({float(p) for p in probs})
    if not probs or probs[0] < 0 or probs[-1] > 1:
        raise ValueError("probs must lie between 0 and 1")
    v = F.col(value).cast("double")
    flat = df.where(F.col(key).isNotNull() & v.isNotNull() & ~F.isnan(v)).groupBy(F.col(key).cast("string").alias("key_text"), (v + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    flat = staged(flat, "counts")
    inf = float("inf")
    finite = F.when(F.abs("v") < inf, F.col("v"))
    n_of = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    sizes = flat.groupBy("key_text").agg(F.sum("c").alias("n"), n_of(F.col("v") == -inf).alias("below"), n_of(F.col("v") == inf).alias("above"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    hot = staged(sizes.where(F.col("n") > hot_rows), "hot")
    ranks = F.array(*[F.struct(F.lit(p).alias("prob"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("bigint").alias("rank")) for p in probs])

    # No join here is told to broadcast; of one that isn't, the hot keys' side is split by AQE.
    cold = flat.join(hot.select("key_text"), "key_text", "left_anti")
    by = Window.partitionBy("key_text")
    ranked = cold.select("key_text", "v", "c", F.sum("c").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(by).alias("n"))
    found = ranked.select("key_text", "v", "c", "upto", F.explode(ranks).alias("r")).where((F.col("r.rank") <= F.col("upto")) & (F.col("r.rank") > F.col("upto") - F.col("c")))
    done = [found.select("key_text", F.col("r.prob").alias("prob"), F.col("v").alias("quantile"))]

    # What the infinite values settle is done; ranks among the finite values count from the first of these.
    state = hot.select("key_text", "n", "below", "above", "lo", "hi", F.explode(ranks).alias("r")).select("key_text", "n", "below", "above", "lo", "hi", "r.prob", "r.rank")
    end = F.when(F.col("rank") <= F.col("below"), -inf).when(F.col("rank") > F.col("n") - F.col("above"), inf)
    state = staged(state.select("key_text", F.ceil(F.col("n") / max(1, hot_rows)).cast("int").alias("parts"), F.coalesce(end, "lo").alias("lo"), F.coalesce(end, "hi").alias("hi"), "prob", (F.col("rank") - F.col("below")).alias("rank")), "ranks")
    part = lambda: F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part")
    values = None
    while True:
        done.append(state.where(F.col("lo") == F.col("hi")).select("key_text", "prob", F.col("lo").alias("quantile")))
        open_ranks = state.where(F.col("lo") < F.col("hi"))
        if open_ranks.isEmpty():
            break
        if values is None:
            keyed = open_ranks.select("key_text", "parts").distinct()
            values = staged(flat.where(F.abs("v") < inf).join(keyed, "key_text").select("key_text", part(), "v", "c"), "hot-values")
        half = lambda c: F.col(c) / 2  # noqa: E731  halves, as hi - lo may overflow
        bin_no = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * bins), F.lit(bins - 1))
        spread = open_ranks.select("key_text", "parts", "lo", "hi", "prob", "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        hist = (
            values.join(spread, ["key_text", "part"])
            .where(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy("key_text", "parts", "prob", "rank", bin_no.alias("bin"))
            .agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        upto = F.sum("c").over(Window.partitionBy("key_text", "prob").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most ``bins`` rows each
        state = staged(
            hist.withColumn("upto", upto)
            .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
            .select("key_text", "parts", "lo", "hi", "prob", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")),
            "ranks",
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
