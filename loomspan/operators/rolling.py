"""Rolling totals over trailing periods, by contribution deltas.

Each daily amount adds to a period's total on its day and is taken off again
when the period has passed; the running sum of these deltas is the total.  The
total only changes on days that carry a delta, so it is kept as runs of equal
days and spread over single days last of all (or not, for filters on totals).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fractional digits of the fixed-point sums.  Floating sums would leave a rest
#: of about 1e-17 where an amount is added and taken off, and never be zero.
SCALE = 12
#: Amounts of a row that fixed point can hold: with these, 10 ** 7 rows of a node and period can't overflow it.
MOST = 1e18


def latest_rows(df: DataFrame, key: str, order: str, keep: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each ``key``; only ``keep`` columns.

    Ties go to the greatest values of ``keep`` in turn, so repeated rows give
    one row.  A null ``order`` is older than any other; rows with a null key
    are no versions of one another and are all kept.
    """
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in keep])).alias("_best")
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(*[F.col(f"_best.{c}").alias(c) for c in keep])
    return known.unionByName(df.where(F.col(key).isNull()).select(*keep))


def daily_amounts(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """(node, day_no, amount): the amount of each key column's value per UTC day.

    A row counts once for each different non-null value among its ``keys``
    columns.  A null ``value`` counts as 0; a null or NaN-valued amount never
    arises (NaN counts as 0 too).  Rows without ``ts`` belong to no day and are
    passed over.  The sum is exact to ``SCALE`` digits after the point.  An
    infinite amount counts as 0 like NaN; a finite one above MOST in size raises
    an error that names it, as no exact total could hold it.
    """
    day = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000).cast("int").alias("day_no")
    v = F.col(value).cast("double")
    fits = F.when(F.abs(v) <= MOST, v.cast(f"decimal(38,{SCALE})")).otherwise(F.raise_error(F.concat(F.lit("an amount is too large for exact totals: "), v.cast("string"))))
    amount = F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), fits), F.lit(0).cast(f"decimal(38,{SCALE})")).alias("amount")
    ends = F.explode(F.array_distinct(F.array(*[F.col(k).cast("bigint") for k in keys]))).alias("node")
    flat = df.where(F.col(ts).isNotNull()).select(ends, day, amount).where(F.col("node").isNotNull())
    return flat.groupBy("node", "day_no").agg(F.sum("amount").cast(f"decimal(38,{SCALE})").alias("amount"))


def trailing_runs(daily: DataFrame, periods: Sequence[int], first_day: int, last_day: int) -> DataFrame:
    """(node, run_from, run_to, total_P ...): runs of days with equal totals.

    ``daily`` is (node, day_no, amount).  Runs cover first_day..last_day of each
    node without holes; amounts from before first_day count into the periods
    that reach back to them.  One shuffle by node, after ``daily`` has been
    summed up: at most one row per node and day arrives, however hot the node.
    """
    periods = list(periods)
    zero = F.lit(0).cast(f"decimal(38,{SCALE})")
    cols = [f"d{p}" for p in periods]

    def delta(day: Column, plus: bool, only: int | None) -> Column:
        parts = [day.alias("day_no")]
        for p in periods:
            x = F.col("amount") if plus else (-F.col("amount") if p == only else zero)
            parts.append(x.cast(f"decimal(38,{SCALE})").alias(f"d{p}"))
        return F.struct(*parts)

    deltas = F.array(delta(F.col("day_no"), True, None), *[delta(F.col("day_no") + p, False, p) for p in periods])
    steps = (
        daily.where(F.col("day_no") <= last_day)
        .repartition("node")
        .select("node", F.explode(deltas).alias("x"))
        .select("node", F.greatest("x.day_no", F.lit(first_day)).alias("day_no"), *[f"x.{c}" for c in cols])
        .where(F.col("day_no") <= last_day)
        .groupBy("node", "day_no")
        .agg(*[F.sum(c).cast(f"decimal(38,{SCALE})").alias(c) for c in cols])
    )
    w = Window.partitionBy("node").orderBy("day_no")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = steps.select(
        "node",
        F.col("day_no").alias("run_from"),
        (F.lead("day_no", 1, last_day + 1).over(w) - 1).cast("int").alias("run_to"),
        F.lag("day_no").over(w).isNull().alias("is_first"),
        *[F.sum(c).over(running).cast(f"decimal(38,{SCALE})").alias(f"total_{p}") for p, c in zip(periods, cols)],
    )
    own = F.struct(F.col("run_from"), F.col("run_to"), *[F.col(f"total_{p}") for p in periods])
    before = F.struct(F.lit(first_day).cast("int").alias("run_from"), (F.col("run_from") - 1).cast("int").alias("run_to"), *[zero.alias(f"total_{p}") for p in periods])
    both = F.when(F.col("is_first") & (F.col("run_from") > first_day), F.array(before, own)).otherwise(F.array(own))
    return runs.select("node", F.explode(both).alias("r")).select("node", "r.run_from", "r.run_to", *[f"r.total_{p}" for p in periods])


def spread(runs: DataFrame) -> DataFrame:
    """One row for each day of each run: (node, day_no, other columns of runs)."""
    rest = [c for c in runs.columns if c not in ("node", "run_from", "run_to")]
    return runs.select("node", F.explode(F.sequence("run_from", "run_to")).alias("day_no"), *rest)


def trailing_totals(df: DataFrame, keys: Sequence[str], ts: str, value: str, periods: Sequence[int], first_day: int, last_day: int) -> DataFrame:
    """(node, day_no, total_P, avg_P ...) for each node and each day in the range.

    Nodes are the non-null values of the ``keys`` columns on rows up to
    ``last_day``; a node without activity in a period has total and average 0.
    The average divides by the length of the period, active days or not.  An
    empty table gives no rows.  Other columns of ``df`` are ignored.
    """
    days = spread(trailing_runs(daily_amounts(df, keys, ts, value), periods, first_day, last_day))
    out = [F.col("node"), F.col("day_no")]
    for p in periods:
        t = F.col(f"total_{p}").cast("double")
        out += [t.alias(f"total_{p}"), (t / p).alias(f"avg_{p}")]
    return days.select(*out)
