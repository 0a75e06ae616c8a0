"""Order over a whole table without bringing it into one task.

Rows are put into buckets that follow each other in the order; what a bucket
needs to know of those before it is one row per bucket.  There are as many
buckets as Spark makes partitions, fewer on small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.runtime import staged


def bucketed(df: DataFrame, *order: Column | str, buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """The table, written down, with a bucket number that doesn't fall along ``order``.

    Rows that are equal in all of ``order`` share a bucket, nulls are in the
    first; a value of the first column that many rows have is split by the next.
    """
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    return staged(ranged.withColumn(out, F.spark_partition_id()), "ordered")


def numbered(df: DataFrame, order: list[Column], out: str = "number") -> DataFrame:
    """Add 0, 1, 2 ... in the order of ``order``."""
    b = bucketed(df, *order)
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row per bucket
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return b.join(F.broadcast(before), "_bucket").withColumn(out, (F.col("_before") + place - 1).cast("bigint")).drop("_bucket", "_before")
