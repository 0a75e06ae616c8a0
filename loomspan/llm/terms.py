"""Frequency of every distinct value, by a dictionary of dense numbers and blocks of counters.

Distinct values get dense numbers.  Values are encoded, occurrences and records
are counted in arrays that cover a block of numbers each, and the arrays of a
range of numbers are summed up where that range lives.  Text is shuffled once;
after that only numbers are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.runtime import staged

#: Numbers in a block of counters; blocks a task holds before it sends them on; blocks in a range whose arrays are summed together.
BLOCK, HELD, RANGE = 256, 4096, 64
#: Fewest buckets of the dictionary, and values in a bucket, about.
BUCKETS, BUCKET_VALUES = 1024, 1_000_000
#: A value in more than this share of the rows is hot, so at most 1 / HOT are; their rows are spread over SALT parts.
HOT, SALT = 0.001, 64


def dictionary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field_name, field_value, n): dense numbers from 0 for the distinct non-null values, with their rows.

    The number is the place within a hash bucket plus the sizes of the buckets
    before it: the same for the same values, wherever they are worked out.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value")) for f in fields]))
    v = df.select(cells.alias("c")).select("c.*").where("field_value is not null").groupBy("field_name", "field_value").agg(F.count(F.lit(1)).alias("n"))
    v = staged(v, "values")
    buckets = max(BUCKETS, v.count() // BUCKET_VALUES)
    v = v.withColumn("bucket", F.pmod(F.xxhash64("field_name", "field_value"), F.lit(buckets)).cast("int"))
    sizes = v.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))  # a row per bucket
    offset = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("field_name", "field_value"))
    return v.join(F.broadcast(offset), "bucket").select((F.col("offset") + place - 1).alias("id"), "field_name", "field_value", "n")


def encode(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Replace (field_name, field_value) of ``cells`` by ``id``; rows of hot values are spread over the tasks."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > total * HOT
    hot = words.where(is_hot).select("field_name", "field_value", F.lit(True).alias("hot"))  # at most 1 / HOT rows
    rest = [c for c in cells.columns if c not in ("field_name", "field_value")]
    salted = cells.join(F.broadcast(hot), ["field_name", "field_value"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*rest), F.lit(SALT))).otherwise(F.lit(0)).cast("int"))
    spread = words.select("id", "field_name", "field_value", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(spread, ["field_name", "field_value", "salt"]).select("id", *rest)


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        ids, rows, records = b.id.to_numpy(), b.rows.to_numpy(), b.records.to_numpy()
        block, slot = ids // BLOCK, ids % BLOCK
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            o = order[lo:hi]
            a = held.setdefault(int(block[o[0]]), np.zeros((2, BLOCK), dtype=np.int64))
            a[0] += np.bincount(slot[o], rows[o], BLOCK).astype(np.int64)
            a[1] += np.bincount(slot[o], records[o], BLOCK).astype(np.int64)
        if len(held) > HELD:
            yield _blocks(held)
            held = {}
    if held:
        yield _blocks(held)


def _blocks(held: dict[int, np.ndarray]) -> pd.DataFrame:
    """The counters of blocks that aren't 0, with their slots: what goes on is no more than the values met."""
    slots = [np.flatnonzero(a[0]).astype(np.int16) for a in held.values()]
    return pd.DataFrame({"block": list(held), "slots": slots, "rows": [a[0][k] for a, k in zip(held.values(), slots)], "records": [a[1][k] for a, k in zip(held.values(), slots)]})


def _sum_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays of a sorted range of blocks; only the block in hand is kept."""
    block, sums = None, None
    for b in batches:
        out = []
        for k, slots, rows, records in zip(b.block, b.slots, b.rows, b.records):
            if k != block:
                if block is not None:
                    out.append((block, sums))
                block, sums = k, np.zeros((2, BLOCK), dtype=np.int64)
            sums[0][slots] += rows
            sums[1][slots] += records
        yield _flat(out)
    if block is not None:
        yield _flat([(block, sums)])


def _flat(blocks: list) -> pd.DataFrame:
    parts = []
    for k, s in blocks:
        at = np.flatnonzero(s[0])
        parts.append(pd.DataFrame({"id": k * BLOCK + at, "n_rows": s[0][at], "n_records": s[1][at]}))
    return pd.concat(parts) if parts else pd.DataFrame({"id": np.zeros(0, np.int64), "n_rows": np.zeros(0, np.int64), "n_records": np.zeros(0, np.int64)})


def term_frequencies(df: DataFrame, fields: Sequence[str], record: str, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """(field_name, field_value, n_rows, n_records, mark) of each distinct value of each field.

    ``n_records`` counts the distinct non-null ``record`` values with it; rows
    with a null record count as rows only.  ``mark`` is 'rare' below
    ``rare_below`` records, 'common' above the share ``common_above`` of all
    distinct records, else null.  Null values are no values, the empty text is
    one.  An empty table gives no rows.
    """
    words = staged(dictionary(df, fields), "dictionary")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value")) for f in fields]))
    flat = df.select(F.col(record).alias("record"), cells.alias("c")).select("record", "c.*").where("field_value is not null")
    seen = flat.groupBy("field_name", "field_value", "record").agg(F.count(F.lit(1)).alias("rows"))
    coded = encode(seen, words).select("id", "rows", F.col("record").isNotNull().cast("bigint").alias("records"))
    blocks = coded.mapInPandas(_accumulate, "block bigint, slots array<smallint>, rows array<bigint>, records array<bigint>")
    # Ranges of numbers are spread by a hash: a partition by sampled limits would work the blocks out twice.
    summed = blocks.repartition(F.shiftright("block", RANGE.bit_length() - 1)).sortWithinPartitions("block").mapInPandas(_sum_ranges, "id bigint, n_rows bigint, n_records bigint")
    records = df.select(record).where(F.col(record).isNotNull()).distinct().count()
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(records * common_above), "common")
    return summed.join(words.select("id", "field_name", "field_value"), "id").select("field_name", "field_value", "n_rows", "n_records", mark.alias("mark"))
