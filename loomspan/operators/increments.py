"""Processing only new or changed records, with processed numbers kept as intervals.

Sequence numbers that were processed are kept as disjoint intervals.  The
numbers to process are the available ones less these intervals: gaps are found
wherever they lie, so records that were committed late, below the highest
number seen, are taken up as well, and none is taken up twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.plans.commits import CommitLog
from loomspan.plans.runtime import shared_dir, staged

#: Numbers in one block.  Intervals are cut at block borders, so that blocks are
#: worked on apart from each other and no task holds more than one at a time.
BLOCK = 1 << 16
#: Longest spans of processed numbers that are pushed into the scan of a source, to skip what lies in them.
SPANS = 16
#: Outputs that a commit lists itself; earlier ones are in the commits it points to.
LISTED = 64


def _block(seq):
    return F.shiftright(seq.cast("bigint"), 16)


def intervals(numbers: DataFrame, seq: str = "seq") -> DataFrame:
    """(block, lo, hi): the numbers as disjoint, maximal intervals within blocks.

    Repeated numbers count once, nulls are passed over, negative numbers are
    allowed.  An empty table gives no intervals.
    """
    n = numbers.where(F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("n")).distinct()
    n = n.withColumn("block", _block(F.col("n")))
    w = Window.partitionBy("block").orderBy("n")
    return n.withColumn("island", F.col("n") - F.row_number().over(w)).groupBy("block", "island").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("island")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two sets of intervals, again disjoint and maximal within blocks."""
    u = a.select("block", "lo", "hi").unionByName(b.select("block", "lo", "hi"))
    w = Window.partitionBy("block").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("starts", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    u = u.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return u.groupBy("block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def subtract(rows: DataFrame, seq: str, done: DataFrame) -> DataFrame:
    """The rows whose number lies in no interval of ``done``, with their columns unchanged.

    Rows and interval starts of a block are sorted together and each row looks
    at the last interval that starts at or before it: no range join.  Rows with
    a null number can't be marked as processed and are not returned.
    """
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    r = rows.where(F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("hi"), payload.alias("payload"))
    d = done.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), "hi", F.lit(None).cast(r.schema["payload"].dataType).alias("payload"))
    both = r.unionByName(d).withColumn("block", _block(F.col("at")))
    w = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_ = both.withColumn("upto", F.max("hi").over(w)).where((F.col("kind") == 1) & (F.col("upto").isNull() | (F.col("upto") < F.col("at"))))
    return open_.select("payload.*")


def spans(done: DataFrame, most: int = SPANS) -> list[list[int]]:
    """The longest stretches of numbers without a gap, at most ``most``: a hint for scans, which changes no result.

    Full blocks that follow each other are joined within 1024 blocks where they
    lie; only these stretches, the longest 4096 of them, reach the driver.
    """
    full = done.where((F.col("lo") == F.col("block") * BLOCK) & (F.col("hi") == F.col("lo") + BLOCK - 1)).select("block", F.floor(F.col("block") / 1024).alias("part"))
    runs = full.withColumn("island", F.col("block") - F.row_number().over(Window.partitionBy("part").orderBy("block")))
    runs = runs.groupBy("part", "island").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    got = sorted((r["first"], r["last"]) for r in runs.orderBy(F.desc(F.col("last") - F.col("first")), "first").limit(4096).collect())
    out: list[list[int]] = []
    for first, last in got:
        if out and out[-1][1] + 1 == first:
            out[-1][1] = last
        else:
            out.append([first, last])
    longest = sorted(out, key=lambda x: x[0] - x[1])[:most]
    return sorted([a * BLOCK, b * BLOCK + BLOCK - 1] for a, b in longest)


def outside(seq: Column, known: list[list[int]]) -> Column:
    """Whether a number lies in none of these spans; plain comparisons, which reach the scan."""
    keep = F.lit(True)
    for lo, hi in known:
        keep = keep & ((seq < lo) | (seq > hi))
    return keep


class Ledger:
    """Processed numbers of one consumer, committed together with its output.

    ``run`` first fixes the numbers it takes (intervals in the folder), then
    writes their output, and last puts down one small commit file that names
    both; until that file is there neither is seen.  A run that fails anywhere,
    while the commit is written too, leaves the ledger as it was, and the next
    run takes the same numbers again.  Two runs at the same time can't both
    commit: the second finds its number taken, and fails.

    Only the last commit is read to begin with, by the file system; it holds the
    longest spans without a gap, so that a scan skips what is in them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/ledger").rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def commits(self) -> int:
        """Number of commits that count."""
        last = self.log.last()[1]
        return 0 if last is None else last["count"]

    def _done(self, last: dict | None) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], "block bigint, lo bigint, hi bigint")
        return self.spark.read.schema("block bigint, lo bigint, hi bigint").parquet(last["intervals"])

    def done(self) -> DataFrame:
        """All processed intervals."""
        return self._done(self.log.last()[1])

    def output(self) -> DataFrame | None:
        """The output of all committed runs."""
        c, last = [], self.log.last()[1]
        while last is not None:
            c += last["outputs"]
            last = None if last["earlier"] is None else self.log.read(last["earlier"])
        return self.spark.read.parquet(*c) if c else None

    def _commit(self, number: int, last: dict | None, merged: DataFrame, path: str, output: str | None) -> None:
        merged.write.parquet(path)
        outputs, earlier, count = ([], None, 0) if last is None else (last["outputs"], last["earlier"], last["count"])
        if len(outputs) >= LISTED:
            outputs, earlier = [], last["number"]
        known = spans(self.spark.read.schema(merged.schema).parquet(path))
        self.log.put(number, {"number": number, "count": count + 1, "intervals": path, "outputs": [*outputs, *([output] if output else [])], "earlier": earlier, "spans": known})

    def adopt(self, numbers: DataFrame, seq: str = "seq") -> None:
        """Commit numbers that were processed elsewhere, without output."""
        number, last = self.log.last()
        self._commit(number, last, merge(self._done(last), intervals(numbers, seq)), f"{self.folder}/intervals/{uuid.uuid4().hex[:12]}", None)

    def run(self, source: DataFrame, seq: str, process) -> int:
        """Process the numbers of ``source`` that are not in the ledger; how many numbers were taken.

        ``process`` maps a DataFrame of the rows to one of the output.  Rows of
        one number are taken together; rows without a number are passed over.
        Rows that arrive after the numbers are fixed wait for the next run.
        """
        (number, last), run = self.log.last(), uuid.uuid4().hex[:12]
        done, known = self._done(last), [] if last is None else last["spans"]
        taken, merged, out = (f"{self.folder}/{x}/{run}" for x in ("taken", "intervals", "output"))
        ahead = source.where(outside(F.col(seq), known))  # the rest is processed for certain
        near = done.where(outside(F.col("lo"), known))  # a span is made of whole blocks, so an interval is in it or not
        intervals(subtract(ahead.select(F.col(seq).alias("seq")), "seq", near)).write.parquet(taken)
        new = self.spark.read.schema(done.schema).parquet(taken)
        size, first, end = new.agg(F.sum(F.col("hi") - F.col("lo") + 1), F.min("lo"), F.max("hi")).first()
        if not size:
            return 0
        process(within(ahead.where((F.col(seq) >= first) & (F.col(seq) <= end)), seq, new)).write.parquet(out)
        self._commit(number, last, merge(done, new), merged, out)
        return size


def within(rows: DataFrame, seq: str, chosen: DataFrame) -> DataFrame:
    """The rows whose number lies in one of the intervals ``chosen``, with their columns unchanged.

    Rows of other blocks are dropped before anything is sorted; the rest is
    sorted with the interval starts of its block, as in ``subtract``.
    """
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    r = rows.where(F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("hi"), payload.alias("payload")).withColumn("block", _block(F.col("at")))
    r = r.join(chosen.select("block").distinct(), "block", "left_semi")
    d = chosen.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), "hi", F.lit(None).cast(r.schema["payload"].dataType).alias("payload"), "block")
    w = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = r.select("at", "kind", "hi", "payload", "block").unionByName(d).withColumn("upto", F.max("hi").over(w))
    return both.where((F.col("kind") == 1) & (F.col("upto") >= F.col("at"))).select("payload.*")


def changed_rows(rows: DataFrame, taken: DataFrame, seq: str, key: str, version: str, content: str, ledger: Ledger) -> DataFrame:
    """(seq): the latest row of each key that is not yet taken over, or was with another content.

    ``taken`` holds (key, version) pairs taken over by runs that succeeded.  The
    numbers of these rows are put into ``ledger`` as processed intervals; the
    gaps between them, wherever they lie, are the rows to look at, and the
    ledger commits them with the result.  Of the rows in the gaps one remains
    per key if it is the latest (greatest version, then smallest number), later
    than the version last taken over, and its content is another than that
    version's.  A version last taken over that is not in ``rows`` is another
    content: its key counts as not taken, so that its latest row remains.

    Rows without a key, version or number are no version of anything and are passed
    over; a null content equals a null content only; repeated deliveries of a
    version count once, by the smallest number.  Contents are compared by
    SHA-256.  All aggregates merge before the shuffle, so a key with any number
    of versions is no burden.
    """
    k, v = F.col("_key"), F.col("_version")
    named = lambda df, *more: df.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(F.col(key).alias("_key"), F.col(version).alias("_version"), *more)
    mark = F.coalesce(F.unhex(F.sha2(F.col(content).cast("string"), 256)), F.lit(bytearray(b"none")))
    # Contents are hashed where they are read: no content is shuffled.
    rows = rows.where(F.col(seq).isNotNull()).select(seq, *dict.fromkeys([key, version]), mark.alias("_mark"))
    own = [F.col(seq).alias("_seq"), F.col("_mark")]
    took = staged(named(taken).distinct(), "taken")
    last = took.groupBy("_key").agg(F.max(v).alias("_version"))
    # The rows of versions that were taken over; those taken over last with their contents.
    there = named(rows, *own).join(took.withColumn("_taken", F.lit(True)), ["_key", "_version"], "left_semi").join(last.withColumnRenamed("_version", "_last"), "_key")
    there = staged(there.select("_key", "_seq", F.when(v == F.col("_last"), F.struct(F.col("_seq").alias("at"), F.col("_mark").alias("mark"))).alias("old")), "there")
    old = staged(there.groupBy("_key").agg(F.min("old").alias("old")).where("old is not null").join(last, "_key").select("_key", "_version", F.col("old.mark").alias("mark")), "last-taken")
    ledger.adopt(there.join(old.select("_key"), "_key", "left_semi").select(F.col("_seq").alias("seq")))

    def process(new: DataFrame) -> DataFrame:
        best = named(new, *own).groupBy("_key").agg(F.max(F.struct(v, F.negative(F.col("_seq").cast("bigint")).alias("less"), F.col("_mark").alias("mark"))).alias("new"))
        both = best.join(old.select("_key", F.col("_version").alias("_last"), F.col("mark").alias("was")), "_key", "left")
        kept = both.where(F.col("_last").isNull() | ((F.col("new._version") > F.col("_last")) & (F.col("new.mark") != F.col("was"))))
        return kept.select(F.negative("new.less").cast(rows.schema[seq].dataType).alias(seq))

    ledger.run(rows, seq, process)
    out = ledger.output()
    return rows.select(seq).limit(0) if out is None else out
