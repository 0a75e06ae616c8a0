"""Items that appear together: a pair table kept up to date by signed deltas.

Baskets that changed give -1 for each pair and item they held and +1 for each
they hold now; the deltas are merged into counts that are kept in hash buckets,
of which only those touched are written anew.  Each pair is kept with the counts
of its two items; where an item's count changed, the buckets of its pairs are
touched too.  So scores are read off the table, and only those affected by an
update are worked out anew.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans.commits import CommitLog
from loomspan.plans.runtime import new_path, staged

#: Rows of a bucket, about: with more, a table gets more buckets; and the fewest buckets.
ROWS, LEAST_BUCKETS = 2_000_000, 16
#: Items of a part of a basket, about; a basket with more is cut into parts, and each pair of parts is a key of its own.
PART = 2048


def baskets(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(k0, k1 ..., item): each item once per basket; rows with a null in a key or the item don't count."""
    cols = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    known = df
    for c in (*keys, item):
        known = known.where(F.col(c).isNotNull())
    return known.select(*cols, F.col(item).alias("item")).distinct()


def _sizes(both: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(keys, size) of each basket, written down, and (keys, parts) of those that are to be cut into parts, if there are any."""
    sizes = staged(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), "sizes")
    large = sizes.where(F.col("size") > PART).select(*keys, F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    return sizes, None if large.isEmpty() else large


def _joined(both: DataFrame, keys: list[str], large: DataFrame | None) -> DataFrame:
    """Each basket joined with itself: (keys, a, b, others_a, others_b) with a < b; large baskets are spread over pairs of parts."""
    rest = [c for c in both.columns if c not in ("item", *keys)]
    x = [F.col("item").alias("a"), *[F.col(c).alias(f"{c}_a") for c in rest]]
    y = [F.col("item").alias("b"), *[F.col(c).alias(f"{c}_b") for c in rest]]
    if large is None:
        return both.select(*keys, *x).join(both.select(*keys, *y), keys).where("a < b")
    m = both.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part, every = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return m.select(*keys, *x, part.alias("px"), every.alias("py")).join(m.select(*keys, *y, every.alias("px"), part.alias("py")), [*keys, "px", "py"]).where("a < b")


def _signed_pairs(both: DataFrame, on: list[str], large: DataFrame | None) -> DataFrame:
    """(a, b, c): signed changes of pairs, of baskets with a sign."""
    return _joined(both.select(*on, "item"), on, large).groupBy("a", "b").agg(F.sum("sign").alias("c")).where("c <> 0")


class PairTable:
    """Counts of pairs, items and baskets in a folder of hash buckets.

    A commit names the folder of each bucket; it is put down last and in one
    step, so a run that fails at any point leaves the table as it was, and of
    two runs at a time the second fails without touching what the first wrote.
    Without ``folder`` a new one is made in the shared folder.  The number of
    buckets grows with the table.

    A table for pairs in at least ``least`` baskets and with a lift of at least
    ``lift`` counts only pairs that can get there, which changes none of them: a
    pair has no more baskets than its rarer item, so items in fewer than
    ``least`` baskets, or in more than 1 / ``lift`` of all, have no such pair.
    A basket of very many items then costs what its eligible items cost.  An
    item that becomes eligible is counted from all baskets, and stays counted.
    """

    SCHEMAS = {"pairs": "a string, b string, c bigint, n_a bigint, n_b bigint", "items": "item string, n bigint", "counted": "item string, n bigint"}
    KEYS = {"pairs": ["a", "b"], "items": ["item"], "counted": ["item"]}

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 1, lift: float = 0.0):
        self.spark, self.folder = spark, folder or new_path(spark, "pairs")
        self.log = CommitLog(spark, f"{self.folder}/commits")
        self._empty = {"n": 0, "least": least, "lift": lift, "places": {k: {} for k in self.KEYS}, "buckets": {k: 0 for k in self.KEYS}, "rows": {k: 0 for k in self.KEYS}}
        self._load()

    def _load(self) -> None:
        self.number, last = self.log.last()
        self.state = last or self._empty

    @property
    def n(self) -> int:
        return self.state["n"]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, state: dict, kind: str, only: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in state["places"][kind].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.SCHEMAS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMAS[kind])

    def pairs(self) -> DataFrame:
        return self._read(self.state, "pairs").select("a", "b", "c")

    def items(self) -> DataFrame:
        return self._read(self.state, "items")

    def _merge(self, state: dict, kind: str, delta: DataFrame, run: str, changed: DataFrame | None = None) -> None:
        """Merge signed counts into the buckets of ``kind``; for pairs, ``changed`` are the items whose counts changed."""
        keys, count = self.KEYS[kind], "c" if kind == "pairs" else "n"
        delta = staged(delta.groupBy(*keys).agg(F.sum(count).alias(count)) if kind == "pairs" else delta.select(*keys, count), "delta")
        places, rows = state["places"][kind], state["rows"][kind] + delta.count()
        buckets = max(state["buckets"][kind], LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, rows / ROWS))))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        if buckets > state["buckets"][kind]:
            touched = None  # all are written anew
        else:
            marks = delta.select(bucket.alias("bucket")).distinct()
            if changed is not None:
                known = self._read(state, kind).select("a", "b")
                for side in "ab":
                    marks = marks.unionByName(known.join(changed.select(F.col("item").alias(side)), side, "left_semi").select(bucket.alias("bucket")).distinct())
            touched = {r[0] for r in marks.distinct().collect()}  # a number per bucket
        merged = self._read(state, kind, touched).select(*keys, count).unionByName(delta).groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) != 0) if places else delta.where(F.col(count) != 0)
        if kind == "pairs":
            items = self._read(state, "items")
            merged = merged.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        out = f"{self.folder}/{kind}/{run}"
        merged.withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(out)
        fs, p = self._fs(out)
        written = {s.getPath().getName().split("=")[1]: s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        kept = {} if touched is None else {b: q for b, q in places.items() if int(b) not in touched}
        state["places"][kind], state["buckets"][kind], state["rows"][kind] = {**kept, **written}, buckets, rows

    def apply(self, old: DataFrame | None, new: DataFrame | None, every: DataFrame | None = None, stored: bool = False) -> None:
        """Replace the contents ``old`` of some baskets by ``new``; both are written down first unless they are ``stored`` tables.

        ``every`` are all baskets as they are now; a table that doesn't count
        all items needs them where items become eligible, unless it is new.
        """
        if old is None and new is None:
            return
        self._load()
        state = {k: {x: dict(y) if isinstance(y, dict) else y for x, y in v.items()} if isinstance(v, dict) else v for k, v in self.state.items()}
        run, first = uuid.uuid4().hex[:12], not self.state["places"]["items"]
        parts = [d.withColumn("sign", F.lit(s).cast("bigint")) for d, s in ((old, -1), (new, 1)) if d is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if not stored:
            both = staged(both, "baskets")  # read several times below
        on = [*[c for c in both.columns if c.startswith("k")], "sign"]
        sizes, large = _sizes(both, on)
        items = staged(both.groupBy("item").agg(F.sum("sign").alias("n")).where("n <> 0"), "items")
        self._merge(state, "items", items, run)
        state["n"] += sizes.agg(F.coalesce(F.sum("sign"), F.lit(0))).first()[0]
        if state["least"] > 1 or state["lift"] > 1:
            pairs = self._eligible_pairs(state, both, on, large, every, run, first)
        else:
            pairs = _signed_pairs(both, on, large)
        self._merge(state, "pairs", pairs, run, None if first else items)
        self.log.put(self.number, state)
        self._load()

    def _eligible_pairs(self, state: dict, both: DataFrame, on: list[str], large: DataFrame | None, every: DataFrame | None, run: str, first: bool) -> DataFrame:
        """Changes of pairs of items counted so far, and whole counts of pairs with an item that isn't yet."""
        counted = self._read(state, "counted").select("item")
        items = self._read(state, "items")
        fresh = items.where((F.col("n") >= state["least"]) & (F.col("n") * F.lit(float(state["lift"])) <= state["n"])).select("item").join(counted, "item", "left_anti")
        fresh = staged(fresh, "fresh")
        if fresh.isEmpty():
            return _signed_pairs(both.join(counted, "item", "left_semi"), on, large)
        if first and every is None:
            whole = _signed_pairs(both.join(fresh, "item", "left_semi"), on, large)
        elif every is None:
            raise ValueError("items became eligible: all baskets are needed")
        else:
            # Only baskets with an item that became eligible are looked at again.
            keys = [c for c in every.columns if c.startswith("k")]
            touched = every.join(fresh, "item", "left_semi").select(*keys).distinct()
            marks = counted.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))
            again = staged(every.select(*keys, "item").join(touched, keys, "left_semi").join(marks, "item"), "again")
            whole = _joined(again, keys, _sizes(again, keys)[1]).where("is_new_a or is_new_b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
        known = bool(state["places"]["counted"])
        changes = _signed_pairs(both.join(staged(counted, "counted"), "item", "left_semi"), on, large).unionByName(whole) if known else whole
        self._merge(state, "counted", fresh.withColumn("n", F.lit(1).cast("bigint")), run)
        return changes

    def scores(self, least: int = 1) -> DataFrame:
        """(a, b, c, n_a, n_b, n, lift) of pairs in at least ``least`` baskets; lift is c * n / (n_a * n_b)."""
        p = self._read(self.state, "pairs").where(F.col("c") >= least)
        return p.select("a", "b", "c", "n_a", "n_b", F.lit(self.n).cast("bigint").alias("n"), (F.col("c") * F.lit(self.n) / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))


def together(df: DataFrame, keys: Sequence[str], item: str, folder: str | None = None, least: int = 1, lift: float = 0.0) -> PairTable:
    """The pair table of all baskets of ``df``; items are compared as text, in byte order."""
    t = PairTable(df.sparkSession, folder, least=least, lift=lift)
    t.apply(None, baskets(df, keys, item).withColumn("item", F.col("item").cast("string")))
    return t
