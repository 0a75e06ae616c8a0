"""Text files of edges and nodes, and tab-separated exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.cooccurrence import as_milliseconds

# Node types by letter.
NODE_TYPES = {"L": "LOC", "O": "ORG", "A": "ACT", "D": "DAT", "T": "TER"}


def edge_list(spark: SparkSession, path: str, directed: bool = False, check_order: bool = False) -> DataFrame:
    """(ts, source, target, weight) of lines ``source target weight ts``.

    Parts are set apart by any white space and what follows them is ignored;
    blank lines and those that start with # or ; are skipped; line ends may be
    CRLF.  Of several lines for one edge and time the last wins, whichever end
    it names first if undirected.  ``check_order`` raises ValueError if a time
    is less than one before it.  A file without edges is an error.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\\s+", " ")).alias("line"), F.monotonically_increasing_id().alias("no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))
    p = F.split("line", " ")
    num = lambda k, t: F.get(p, F.lit(k)).try_cast(t)
    rows = lines.where(~F.col("line").rlike("^([#;]|$)")).select("file", "piece", "no", num(0, "bigint").alias("s"), num(1, "bigint").alias("t"), num(2, "double").alias("weight"), num(3, "bigint").alias("ts"))
    rows = rows.where("s >= 0 and t >= 0 and ts >= 0 and weight is not null")
    if check_order:
        from pyspark.sql import Window

        # Within each piece of a file that a task reads, and from one piece to the next: one row per piece.
        inside = rows.withColumn("before", F.lag("ts").over(Window.partitionBy("file", "piece").orderBy("no"))).where("before > ts").select("file")
        borders = rows.groupBy("file", "piece").agg(F.min_by("ts", "no").alias("first"), F.max_by("ts", "no").alias("last"))
        across = borders.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("piece"))).where("before > first").select("file")
        if not inside.unionByName(across).isEmpty():
            raise ValueError("times go back")
    ends = (F.col("s"), F.col("t")) if directed else (F.least("s", "t"), F.greatest("s", "t"))
    edges = rows.select(F.struct("file", "piece", "no").alias("no"), "ts", ends[0].alias("source"), ends[1].alias("target"), "weight").groupBy("ts", "source", "target").agg(F.max_by("weight", "no").alias("weight"))
    if edges.isEmpty():
        raise ValueError(f"no edges in {path}")
    return edges


def as_documents(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, edges) with one document per time; its id is the time."""
    docs = edges.select(F.col("ts").alias("doc_id"), "ts", F.lit(None).cast("string").alias("ext_id")).distinct()
    return docs, edges.select(F.col("ts").alias("doc_id"), "ts", "source", "target", "weight")


def node_list(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    """(node, attrs) of lines ``node TAB attribute ...``; ``key`` names the attributes, set apart by ;.

    Columns beyond the names are ignored, missing ones leave the attribute
    unset, and an empty name takes no column.  Of repeated nodes the first wins.
    """
    names = [k for k in key.split(";") if k]
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("no"))
    p = F.split("line", "\t")
    rows = lines.where(~F.col("line").rlike("^([#;]|\\s*$)")).select("no", F.get(p, F.lit(0)).try_cast("bigint").alias("node"), p.alias("p")).where("node >= 0")
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.get("p", F.lit(i + 1)).alias("value")) for i, n in enumerate(names)]), lambda x: x["value"].isNotNull())
    return rows.select("no", "node", F.map_from_entries(pairs).alias("attrs")).groupBy("node").agg(F.min_by("attrs", "no").alias("attrs"))


def raw_edges(spark: SparkSession, path: str, drop: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(ts, article, id1, id2, outlet, dist) of a tab-separated export with a header line.

    ``drop`` lists (outlet, from, to) ranges of corrupt hours to leave out, as
    timestamps in UTC, the end excluded.
    """
    schema = "id1 string, id2 string, type1 string, type2 string, date string, article string, outlet string, dist string"
    raw = spark.read.schema(schema).option("sep", "\t").csv(path).where("id1 <> 'id1'")
    t = F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss"))
    out = raw.select(as_milliseconds(t).alias("ts"), *[F.col(c).try_cast("bigint").alias(c) for c in ("article", "id1", "id2")], "outlet", F.col("dist").try_cast("int").alias("dist"), t.alias("_t")).where("ts is not null and id1 is not null and id2 is not null and dist is not null")
    for outlet, lo, hi in drop or []:
        out = out.where(~((F.col("outlet") == outlet) & (F.col("_t") >= F.lit(lo).cast("timestamp")) & (F.col("_t") < F.lit(hi).cast("timestamp"))))
    return out.drop("_t")


def raw_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, label, type) of a tab-separated export id, type letter, external id, label."""
    raw = spark.read.schema("id string, kind string, ext string, label string").option("sep", "\t").csv(path).where("not startswith(id, 'id')")
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in NODE_TYPES.items()])
    return raw.select(F.col("id").try_cast("bigint").alias("node"), F.regexp_replace("label", "\t", " ").alias("label"), kind.alias("type")).where("node is not null")


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Text lines ``source TAB target TAB weight TAB ts`` in order of time, one file per range of times."""
    line = F.concat_ws("\t", "source", "target", F.format_string("%f", "weight"), "ts")
    edges.repartitionByRange("ts").sortWithinPartitions("ts", "source", "target").select(line.alias("value")).write.text(path)
