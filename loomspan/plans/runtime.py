"""Session settings, and the one way in which this library cuts lineage.

Lineage is cut by writing a table into the folder that all executors share
(``spark.checkpoint.dir``) and reading it again, so a lost executor never costs
the result of a finished step.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors.

    ``spark.checkpoint.dir`` decides.  Only a session in local mode that leaves
    it unset gets a folder of its own; a cluster without one is an error, as a
    machine-local folder would not be seen by the other machines.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_LOCAL_DIR:
        _OWN_LOCAL_DIR.append(tempfile.mkdtemp(prefix="loomspan-"))
    return "file://" + _OWN_LOCAL_DIR[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomspan-{os.getpid()}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


#: Shuffle files go when the action that made them ends, not when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return it as read from there; the table is all that stays on disk."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, before) if before is not None else spark.conf.unset(SHUFFLES_END)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each session.

    For drivers that have the package on their own path only; where it is
    installed on all machines this isn't needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomspan_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="loomspan-code-")) / "loomspan.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._loomspan_shipped = True


def local_session(app: str = "loomspan", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
