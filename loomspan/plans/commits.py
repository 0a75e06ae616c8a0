"""A log of small commit files, each of which is either whole or not there.

A commit is written under a name of its own first and then renamed to its
number; the rename fails if that number is taken.  A driver that dies at any
point leaves the log as it was, or complete; a file that can't be read (left by
a store without such a rename) is passed over, and its number isn't used again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Numbered JSON documents in a folder; only the last readable one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """All numbers in use, whether readable or not."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        """The document of a number, or None if it is torn; read by the file system, without a job."""
        stream = self._fs().open(self._path(f"{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            got = json.loads(text)
        except ValueError:
            return None
        return got if isinstance(got, dict) else None

    def last(self) -> tuple[int, dict | None]:
        """(the number the next commit takes, the last readable document or None)."""
        used = self.numbers()
        for n in reversed(used):
            got = self.read(n)
            if got is not None:
                return used[-1] + 1, got
        return (used[-1] + 1 if used else 0), None

    def put(self, number: int, content: dict) -> None:
        """Commit ``content`` under ``number``; FileExistsError if another has done so meanwhile."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, target = self._path(f".{uuid.uuid4().hex}.draft"), self._path(f"{number:012d}.json")
        fs = self._fs()
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise FileExistsError(f"commit {number} exists already") from e
            raise
