"""Tables kept as snapshots in one folder: each commit writes whole new tables, then one pointer names them.

A commit that fails leaves the old pointer, so the tables change together or not at all.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_parents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows less those of the incoming parents, and the incoming ones."""
    return stored.join(incoming.select("parent_id").distinct(), "parent_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def not_fresh(sections: DataFrame, stored: DataFrame) -> DataFrame:
    """The sections that aren't stored with the same content: those to compile."""
    return sections.join(stored.select("parent_id", "content_hash"), ["parent_id", "content_hash"], "left_anti")


def stale(stored: DataFrame, sections: DataFrame) -> DataFrame:
    """The stored parents of these sections' sources that are no more among them."""
    sources, kept = sections.select(F.col("source").alias("now_source")).distinct(), sections.select(F.col("parent_id").alias("now_parent"))
    mine = stored.join(sources, F.col("source") == F.col("now_source"), "left_semi")
    return mine.join(kept, F.col("parent_id") == F.col("now_parent"), "left_anti")


def kept(df: DataFrame) -> DataFrame:
    """``df``, made at once and kept in the folder of ``spark.checkpoint.dir``, which executors share; a session of one machine
    may have a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirework-"))
    return df.checkpoint()


def check_dimension(points: DataFrame, dim: int) -> None:
    """Raise if any vector has another length."""
    if points.filter(F.size("vector") != dim).limit(1).count():
        raise ValueError(f"vectors must have {dim} dimensions")


class SnapshotStore:
    """Named tables under a folder that Hadoop can write: ``<folder>/v<n>-<writer>/<table>``, and the files
    ``<folder>/current/<n>``, each of which names the folder of its version. No two writers write to one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        at = self._path(f"{self.folder}/current")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()), default=0) if self._fs.exists(at) else 0

    def _folder(self, n: int) -> str:
        """The folder of a committed version, as its pointer says."""
        found = self._fs.open(self._path(f"{self.folder}/current/{n}"))
        try:
            return found.readUTF()
        finally:
            found.close()

    def read(self, table: str, schema: str) -> DataFrame:
        n = self.version()
        path = f"{self._folder(n)}/{table}" if n else ""
        return self.spark.read.schema(schema).parquet(path) if n and self._fs.exists(self._path(path)) else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], keep: int = 2) -> int:
        """Write all tables as the next version and make it current; versions before the last ``keep`` are removed.

        The pointer is created, not replaced: of two writers one succeeds, and the other's files are taken away.
        """
        n = self.version() + 1
        mine = f"{self.folder}/v{n}-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{mine}/{name}")
            draft = self._path(f"{self.folder}/draft/{uuid.uuid4().hex}")
            out = self._fs.create(draft, False)
            out.writeUTF(mine)
            out.close()
            self._fs.mkdirs(self._path(f"{self.folder}/current"))
            if not self._rename(draft, self._path(f"{self.folder}/current/{n}")):
                raise RuntimeError("another commit came first")
        except BaseException:
            self._fs.delete(self._path(mine), True)
            raise
        for old in range(1, n - keep + 1):
            at = self._path(f"{self.folder}/current/{old}")
            if self._fs.exists(at):
                self._fs.delete(self._path(self._folder(old)), True)
                self._fs.delete(at, False)
        return n

    def _rename(self, draft: object, to: object) -> bool:
        """Move a whole pointer to its place, unless there is one; local file systems would replace it."""
        lock = self._path(to.toString() + ".taken")
        if self._fs.exists(to) or not self._fs.createNewFile(lock):
            self._fs.delete(draft, False)
            return False
        done = self._fs.rename(draft, to)
        self._fs.delete(lock, False)
        return done
