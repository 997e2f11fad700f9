"""Versioned Parquet tables: a new version is written beside the old one and then becomes the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Warehouse:
    """Tables below a folder of any file system that Spark knows; a table's versions are folders named by number.

    A version counts once Spark's commit marker is in it, so a writer that dies leaves the former version in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs(f"{self.folder}/{name}")
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in found if p.getName().isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A version of a table, by default the last complete one."""
        known = self.versions(name)
        if not known:
            raise FileNotFoundError(f"no complete version of {name} in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{known[-1] if version is None else version}")

    def write(self, name: str, rows: DataFrame) -> int:
        """Write the next version; the rows may be made from the current one."""
        version = (self.versions(name) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{version}")
        return version

    def prune(self, name: str, keep: int = 2) -> None:
        """Remove all but the last versions."""
        for version in self.versions(name)[:-keep]:
            fs, path = self._fs(f"{self.folder}/{name}/{version}")
            fs.delete(path, True)


def append_capped(log: DataFrame, rows: DataFrame, cap: int = 1000) -> DataFrame:
    """A log (at, ...) with rows appended, trimmed to its last ``cap`` ones: the cap is the feature."""
    return log.unionByName(rows, allowMissingColumns=True).orderBy(F.desc("at")).limit(cap)
