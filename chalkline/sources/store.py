"""Folders of a store, by name: what is committed, and what is there."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """A folder that Spark reads and writes, in any of its file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def complete(self, *parts: str) -> bool:
        """The folder was written by a job that committed."""
        return self.fs.exists(self.path(self.at(*parts, "_SUCCESS")))

    def names(self, *parts: str) -> list[str]:
        folder = self.path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def ids(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the sub-folders ``<prefix><number>``, in order."""
        names = self.names(folder) if folder else self.names()
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(self.at(*parts)), True)
