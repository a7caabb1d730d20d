"""Files of a database, on any store that Spark's Hadoop file systems reach."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self._path(root)).toString()
        self.fs.mkdirs(self._path(f"{self.root}/catalog"))

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the newest committed catalog; (0, None) if there is none."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/catalog"))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, None
        stream = self.fs.open(self._path(f"{self.root}/catalog/{max(numbers):012d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(raw)

    def commit(self, number: int, state: dict) -> None:
        """Write catalog ``number``; fails if another writer has made it meanwhile."""
        staged = self._path(f"{self.root}/catalog/.{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        target = self._path(f"{self.root}/catalog/{number:012d}.json")
        if self.fs.exists(target) or not self.fs.rename(staged, target):
            self.fs.delete(staged, False)
            raise RuntimeError("the database was changed by another writer meanwhile")

    def segment(self, oid: int) -> str:
        """A new folder for rows of a table."""
        return f"{self.root}/data/{oid}/{uuid.uuid4().hex}"

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
