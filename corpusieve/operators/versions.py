"""Versions of a table: small JSON files, each put in place whole by a rename that never overwrites."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the version first; what was read is out of date."""


class Versions:
    """The versions below ``root``. Needs a file system whose rename is atomic."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root, self._path = root.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # rename without overwriting

    def newest(self) -> int:
        """The number of the newest version; 0 if there is none."""
        at = self._path(f"{self.root}/versions")
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/versions/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, version: int, content: dict) -> None:
        """Makes a version; Conflict if there is one of that number."""
        final, aside = self._path(f"{self.root}/versions/v{version:010d}.json"), self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            self._context.rename(aside, final, self._keep)
        except Py4JJavaError as error:
            self.fs.delete(aside, False)
            if self.fs.exists(final):
                raise Conflict(f"version {version} was made by another writer") from error
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def folders(self, prefix: str) -> list[str]:
        at = self._path(self.root)
        return sorted(n for n in (x.getPath().getName() for x in self.fs.listStatus(at)) if n.startswith(prefix)) if self.fs.exists(at) else []
