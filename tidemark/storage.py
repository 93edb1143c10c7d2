"""Small files and folders on the file system that the session's paths name: local, HDFS or an object store."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A folder with JSON manifests that are numbered and never rewritten; the highest number is the current one.

    A manifest is written under another name and then renamed, so a reader sees a whole one or none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self) -> None:
        self._fs.mkdirs(self._at())

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def current(self) -> dict | None:
        """The newest manifest, or None."""
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self._fs.open(self._at(f"manifest-{numbers[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, manifest: dict, keep: int = 2) -> None:
        """Make the manifest the current one and remove all but the last `keep`."""
        fresh = self._at(f".manifest-{number}.tmp")
        out = self._fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(fresh, self._at(f"manifest-{number}.json")):
            raise FileExistsError(f"manifest {number} of {self.path} exists: another writer is at work")
        for old in self._numbers()[:-keep]:
            self.delete(f"manifest-{old}.json")
