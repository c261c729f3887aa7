"""Folders on any file system Spark knows, and numbered commit files in them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that driver and executors share, through Spark's own file system layer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that is there whole or not at all: written under another name, then renamed. An error if there is one."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._at(draft), False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self.exists(name) or not self._fs.rename(self._at(draft), self._at(name)):
            self.remove(draft)
            raise FileExistsError(self.path(name))


class CommitLog:
    """``commits/N.json``: number N counts from the moment its file is there."""

    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def numbers(self) -> list[int]:
        """Committed numbers in order, from the listing alone."""
        return sorted(int(n[:-5]) for n in self.folder.names("commits") if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.folder.read(f"commits/{number}.json"))

    def add(self, number: int, said: dict) -> None:
        self.folder.create(f"commits/{number}.json", json.dumps(said))
