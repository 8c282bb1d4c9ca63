"""Folders that driver and executors share, and pointers in them that are switched in one step."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

_own_root: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, on one machine, under a folder of this process."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own_root = _own_root or tempfile.mkdtemp(prefix="tallyweir-")
        root = f"file://{_own_root}"
    return f"{root.rstrip('/')}/tallyweir-scratch/{name}-{uuid.uuid4().hex}"


class Conflict(Exception):
    """Someone else has switched the pointer since it was read."""


class Folder:
    """A folder in any store that Spark reads, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.at("").getFileSystem(self._conf)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self) -> list[str]:
        p = self.at("")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def age_s(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def write_new(self, name: str, text: str) -> bool:
        """Whether this call has created the file: one that is there stays as it is."""
        try:
            out = self._fs.create(self.at(name), False)
        except Exception as failed:
            if self._fs.exists(self.at(name)):
                return False
            raise failed
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{old} could not become {new} in {self.path}")

    def read(self, name: str) -> str:
        file = self._fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()


class Pointer:
    """A small value with a version. ``swap`` succeeds only on the version that was read; readers see the old or the new one, whole.

    Version n is the file ``n.json``.  Who wants to write it claims ``n.claim`` first, which one alone can create, writes
    beside it and renames.  A claim whose owner has died is void after ``stale_s`` seconds.
    """

    def __init__(self, spark: SparkSession, path: str, stale_s: float = 600):
        self.folder, self.stale_s = Folder(spark, path), stale_s

    def read(self) -> tuple[int, dict]:
        """(version, value); version 0 and an empty value where nothing was written yet."""
        versions = [int(n[:-5]) for n in self.folder.names() if n.endswith(".json") and n[:-5].isdigit()]
        return (max(versions), json.loads(self.folder.read(f"{max(versions):020d}.json"))) if versions else (0, {})

    def swap(self, version: int, value: dict) -> int:
        name = f"{version + 1:020d}"
        if self.read()[0] != version:
            raise Conflict(f"{self.folder.path} has moved on from version {version}")
        if not self.folder.write_new(f"{name}.claim", ""):
            if self.folder.exists(f"{name}.json") or self.folder.age_s(f"{name}.claim") < self.stale_s:
                raise Conflict(f"someone else writes version {version + 1} of {self.folder.path}")
            self.folder.delete(f"{name}.claim")
            if not self.folder.write_new(f"{name}.claim", ""):
                raise Conflict(f"someone else writes version {version + 1} of {self.folder.path}")
        mine = f"{name}.{uuid.uuid4().hex}"
        self.folder.write_new(mine, json.dumps(value))
        self.folder.rename(mine, f"{name}.json")
        return version + 1

    def forget(self, keep: int) -> None:
        """Deletes the files of all versions but the newest ``keep``."""
        newest = self.read()[0]
        for name in self.folder.names():
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) <= newest - keep:
                self.folder.delete(name)
