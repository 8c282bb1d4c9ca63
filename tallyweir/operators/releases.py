"""Releases of gold tables and of vector indexes: written aside, compared, and switched by one pointer."""

from __future__ import annotations

import functools
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.operators import retrieval as rt
from tallyweir.sources.shared import Conflict, Folder, Pointer

#: Inactive releases, superseded or rolled back, whose folders stay.
KEPT = 3


class Releases:
    """Releases of a set of tables under ``root``.

    A release is written to a folder of its own.  The pointer's value lists all releases with their states and row counts,
    and swapping it makes a release active: a reader sees the old tables or the new ones, never some of each.  Of two
    promotions at the same time one raises ``Conflict`` and leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer, self.folder = Pointer(spark, f"{self.root}/current"), Folder(spark, self.root)

    def log(self) -> list[dict]:
        """Of every release: release, folder, state (active, superseded, rolled_back), retained, at, note and row counts."""
        return self.pointer.read()[1].get("releases", [])

    def _now(self) -> str:
        return datetime.now(UTC).isoformat()

    def promote(self, tables: dict[str, DataFrame], note: str = "") -> int:
        """Copies the candidate tables (none called ``stg_`` or ``int_``), counts them and makes them active; the folders of all but the ``KEPT`` newest inactive releases go."""
        chosen = {n: rows for n, rows in sorted(tables.items()) if not n.startswith(("stg_", "int_"))}
        if not chosen:
            raise ValueError("nothing to promote")
        version, value = self.pointer.read()
        was = value.get("releases", [])
        number = max((r["release"] for r in was), default=0) + 1
        folder, counts = f"release={number}-{uuid.uuid4().hex[:8]}", {}
        try:
            for name, rows in chosen.items():
                rows.write.parquet(f"{self.root}/{folder}/{name}")
                counts[name] = self.spark.read.parquet(f"{self.root}/{folder}/{name}").count()  # from the footers
            now = [r | ({"state": "superseded", "at": self._now()} if r["state"] == "active" else {}) for r in was]
            now.append({"release": number, "folder": folder, "state": "active", "retained": True, "at": self._now(), "note": note, "counts": counts})
            inactive = sorted((r for r in now if r["state"] != "active" and r["retained"]), key=lambda r: -r["release"])
            gone = {r["release"] for r in inactive[KEPT:]}
            self.pointer.swap(version, {"releases": [r | {"retained": r["retained"] and r["release"] not in gone} for r in now]})
        except BaseException:
            self.folder.delete(folder)
            raise
        for r in inactive[KEPT:]:
            self.folder.delete(r["folder"])
        return number

    def rollback(self) -> int:
        """Makes the newest superseded release with a folder active; the active one is rolled back. Returns its number."""
        version, value = self.pointer.read()
        rows = value.get("releases", [])
        before = [r["release"] for r in rows if r["state"] == "superseded" and r["retained"]]
        if not any(r["state"] == "active" for r in rows):
            raise ValueError("no release is active")
        if not before:
            raise ValueError("no release is retained")
        to = {"active": "rolled_back"}
        now = [r | {"state": "active" if r["release"] == max(before) else to.get(r["state"], r["state"])} for r in rows]
        self.pointer.swap(version, {"releases": now})
        return max(before)

    def read(self, name: str) -> DataFrame:
        active = next((r for r in self.log() if r["state"] == "active"), None)
        if active is None:
            raise ValueError("no release is active")
        return self.spark.read.parquet(f"{self.root}/{active['folder']}/{name}")

    def counts(self) -> DataFrame:
        """(release, state, retained, table_name, n_rows)."""
        rows = [(r["release"], r["state"], r["retained"], t, n) for r in self.log() for t, n in r["counts"].items()]
        return self.spark.createDataFrame(rows, "release int, state string, retained boolean, table_name string, n_rows long")


class VectorIndex:
    """Vectors by model under ``root``, of which one model is read; the pointer names it.

    A change of model is a shadow index: ``build`` fills it from the texts, ``write`` puts new texts into every index
    that is there, ``compare`` asks both the same labelled queries, and ``cut_over`` switches the pointer unless the new
    model finds less.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer, self.folder = Pointer(spark, f"{self.root}/active"), Folder(spark, self.root)

    def _embedded(self, texts: DataFrame, dims: int) -> DataFrame:
        return rt.dense(rt.hash_embed(texts, "doc_id", "text", dims), "doc_id", dims)

    def models(self) -> dict[str, int]:
        """Dimensions of each model that has an index."""
        return {n.split("=")[1].rsplit("~", 1)[0]: int(n.rsplit("~", 1)[1]) for n in self.folder.names() if n.startswith("model=")}

    def _path(self, model: str, dims: int) -> str:
        return f"{self.root}/model={model}~{dims}"

    def vectors(self, model: str) -> DataFrame:
        """(doc_id, embedding, batch): the newest vector of each document."""
        dims = self.models().get(model)
        if dims is None:
            raise ValueError(f"no index of {model}")
        rows = self.spark.read.parquet(self._path(model, dims))
        return rows.groupBy("doc_id").agg(F.max_by("embedding", "batch").alias("embedding"))

    def build(self, texts: DataFrame, model: str, dims: int) -> None:
        """Fills a model's index from the source texts, not from other vectors."""
        if self.models().get(model, dims) != dims:
            raise ValueError(f"{model} has {self.models()[model]} dimensions, not {dims}")
        self._embedded(texts, dims).withColumn("batch", F.lit(0)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self._path(model, dims))
        if not self.pointer.read()[1]:
            self.pointer.swap(0, {"model": model, "dims": dims})

    def write(self, texts: DataFrame, batch: int) -> None:
        """New or changed texts go to every index, under a batch number of at least 1, so that a repeated write changes nothing."""
        for model, dims in self.models().items():
            self._embedded(texts, dims).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self._path(model, dims))

    def active(self) -> dict:
        return self.pointer.read()[1]

    def search(self, queries: DataFrame, k: int, model: str | None = None) -> DataFrame:
        """Nearest documents by the active model; asking with vectors of another number of dimensions raises."""
        name = model or self.active()["model"]
        rows = self.vectors(name).withColumnRenamed("doc_id", "vec_id")
        return rt.knn_exact(rows, self._embedded(queries, self.models()[name]).withColumnRenamed("doc_id", "vec_id"), k)

    def compare(self, queries: DataFrame, labels: DataFrame, k: int, models: tuple[str, ...]) -> DataFrame:
        """(model, precision): share of the k nearest that have the query's label (doc_id, label), the query itself left out."""
        return functools.reduce(DataFrame.unionByName, [self._precision(queries, labels, k, m) for m in models])

    def _precision(self, queries: DataFrame, labels: DataFrame, k: int, model: str) -> DataFrame:
        found = self.search(queries, k + 1, model)
        near = found.where("query_id <> vec_id")
        a, b = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("_want")), labels.select(F.col("doc_id").alias("vec_id"), F.col("label").alias("_got"))
        return near.join(a, "query_id").join(b, "vec_id").agg(F.lit(model).alias("model"), F.round(F.avg((F.col("_want") == F.col("_got")).cast("double")), 6).alias("precision"))

    def cut_over(self, queries: DataFrame, labels: DataFrame, model: str, k: int = 5, slack: float = 0.0) -> dict:
        """Makes ``model`` the one that is read if its precision is at least the active one's less ``slack``."""
        version, value = self.pointer.read()
        scores = {r["model"]: r["precision"] or 0.0 for r in self.compare(queries, labels, k, (value["model"], model)).collect()}  # a row a model
        if scores[model] < scores[value["model"]] - slack:
            raise ValueError(f"{model} finds {scores[model]}, {value['model']} {scores[value['model']]}")
        self.pointer.swap(version, {"model": model, "dims": self.models()[model]})
        return scores

    def retire(self, model: str) -> None:
        if model == self.active().get("model"):
            raise ValueError(f"{model} is read")
        self.folder.delete(f"model={model}~{self.models()[model]}")


__all__ = ["KEPT", "Conflict", "Releases", "VectorIndex"]
